"""What a running command tells: a bounded queue of events, and their form as server-sent events."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Progress:
    """Events of one command. A reader that is too slow loses the oldest ones, which are counted; the command never waits for it."""

    most: int = 256
    dropped: int = 0
    closed: bool = False
    _events: deque = field(default_factory=deque)
    _ready: threading.Condition = field(default_factory=threading.Condition)

    def emit(self, stage: str, **detail) -> None:
        with self._ready:
            if len(self._events) >= self.most:
                self._events.popleft()
                self.dropped += 1
            self._events.append({"stage": stage, "at": time.time(), **detail})
            self._ready.notify_all()

    def close(self) -> None:
        with self._ready:
            self.closed = True
            self._ready.notify_all()

    def events(self, patience: float | None = None) -> Iterator[dict]:
        """Events as they come, until the command has ended, or none has come for `patience` seconds."""
        while True:
            with self._ready:
                if not self._events and not self.closed:
                    self._ready.wait(patience)
                if not self._events:
                    return
                event = self._events.popleft()
            yield event


def server_sent(event: dict) -> bytes:
    return f"event: {event['stage']}\ndata: {json.dumps(event, default=str)}\n\n".encode()
