"""Admission as streams: a visitor's window, the day's limit and token buckets as states that timers of event time empty.

Requests of one micro-batch are decided in order of time, then of event_id, across micro-batches as they come; for requests that come in order the
decisions are those of the batch operators in `quota`. The session needs the RocksDB state store: see STORE.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pergola.streaming import quota

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: How late a request may come and still be decided; a later one is left out.
LATE = "10 minutes"


def _stamped(asked: DataFrame, late: str) -> DataFrame:
    return asked.withColumn("at", F.timestamp_micros((F.col("second") * 1_000_000).cast("long"))).withWatermark("at", late)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["second", "event_id"], kind="stable")


class _Visitor(StatefulProcessor):
    """A visitor's admissions that may still count, as a list; cleared once the watermark is a window past the last."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "second double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        history = deque(t for (t,) in self.admitted.get()) if self.admitted.exists() else deque()
        found = _ordered(rows)
        out = [(int(e), int(key[0]), float(s), *quota.admit(history, float(s), self.limit, self.window)) for e, s in zip(found.event_id, found.second)]
        if history:
            self.admitted.put([(t,) for t in history])
            _remind(self.handle, history[-1] + self.window)
        yield pd.DataFrame(out, columns=["event_id", "visitor", "second", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.admitted.exists() and max(t for (t,) in self.admitted.get()) + self.window < expiredTimerInfo.getExpiryTimeInMs() / 1000:
            self.admitted.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _remind(handle: StatefulProcessorHandle, second: float) -> None:
    """A timer for just after a second of event time, in place of any other."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(int(second * 1000) + 1000)


def visitor_quota(asked: DataFrame, limit: int = quota.VISITOR_LIMIT, window: int = quota.WINDOW_SECONDS, late: str = LATE) -> DataFrame:
    """quota.visitor_quota of a stream of event_id, visitor, second."""
    return _stamped(asked, late).groupBy("visitor").transformWithStateInPandas(_Visitor(limit, window), quota.DECISION, "Append", "EventTime")


class _Budget(StatefulProcessor):
    """Visitors' admissions by visitor, the day and what it has served, and the visitors by the second at which they may be forgotten."""

    def __init__(self, limit: int, window: int, daily: int):
        self.limit, self.window, self.daily = limit, window, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.served = handle.getMapState("served", "visitor long", "seconds array<double>")
        self.day = handle.getValueState("day", "day long, used int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = _ordered(rows)
        today, used = self.day.get() if self.day.exists() else (None, 0)
        own: dict[int, deque] = {}
        out = []
        for e, v, now in zip(found.event_id.tolist(), found.visitor.tolist(), found.second.tolist()):
            day = int(now // quota.DAY)
            if today is None or day != today:
                today, used = day, 0
            if v not in own:
                own[v] = deque(self.served.getValue((v,))[0]) if self.served.containsKey((v,)) else deque()
            history = own[v]
            while history and history[0] < now - self.window:
                history.popleft()
            if len(history) >= self.limit:
                out.append((e, v, now, day, False, "visitor", 0, max(0, self.daily - used), max(1, int(self.window - (now - history[0])))))
            elif used >= self.daily:
                out.append((e, v, now, day, False, "global", self.limit - len(history), 0, max(1, quota.DAY - 1 - int(now % quota.DAY))))
            else:
                history.append(now)
                used += 1
                out.append((e, v, now, day, True, "", self.limit - len(history), self.daily - used, 0))
        for v, history in own.items():
            if history:
                self.served.updateValue((v,), (list(history),))
                self.handle.registerTimer(int((history[-1] + self.window) * 1000) + 1000)
            elif self.served.containsKey((v,)):
                self.served.removeKey((v,))
        if today is not None:
            self.day.update((today, used))
            self.handle.registerTimer((today + 1) * quota.DAY * 1000 + 1000)
        yield pd.DataFrame(out, columns=["event_id", "visitor", "second", "day", "allowed", "scope", "remaining", "remaining_today", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for (v,), (seconds,) in list(self.served.iterator()):
            if seconds[-1] + self.window < now:
                self.served.removeKey((v,))
        if self.day.exists() and (self.day.get()[0] + 1) * quota.DAY < now:
            self.day.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def budget(asked: DataFrame, scope: Column | None = None, limit: int = quota.VISITOR_LIMIT, window: int = quota.WINDOW_SECONDS, daily: int = quota.DAILY_LIMIT, late: str = LATE) -> DataFrame:
    """quota.budget of a stream of event_id, visitor, second: a day's limit for all visitors of a scope, which couples them, so a scope is one sequence.

    Each scope is a key of its own; without one there is a single key. Only the visitors that a micro-batch has are read from the state, and
    those idle for a window are dropped from it.
    """
    stamped = _stamped(asked, late).withColumn("scope_key", scope if scope is not None else F.lit(""))
    return stamped.groupBy("scope_key").transformWithStateInPandas(_Budget(limit, window, daily), quota.BUDGET, "Append", "EventTime")


class _Bucket(StatefulProcessor):
    """What a bucket holds and since when; forgotten once it would be full again, as a new one is."""

    def __init__(self, per_minute: float, capacity: float):
        self.rate, self.capacity = per_minute / 60.0, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, second double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = _ordered(rows)
        tokens, then = self.bucket.get() if self.bucket.exists() else (self.capacity, float(found.second.iloc[0]))
        out = []
        for e, now, amount in zip(found.event_id.tolist(), found.second.tolist(), found.amount.tolist()):
            tokens, then = min(self.capacity, tokens + (now - then) * self.rate), now
            want = min(float(amount), self.capacity)
            taken = self.rate <= 0 or tokens >= want
            if taken and self.rate > 0:
                tokens -= want
            out.append((e, int(key[0]), taken, tokens))
        if self.rate > 0:
            self.bucket.update((tokens, then))
            _remind(self.handle, then + (self.capacity - tokens) / self.rate)
        yield pd.DataFrame(out, columns=["event_id", "visitor", "taken", "left"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def token_bucket(calls: DataFrame, per_minute: float, burst: int | None = None, late: str = LATE) -> DataFrame:
    """quota.token_bucket of a stream of event_id, visitor, second, amount."""
    capacity = float(burst if burst is not None else max(1, per_minute // 5))
    return _stamped(calls, late).groupBy("visitor").transformWithStateInPandas(_Bucket(per_minute, capacity), "event_id long, visitor long, taken boolean, left double", "Append", "EventTime")
