"""The engine over HTTP, in JSON, with the progress of indexing and of answers as server-sent events."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pergola.engine import Engine
from pergola.plans import agent
from pergola.progress import Progress, server_sent

BODY_BYTES = 4 << 20


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class Handlers:
    """What each route does, apart from HTTP."""

    def __init__(self, engine: Engine):
        self.engine, self.jobs, self.asked = engine, {}, 0

    def _rows(self, frame) -> list[dict]:
        return [r.asDict(recursive=True) for r in frame.collect()]

    def _known(self, index_id: str) -> str:
        if index_id not in {r.index_id for r in self.engine.list().collect()}:
            raise Refused(404, f"no index {index_id!r}")
        return index_id

    def question(self, body: dict) -> str:
        text = str(body.get("question", "")).strip()
        if not 3 <= len(text) <= 4000:
            raise Refused(422, "a question has 3 to 4000 characters")
        return text

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        return {"status": "ok", "indexes": self.engine.list().count()}

    def graph(self) -> dict:
        return {"steps": ["plan", "retrieve", "analyse", "critique", "finalise"], "max_refinements": self.engine.settings.max_refinements}

    def stats(self) -> dict:
        return {"questions": self.asked, "jobs": len(self.jobs), "open_indexes": len(self.engine.held)}

    def indexes(self) -> list[dict]:
        return self._rows(self.engine.list())

    def create(self, body: dict) -> dict:
        """Starts indexing; its events are read apart."""
        source, index_id = str(body.get("source", "")), str(body.get("id", ""))
        if not source or not index_id or "/" in index_id:
            raise Refused(422, "source and id are needed, and an id has no slash")
        job = self.jobs[index_id] = Progress()

        def run() -> None:
            try:
                self.engine.index(source, index_id, progress=job).collect()
            except Exception as e:  # a job's end is told, whatever it was
                job.emit("failed", error=str(e)[:400])
            finally:
                job.close()

        threading.Thread(target=run, daemon=True).start()
        return {"id": index_id, "events": f"/indexes/{index_id}/events"}

    def delete(self, index_id: str) -> dict:
        if not self.engine.delete(self._known(index_id)):
            raise Refused(404, f"no index {index_id!r}")
        return {"deleted": index_id}

    def source(self, index_id: str, path: str) -> list[dict]:
        rows = self._rows(self.engine.source(self._known(index_id), path))
        if not rows:
            raise Refused(404, f"no file {path!r}")
        return rows

    def ask(self, body: dict) -> dict:
        asked = self.engine.spark.createDataFrame([("q", self.question(body))], "qid string, question string")
        self.asked += 1
        return self._rows(self.engine.ask(self._known(str(body.get("id", ""))), agent.checked(asked)))[0]

    def ask_stream(self, body: dict):
        self.asked += 1
        return self.engine.stream(self._known(str(body.get("id", ""))), self.question(body))

    def review(self, body: dict) -> dict:
        if not body.get("diff"):
            raise Refused(422, "a diff is needed")
        diff = self.engine.spark.createDataFrame([("diff", str(body["diff"]))], "diff_id string, text string")
        report, gate, summary, failed = self.engine.review_run(diff, str(body.get("fail_on", "high")))
        return {"findings": self._rows(report), "gate": self._rows(gate)[0], "summary": summary, "files_without_reply": failed}


def server(engine: Engine, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server on a port (0 takes any that is free); it answers a request in a thread of its own."""
    own = Handlers(engine)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _send(self, status: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _events(self, events) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Connection", "close")
            self.end_headers()
            for event in events:
                self.wfile.write(server_sent(event))
                self.wfile.flush()
            self.close_connection = True

        def _body(self) -> dict:
            n = int(self.headers.get("Content-Length") or 0)
            if n > BODY_BYTES:
                raise Refused(413, "the body is too large")
            try:
                body = json.loads(self.rfile.read(n) or b"{}")
            except ValueError as e:
                raise Refused(400, "the body is not JSON") from e
            if not isinstance(body, dict):
                raise Refused(400, "the body is not an object")
            return body

        def _run(self, verb: str) -> None:
            url = urlparse(self.path)
            parts, asked = [p for p in url.path.split("/") if p], parse_qs(url.query)
            first = lambda k: asked.get(k, [""])[0]
            try:
                match verb, parts:
                    case "GET", ["health" | "ready" | "graph" | "stats" | "indexes" as name]:
                        self._send(200, getattr(own, name)())
                    case "GET", ["source"]:
                        self._send(200, own.source(first("id"), first("path")))
                    case "GET", ["indexes", index_id, "events"]:
                        if index_id not in own.jobs:
                            raise Refused(404, f"no job for {index_id!r}")
                        self._events(own.jobs[index_id].events())
                    case "POST", ["indexes"]:
                        self._send(202, own.create(self._body()))
                    case "POST", ["ask", "stream"]:
                        self._events(own.ask_stream(self._body()))
                    case "POST", ["ask" | "review" as name]:
                        self._send(200, getattr(own, name)(self._body()))
                    case "DELETE", ["indexes", index_id]:
                        self._send(200, own.delete(index_id))
                    case _:
                        raise Refused(404, "no such route")
            except Refused as e:
                self._send(e.status, {"error": str(e)})
            except Exception as e:  # one request's failure is its own
                self._send(500, {"error": str(e)[:400]})

        def do_GET(self):
            self._run("GET")

        def do_POST(self):
            self._run("POST")

        def do_DELETE(self):
            self._run("DELETE")

    return ThreadingHTTPServer((host, port), Handler)
