"""Commands: index, ask, list, delete, review, eval, doctor, serve."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from pergola.engine import Engine
from pergola.session import local_session
from pergola.sources import checkout, files


def _print(rows: DataFrame) -> None:
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pergola")
    top.add_argument("--root", default=f"file://{Path.home()}/.pergola/indexes", help="folder of the indexes")
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser("index", help="index a folder or repository")
    add.add_argument("source")
    add.add_argument("--id")
    add.add_argument("--glob", action="append")
    add.add_argument("--refresh", action="store_true", help="clone anew")
    ask = commands.add_parser("ask", help="answer questions over an index")
    ask.add_argument("id")
    ask.add_argument("question", nargs="+")
    commands.add_parser("list", help="list indexes")
    delete = commands.add_parser("delete", help="remove an index")
    delete.add_argument("id")
    review = commands.add_parser("review", help="review a diff")
    review.add_argument("diff", help="a file, or - for standard input")
    review.add_argument("--fail-on", default="high")
    score = commands.add_parser("eval", help="score retrieval over an index")
    score.add_argument("id")
    score.add_argument("cases")
    score.add_argument("--min-recall", type=float, default=0.0)
    commands.add_parser("doctor", help="say what is there and what is not")
    serve = commands.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--port", type=int, default=8080)
    return top


def doctor() -> dict[str, bool]:
    import importlib.util

    wanted = {"java": shutil.which("java"), "git": shutil.which("git"), "pyarrow": importlib.util.find_spec("pyarrow"), "pandas": importlib.util.find_spec("pandas"), "numpy": importlib.util.find_spec("numpy")}
    return {name: bool(found) for name, found in wanted.items()}


def main(arguments: list[str] | None = None, engine: Engine | None = None) -> int:
    """Runs a command; 0 if it did, 1 if a gate stopped it or nothing was there, 2 if it could not."""
    own = parser().parse_args(arguments)
    if own.command == "doctor":
        found = doctor()
        print(json.dumps(found))
        return int(not found["java"])
    engine = engine or Engine(local_session(), own.root)
    try:
        if own.command == "index":
            folder, commit = checkout.resolve(own.source, str(Path.home() / ".pergola/checkouts"), own.refresh)
            _print(engine.index(f"file://{folder}", own.id or checkout.folder_name(folder), commit, globs=own.glob))
        elif own.command == "ask":
            asked = engine.spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(own.question)], "qid string, question string")
            _print(engine.ask(own.id, asked))
        elif own.command == "list":
            _print(engine.list())
        elif own.command == "delete":
            return int(not engine.delete(own.id))
        elif own.command == "review":
            text = sys.stdin.read() if own.diff == "-" else Path(own.diff).read_text()
            report, gate, summary, failed = engine.review_run(engine.spark.createDataFrame([("diff", text)], "diff_id string, text string"), own.fail_on)
            _print(report)
            print(json.dumps({"summary": summary, "files_without_reply": failed}))
            return int(gate.first().blocked)
        elif own.command == "eval":
            row = engine.evaluate(own.id, files.cases(engine.spark, own.cases))
            _print(row)
            return int(row.first().recall < own.min_recall)
        elif own.command == "serve":
            from pergola.service import server

            print(f"listening on {own.port}")
            server(engine, own.port).serve_forever()
    except (checkout.CheckoutError, KeyError, ValueError, FileNotFoundError) as e:
        print(str(e), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
