"""Commands, HTTP, the client around a provider, reports and reviews."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from pergola import __main__ as commands
from pergola.engine import Engine
from pergola.operators import diffs, evaluation, vectors
from pergola.plans import client, fixtures
from pergola.plans.provider import StandIn
from pergola.progress import Progress
from pergola.service import server
from pergola.sources import checkout, files

SOURCES = {"auth/token.py": "import os\n\n\ndef verify_token(token):\n    return os.environ.get(token) is not None\n", "README.md": "# Sample\nA service that checks tokens.\n", "skipped/x.py": "def skipped_function():\n    return 'skipped'\n", ".gitignore": "skipped/\n"}


@pytest.fixture
def engine(spark, tmp_path):
    for name, body in SOURCES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(body)
    return Engine(spark, f"file://{tmp_path}/indexes")


def call(port, verb, path, body=None):
    asked = urllib.request.Request(f"http://127.0.0.1:{port}{path}", method=verb, data=json.dumps(body).encode() if body is not None else None)
    try:
        with urllib.request.urlopen(asked, timeout=300) as got:
            return got.status, got.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_http(engine, tmp_path):
    own = server(engine, 0)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    port = own.server_address[1]
    assert call(port, "GET", "/health") == (200, '{"status": "ok"}')
    assert call(port, "POST", "/indexes", {"source": f"file://{tmp_path}/src", "id": "s"})[0] == 202
    status, events = call(port, "GET", "/indexes/s/events")
    assert status == 200 and [x.split("\n")[0] for x in events.strip().split("\n\n")] == [f"event: {s}" for s in ("scan", "chunk", "embed", "write", "done")]
    assert [x["index_id"] for x in json.loads(call(port, "GET", "/indexes")[1])] == ["s"]
    found = json.loads(call(port, "GET", "/source?id=s&path=auth/token.py")[1])
    assert [(r["symbol"], r["kind"]) for r in found if r["symbol"]] == [("verify_token", "function")]
    assert call(port, "GET", "/source?id=s&path=skipped/x.py")[0] == 404
    answer = json.loads(call(port, "POST", "/ask", {"id": "s", "question": "how is verify_token done?"})[1])
    assert answer["citations"] and answer["confidence"] > 0
    assert "event: answer" in call(port, "POST", "/ask/stream", {"id": "s", "question": "how is verify_token done?"})[1]
    for verb, path, body, status in (("POST", "/ask", {"id": "s", "question": "x"}, 422), ("POST", "/ask", {"id": "none", "question": "what is it?"}, 404), ("GET", "/nowhere", None, 404), ("POST", "/indexes", {}, 422), ("DELETE", "/indexes/none", None, 404)):
        assert call(port, verb, path, body)[0] == status, path
    assert call(port, "DELETE", "/indexes/s")[0] == 200 and json.loads(call(port, "GET", "/indexes")[1]) == []
    own.shutdown()


def test_commands(engine, tmp_path, capsys):
    assert commands.main(["index", str(tmp_path / "src"), "--id", "mine"], engine) == 0
    assert commands.main(["list"], engine) == 0 and "mine" in capsys.readouterr().out
    assert commands.main(["ask", "mine", "where is verify_token?", "what is this for?"], engine) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 2
    (tmp_path / "cases.jsonl").write_text('// one case\n{"id": "a", "question": "verify_token", "expected_paths": ["auth/token.py"]}\n')
    assert commands.main(["eval", "mine", str(tmp_path / "cases.jsonl"), "--min-recall", "0.5"], engine) == 0
    (tmp_path / "a.diff").write_text(fixtures.GIT_DIFF)
    assert commands.main(["review", str(tmp_path / "a.diff")], engine) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["files_without_reply"] == 2
    assert commands.main(["delete", "mine"], engine) == 0 and commands.main(["delete", "mine"], engine) == 1
    assert commands.main(["ask", "mine", "where is it?"], engine) == 2
    assert commands.main(["index", "not a repository", "--id", "x"], engine) == 2
    assert commands.main(["doctor"]) == 0


class Reviewer(StandIn):
    """Finds something in one file, fails for every other."""

    def complete(self, prompts):
        found = F.lit('[{"line": 12, "severity": "high", "title": "Token kept", "body": "b", "category": "security", "confidence": 0.9}]')
        return prompts.select("key", F.when(F.contains("prompt", F.lit("of src/api.py:")), found).alias("reply"))


def test_a_failed_file_fails_no_other(spark):
    report, gate, summary, failed = Engine(spark, "unused", provider=Reviewer()).review_run(fixtures.DIFFS.frame(spark).where("diff_id = 'git'"))
    assert [(r.path, r.line, r.severity) for r in report.collect()] == [("src/api.py", 12, "high")]
    assert gate.first().blocked and failed == 1 and "1 high" in summary


class Listener(StandIn):
    """Keeps the prompts of a review."""

    def complete(self, prompts):
        if prompts.where("role = 'review'").count():
            self.heard = {r.key: r.prompt for r in prompts.collect()}
        return prompts.select("key", F.lit("[]").alias("reply"))


def test_a_review_has_what_is_related(spark, tmp_path):
    for name, body in {"src/quay.py": "def moor_vessel(berth):\n    return berth.moor_vessel_at_quay()\n", "lib/berth.py": "class Berth:\n    def moor_vessel_at_quay(self):\n        return self.tide_table\n", "docs/cats.md": "# Cats\nNothing about harbours here at all.\n"}.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(body)
    own = Engine(spark, f"file://{tmp_path}/indexes", provider=Listener())
    own.index(f"file://{tmp_path}/repo", "harbour")
    change = "--- a/src/quay.py\n+++ b/src/quay.py\n@@ -1 +1,2 @@\n-old_line\n+moor_vessel_at_quay(tide_table)\n+other_name\n"
    diff = spark.createDataFrame([("one", change), ("two", change.replace("other_name", "third_name"))], "diff_id string, text string")
    report, _, _, failed = own.review_run(diff, index_id="harbour")
    assert failed == 0 and report.count() == 0 and set(own.provider.heard) == {"one#1", "two#1"}
    one, two = own.provider.heard["one#1"], own.provider.heard["two#1"]
    assert "other_name" in one and "other_name" not in two and "third_name" in two
    assert all("lib/berth.py" in p and "tide_table" in p and "def moor_vessel(berth)" not in p and p.index("lib/berth.py") < p.index("Review this change") for p in (one, two))
    own.review_run(diff)
    assert "lib/berth.py" not in own.provider.heard["one#1"]


class Flaky:
    """Fails at first, then replies; counts what it was asked."""

    def __init__(self, replies):
        self.replies, self.asked = list(replies), []

    def complete(self, prompts):
        self.asked.append(prompts.count())
        reply = self.replies.pop(0) if self.replies else None
        return prompts.select("key", F.lit(reply).cast("string").alias("reply"))

    def embed(self, texts):
        return texts.select("key", F.when(F.col("text") != "", F.array(F.lit(1.0))).cast("array<float>").alias("embedding"))


def test_client(spark):
    prompts = spark.createDataFrame([("a", "answer", "p"), ("b", "answer", "p"), ("c", "answer", "q")], "key string, role string, prompt string")
    waits = []
    own = client.Client(Flaky([None, "yes"]), sleep=waits.append)
    assert {r.key: r.reply for r in own.complete(prompts).collect()} == {"a": "yes", "b": "yes", "c": "yes"}
    assert own.provider.asked == [2, 2] and len(waits) == 1 and 0.375 <= waits[0] <= 0.75
    assert own.complete(prompts).where("reply = 'yes'").count() == 3 and sum(own.provider.asked[2:]) == 0
    mended = client.Client(Flaky(["no JSON", '{"n": 4}']), sleep=waits.append)
    assert [r.value.n for r in mended.structured(prompts.limit(1), "struct<n int>").collect()] == [4]
    texts = spark.createDataFrame([("a", "x"), ("b", "")], "key string, text string")
    assert {r.key: r.embedding for r in own.embed(texts).collect()} == {"a": [1.0], "b": []}
    assert [list(x) for x in own.stream(prompts.limit(1))] == [["a", "yes"]]


def test_bucket_and_delays():
    now = [0.0]
    own = client.Bucket(60, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [own.take() for _ in range(2)] == [0, 0] and own.take() == pytest.approx(1.0) and client.Bucket(0).take() == 0
    assert client.delay(3, True, chance=lambda: 1) == 32 and client.delay(9, True, chance=lambda: 1) == 90 and client.delay(0, True, 7, chance=lambda: 0) == 3.5
    assert client.delay(9, False, chance=lambda: 1) == 20
    slots = client.Slots(2)
    with slots, slots:
        assert slots.now == 2
    assert slots.peak == 2


def test_progress_drops_the_oldest():
    own = Progress(most=3)
    for k in range(5):
        own.emit("step", k=k)
    own.close()
    assert [e["k"] for e in own.events()] == [2, 3, 4] and own.dropped == 2


def test_checkout(tmp_path):
    said = []

    def run(arguments, folder):
        said.append(arguments[0])
        if arguments[0] == "clone":
            (tmp_path / "cache/owner-name/.git").mkdir(parents=True)
        return "abc"

    for _ in range(2):
        assert checkout.resolve("owner/name", str(tmp_path / "cache"), run=run) == (str(tmp_path / "cache/owner-name"), "abc")
    assert said == ["clone", "rev-parse", "fetch", "reset", "rev-parse"]
    checkout.resolve("owner/name", str(tmp_path / "cache"), refresh=True, run=run)
    assert said[5:] == ["clone", "rev-parse"]
    with pytest.raises(checkout.CheckoutError):
        checkout.resolve("what is this?", str(tmp_path))
    assert checkout.folder_name("git@host.example:owner/Repo.git") == "owner-repo"


def test_scan_opens_only_what_may_be_indexed(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n", "node_modules/b.py": "y = 2\n", ".github/c.yml": "z\n", "__init__.py": "w = 4\n", "empty.txt": "", "big.txt": "b" * 5000, "été dir/é.py": "u = 3\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = {r.path: r for r in files.scan(spark, f"file://{tmp_path}", 1000).collect()}
    assert set(rows) == {"a.py", "__init__.py", "empty.txt", "big.txt", "été dir/é.py"}
    assert rows["__init__.py"].bytes == b"w = 4\n" and rows["big.txt"].bytes is None and rows["big.txt"].size_bytes == 5000
    reasons = {r.path: r.skip_reason for r in files.judged(files.decoded(files.scan(spark, f"file://{tmp_path}", 1000)), max_bytes=1000).collect()}
    assert reasons == {"a.py": None, "__init__.py": None, "été dir/é.py": None, "empty.txt": "too_large", "big.txt": "too_large"}


def test_reviews_are_posted_once_more_without_comments():
    sent = []

    def post(payload):
        sent.append(payload)
        return 422 if payload["comments"] else 200

    assert diffs.posted({"event": "COMMENT", "body": "all", "comments": [{"path": "a.py", "line": 3, "body": "why"}]}, post) == 200
    assert sent[1]["comments"] == [] and sent[1]["body"] == "all\n- `a.py:3` why"
    with pytest.raises(ValueError):
        diffs.posted({"comments": []}, lambda _: 500)


def test_pull_request_of_a_workflow():
    read = {"e": '{"pull_request": {"number": 9}, "repository": {"full_name": "o/r"}}', "n": "{}"}.__getitem__
    assert files.pull_request_of("o/r#3", {}, read) == ("o/r", 3) and files.pull_request_of("#4", {"GITHUB_REPOSITORY": "a/b"}, read) == ("a/b", 4)
    assert files.pull_request_of(None, {"GITHUB_EVENT_PATH": "e"}, read) == ("o/r", 9) and files.pull_request_of(None, {"GITHUB_EVENT_PATH": "n"}, read) is None
    assert files.pull_request_of("what?", {"GITHUB_EVENT_PATH": "e"}, read) is None and files.pull_request_of(None, {}, read) is None


def test_vector_store(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "key string, embedding array<float>")
    own = vectors.VectorStore(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0]))).add(rows(("b", [1.0, 0.1]), ("c", [0.0, -1.0])))
    own.save(f"file://{tmp_path}/v")
    again = vectors.VectorStore.load(spark, f"file://{tmp_path}/v")
    asked = spark.createDataFrame([("q", [1.0, 0.2])], "qid string, embedding array<float>")
    assert len(again) == 3 and [r.doc for r in again.search(asked, 2).orderBy("rank").collect()] == ["b", "a"]


def test_report(spark):
    summary = spark.createDataFrame([(0.8, 0.7, 3.0, 1, 12.34, 0.00123, 4321)], "pass_rate double, mean_confidence double, mean_citations double, hallucination_cases long, mean_latency_s double, mean_cost_usd double, mean_tokens long")
    ways = spark.createDataFrame([(0, "dense only", 1.0, 0.5, 0.2, 0.6, 0.5)], "position int, variant string, hit_rate double, recall double, precision double, mrr double, ndcg double")
    cases = spark.createDataFrame([("a", "x", None, True, 4.5, 0.9, 1.0, 3), ("b", "x", "quota", None, None, None, None, None)], "case_id string, category string, error string, passed boolean, overall double, confidence double, recall double, citations int")
    text = evaluation.report(summary, ways, cases).first().markdown
    assert "| Answer pass rate | 80.0% |" in text and "dense only         #########......... 0.500" in text
    assert "| `a` | x | 4.5 (pass) | 0.90 | 100.0% | 3 |" in text and "| `b` | x | ERROR | - | - | - |" in text and "- `b` quota" in text
