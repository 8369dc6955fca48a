"""A small repository from folder to answers."""

from pyspark.sql import functions as F

from pergola.engine import Engine
from pergola.plans import agent, fixtures

SOURCES = {
    "auth/jwt.py": "class TokenValidator:\n    def verify_jwt(self, token):\n        return check_signature(token)\n\n\ndef build_validator(key):\n    return TokenValidator(key)\n",
    "web/app.js": "export function createServer(port) {\n  return listen(port, router);\n}\n",
    "README.md": "# Sample\nA service that checks tokens.\n\n## Auth\nTokens are verified by the validator in auth.\n",
    "node_modules/junk/index.js": "ignored();\n",
}


def test_index_ask_evaluate(spark, tmp_path):
    for name, body in SOURCES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(body)
    engine = Engine(spark, f"file://{tmp_path}/indexes")
    assert {r.reason: r.n for r in engine.index(f"file://{tmp_path}/src", "sample", "0123456789").collect()} == {"kept": 3}
    assert [r.index_id for r in engine.list().collect()] == ["sample"]
    assert [(r.kind, r.symbol) for r in engine.source("sample", "auth/jwt.py").collect()] == [("class", "TokenValidator"), ("function", "build_validator")]
    questions = spark.createDataFrame([("q1", "how does verify_jwt check the signature?"), ("q2", "zzzz qqqq")], "qid string, question string")
    found = {r.qid: r for r in engine.ask("sample", questions).collect()}
    assert found["q1"].citations[0].path in SOURCES and found["q1"].confidence > 0.5 and found["q1"].refinements == 0
    assert set(found) == {"q1", "q2"}
    cases = spark.createDataFrame([("q1", "verify_jwt signature", ["auth/jwt.py"])], "id string, question string, expected_paths array<string>")
    row = engine.evaluate("sample", cases).first()
    assert (row.cases, row.hit_rate, row.mrr) == (1, 1.0, 1.0)
    assert engine.delete("sample") and engine.list().count() == 0


class Failing:
    def embed(self, texts):
        return texts.select("key", F.lit(None).cast("array<float>").alias("embedding"))

    def complete(self, prompts):
        return prompts.select("key", F.lit(None).cast("string").alias("reply"))


def test_a_model_that_fails_leaves_the_question(spark):
    questions = spark.createDataFrame([("q", "what is it?")], "qid string, question string")
    row = agent.planned(questions, Failing()).first()
    assert (row.queries, row.needs_retrieval) == (["what is it?"], True)
    row = agent.criticised(spark.createDataFrame([("q", "draft")], "qid string, draft string"), Failing(), 0, 2).first()
    assert (row.verdict, row.critic) == ("accept", 0.5)


def test_routes(spark):
    rows = spark.createDataFrame([("refine", ["a"]), ("refine", []), ("accept", ["a"])], "v string, f array<string>")
    assert [r.to for r in rows.select(agent.routed(F.col("v"), F.col("f")).alias("to")).collect()] == ["retrieve", "finalise", "finalise"]
    needs = spark.createDataFrame([(True,), (False,), (None,)], "n boolean")
    assert [r.to for r in needs.select(agent.first_route(F.col("n")).alias("to")).collect()] == ["retrieve", "analyse", "retrieve"]


def test_review(spark):
    report, gate = Engine(spark, "unused").review(fixtures.DIFFS.frame(spark), fixtures.FINDINGS.frame(spark))
    assert report.first().severity == "critical" and gate.first().blocked
