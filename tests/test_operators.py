"""Operators on small inputs with known results, and on the awkward ones: nulls, empty tables, ties."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pergola.functions import paths, text
from pergola.operators import answers, chunking, diffs, evaluation, fusion, lexical, retrieval, usage, vectors
from pergola.plans import fixtures
from pergola.sources import files, index
from pergola.streaming import quota


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


def test_tokens(spark):
    assert one(spark, "openHarborByID", text.code_tokens) == ["openharborbyid", "open", "harbor", "id"]
    assert one(spark, "drain_queue", text.code_tokens) == ["drain_queue", "drain", "queue"]
    assert one(spark, "is of an y def", text.code_tokens) == []
    assert "sha" in one(spark, "sha256Hash", text.code_tokens)
    assert one(spark, "sha256", text.code_tokens) == ["sha256"]
    assert one(spark, None, text.code_tokens) is None
    assert one(spark, "", text.code_tokens) == []


def test_token_cap_ends_after_the_word_that_reaches_it(spark):
    words = " ".join(f"w{i}_x" for i in range(4000))
    assert len(one(spark, words, text.code_tokens)) == 4000 + (4000 % 2)


DOCS = [
    ("a", "fn drain_queue(limit) empties pending jobs until none is left"),
    ("b", "struct HarborLedger keeps berths and tides by quay"),
    ("c", "fn paint_grid(rows) writes cells to a canvas"),
]


def search(spark, docs, query, k=5):
    held = lexical.build(lexical.tokenised(spark.createDataFrame(docs, "doc_id string, text string")))
    terms = lexical.query_terms(spark.createDataFrame([(1, query)], "qid int, text string"))
    return [r.doc for r in lexical.top(lexical.scores(held, terms), k).orderBy("rank").collect()]


def test_bm25(spark):
    assert search(spark, DOCS, "drain_queue")[0] == "a"
    assert search(spark, DOCS, "pending queue jobs")[0] == "a"
    assert search(spark, DOCS, "orchid soil moisture") == []
    assert search(spark, [("n", None)], "drain") == []
    assert search(spark, DOCS[:0], "drain") == []


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id string, embedding array<float>")


def test_nearest(spark):
    unit = vector_frame(spark, [(n, [float(i == j) for j in range(4)]) for i, n in enumerate("abcd")])
    asked = spark.createDataFrame([("q", [0.0, 0.0, 1.0, 0.0]), ("z", [0.0] * 4)], "qid string, embedding array<float>")
    found = vectors.nearest(unit, asked, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc, r.score) for r in found] == [("q", "c", 1.0), ("q", "a", 0.0), ("z", "a", 0.0), ("z", "b", 0.0)]
    assert vectors.nearest(unit, asked, 2, query_bytes=1).orderBy("qid", "rank").collect() == found
    assert vectors.nearest(unit.limit(0), asked, 2).count() == 0
    assert vectors.nearest(unit, asked.limit(0), 2).count() == 0


def test_nearest_ignores_length_and_refuses_other_dimensions(spark):
    asked = spark.createDataFrame([("q", [6.0, 8.0])], "qid string, embedding array<float>")
    assert vectors.nearest(vector_frame(spark, [("a", [3.0, 4.0])]), asked, 1).first().score == 1.0
    with pytest.raises(Exception, match="dimensions"):
        vectors.nearest(vector_frame(spark, [("a", [3.0, 4.0]), ("b", [1.0] * 3)]), asked, 1).collect()


def fused(spark, **lists):
    weights = {"lexical": 0.85}
    rows = [("q", d, i, f"{n.rstrip('w')}[0]", 5.0 if n.endswith("w") else weights.get(n, 1.0)) for n, ids in lists.items() for i, d in enumerate(ids)]
    return fusion.fuse(spark.createDataFrame(rows, "qid string, doc string, rank int, retriever string, weight double")).orderBy("position").collect()


def test_fusion(spark):
    first = fused(spark, dense="abc", lexical="cad")[0]
    assert (first.doc, first.agreement) == ("a", 2)
    x = next(r for r in fused(spark, dense="x", lexical="yx") if r.doc == "x")
    assert (x.dense_rank, x.lexical_rank) == (0, 1)
    assert fused(spark, dense="ab", lexicalw="ba")[0].doc == "b"
    assert fused(spark) == []


def test_diversity_keeps_four_of_a_file_first(spark):
    rows = [("q", f"d{i}", "f" if i < 8 else "g", 1.0 - i / 100, i) for i in range(10)]
    frame = spark.createDataFrame(rows, "qid string, doc string, path string, score double, position int")
    assert [r.doc for r in fusion.diversify(frame, 7).orderBy("place").collect()] == ["d0", "d1", "d2", "d3", "d8", "d9", "d4"]


def test_neighbours_may_pass_the_limit_by_one(spark):
    chunks = spark.createDataFrame([(f"{f}{i}", f, i) for f in "fg" for i in range(5)], "doc string, path string, start int")
    chosen = spark.createDataFrame([("q", "f2", "f", 1.0, 0), ("q", "f1", "f", 0.9, 1), ("q", "g0", "g", 0.8, 2)], "qid string, doc string, path string, score double, place int")
    found = fusion.neighbours(chosen, chunks, 5)
    added = {(r.doc, r.parent) for r in found.where("parent IS NOT NULL").collect()}
    assert added == {("f3", 0), ("f0", 1)}
    assert fusion.neighbours(chosen, chunks, 3).where("parent IS NOT NULL").count() == 0


def test_rerank_falls_back(spark):
    rows = [("q", f"d{i:02}", "f", 0.02, i) for i in range(30)]
    short = spark.createDataFrame(rows, "qid string, doc string, path string, score double, place int")
    none = retrieval.rerank(short, lambda r: r.limit(0).select("qid", "doc", F.lit(1.0).alias("rerank_score")), 12)
    assert [r.doc for r in none.orderBy("rank").collect()] == [f"d{i:02}" for i in range(12)]
    some = retrieval.rerank(short, lambda r: r.where("place = 19").select("qid", "doc", F.lit(9.0).alias("rerank_score")), 12).orderBy("rank").collect()
    assert [(r.doc, r.rerank_score) for r in some[:3]] == [("d19", 9.0), ("d20", 2.0), ("d21", 2.0)]


def chunked(spark, content, path="notes.xyz", **limits):
    return chunking.chunks(spark.createDataFrame([(path, content)], "path string, content string"), **limits).orderBy("start_line").collect()


def test_line_windows(spark):
    flat = "\n".join(f"line {i}" for i in range(400))
    found = chunked(spark, flat, max_lines=30, overlap=5)
    assert all(r.end_line - r.start_line < 30 for r in found) and found[-1].end_line == 400
    assert len({r.chunk_id for r in found}) == len(found)
    seen = set()
    for r in found:
        seen.update(range(r.start_line, r.end_line + 1))
    assert seen == set(range(1, 401))
    old = chunked(spark, flat, max_lines=30, overlap=5, compat=True)
    assert max(r.end_line for r in old) == 399


def step_by_step(lines, start, end, most, overlap):
    """The windows one after the other, in plain Python."""
    step, out, at = max(1, most - overlap), [], start
    if end - start + 1 <= most:
        return [(start, end)]
    while at <= end:
        stop = min(at + most - 1, end)
        if stop < end:
            for i in range(stop, max(at + 5, stop - 12), -1):
                moved = i if not lines[i].strip() else max(at, i - 1) if not lines[i][0].isspace() else None
                if moved is not None:
                    stop = moved if moved >= at + step - 1 else stop
                    break
        out.append((at, stop))
        if stop >= end:
            break
        at += step
    return out


def test_windows_equal_a_loop(spark):
    import random

    rng = random.Random(4)
    cases = []
    for k in range(60):
        lines = [rng.choice(["", "  ", "x", "    y", "\tz", "word"]) for _ in range(rng.randint(1, 130))]
        cases.append((k, lines, rng.choice([20, 25, 40]), rng.choice([0, 5, 10])))
    for most in (20, 25, 40):
        for overlap in (0, 5, 10):
            own = [c for c in cases if c[2:] == (most, overlap)]
            if not own:
                continue
            frame = spark.createDataFrame([(k, lines) for k, lines, *_ in own], "k int, lines array<string>")
            found = {r.k: [(w["first"], w["last"]) for w in r.w] for r in frame.select("k", chunking.windows(F.col("lines"), F.lit(0), F.size("lines") - 1, most, overlap).alias("w")).collect()}
            for k, lines, *_ in own:
                assert found[k] == step_by_step(lines, 0, len(lines) - 1, most, overlap)


def test_sections_and_small_files(spark):
    md = "# Title\n" + "intro text that is long enough\n" + "## Install\nrun the installer and wait for it\n## Usage\ncall the function with care\n"
    found = chunked(spark, md, "README.md")
    assert {"Install", "Usage"} <= {r.symbol for r in found} and {r.kind for r in found} == {"documentation"}
    assert chunked(spark, "") == [] and chunked(spark, "x=1") == [] and chunked(spark, None) == []


def test_islands(spark):
    lines = ["a", "", "b", "", "", "", "", "c", "d", " "]
    frame = spark.createDataFrame([(lines, [8])], "l array<string>, c array<int>")
    assert [(s["first"], s["last"]) for s in frame.select(chunking.islands(F.col("l"), F.col("c")).alias("s")).first().s] == [(0, 2), (7, 7)]


def told(bracket):
    """A bracket's places by the rule, part by part: a place names its path for the lines after it, words end that."""
    path, out = None, []
    for part in bracket.split(","):
        place = re.fullmatch(r"\s*([^\s:]+\.\w+):([0-9]+)(?:\s*[-–]\s*([0-9]+))?\s*", part)
        lines = re.fullmatch(r"\s*([0-9]+)(?:\s*[-–]\s*([0-9]+))?\s*", part)
        path = place[1] if place else path if lines else None
        numbers = [int(n) for n in (place or lines).groups()[1 if place else 0 :] if n] if place or lines else []
        if path and numbers:
            out.append((path, min(numbers), max(numbers)))
    return out


def test_citations(spark):
    rows = fixtures.DRAFTS.frame(spark).select("draft", answers.citations(F.col("draft")).alias("c")).collect()
    assert len(rows) > 150
    for r in rows:
        want = [p for b in re.findall(r"\[([^\[\]]{3,400}?)\]", r.draft or "") for p in told(b)]
        assert [(c["path"], c["first"], c["last"]) for c in r.c or []] == want, r.draft


def test_suffix_resolution_prefers_the_shortest(spark):
    known = spark.createDataFrame([("src/x/a.py",), ("lib/a.py",), ("b/data.py",)], "path string")
    cited = spark.createDataFrame([("a.py",), ("x/a.py",), ("lib/a.py",), ("none.py",)], "path string")
    assert {r.path: r.resolved for r in answers.resolved(cited, known).collect()} == {"a.py": "lib/a.py", "x/a.py": "src/x/a.py", "lib/a.py": "lib/a.py", "none.py": None}


def test_confidence(spark):
    columns = ("base", "grounded", "complete", "citations", "overlap", "invalid", "errors")
    found = {r.key: r.c for r in fixtures.ANSWERS.frame(spark).select("key", answers.confidence(*map(F.col, columns)).alias("c")).collect()}
    assert (found[1], found[2], found[3]) == (0.97, 0.936, 0.515) and found[4] < found[2]


def test_confidence_rounds_the_double(spark):
    """0.5115 is a double just below that, as its thousandfold tells."""
    row = spark.createDataFrame([(0.55, True, True, 6, 0.25, 0, 0)], "base double, grounded boolean, complete boolean, citations int, overlap double, invalid int, errors int")
    assert row.select(answers.confidence(*map(F.col, row.columns)).alias("c")).first().c == 0.511


def metrics(spark, got, want):
    a = spark.createDataFrame([("c", i, p) for i, p in enumerate(got)], "case_id string, rank int, path string")
    b = spark.createDataFrame([("c", p) for p in want], "case_id string, path string")
    rows = evaluation.retrieval_metrics(a, b).collect()
    return rows[0] if rows else None


def test_retrieval_metrics(spark):
    r = metrics(spark, "ab", "ab")
    assert (r.recall, r.mrr) == (1.0, 1.0)
    r = metrics(spark, "xya", "a")
    assert (r.mrr, r.first_rank) == (0.333333, 3)
    assert metrics(spark, ["src/auth/jwt.py"], ["auth/jwt.py"]).hit
    assert metrics(spark, "aab", "a").retrieved == 2
    assert metrics(spark, "az", "a").ndcg > metrics(spark, "za", "a").ndcg
    r = metrics(spark, "", "a")
    assert (r.recall, r.precision, r.hit, r.retrieved) == (0.0, 0.0, False, 0)
    assert metrics(spark, "a", "") is None


def test_diff(spark):
    marked = diffs.marked(fixtures.DIFFS.frame(spark))
    found = {(r.diff_id, r.file_no): r for r in diffs.files(marked).collect()}
    assert [(found["git", i].path, found["git", i].is_new, found["git", i].is_deleted, found["git", i].is_binary) for i in (1, 2, 3)] == [("src/api.py", False, False, False), ("docs/guide.md", True, False, False), ("old.bin", False, True, True)]
    assert [found["plain", i].path for i in (1, 2)] == ["one.sql", "two.sql"]
    lines = diffs.diff_lines(marked)
    api = {(r.type, r.new_line): r.position for r in lines.where("diff_id = 'git' AND file_no = 1").collect()}
    assert {n for t, n in api if t == "added"} == {11, 12, 13, 14} and api["added", 11] == 3
    assert lines.where("diff_id = 'plain' AND content = '-- a comment that looks like a header' AND type = 'removed'").count() == 1


def test_pricing(spark):
    rows = {r.call_id: r for r in usage.priced(fixtures.CALLS.frame(spark), usage.prices(spark)).collect()}
    assert (rows[1].price_in, rows[2].price_in, rows[2].cost, rows[5].cost) == (0.075, 0.10, 0.1004, 0.5)


def test_paths(spark):
    names = {"auth/jwt.py": "python", "README.md": "markdown", "Dockerfile": "dockerfile", "README": "markdown", "LICENSE.txt": "text", "x/readme.unknown": "markdown", "a.unknown": "text", ".gitignore": "text"}
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.language(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in rows} == names


def test_scan(spark, tmp_path):
    for name, body in {"auth/jwt.py": b"class A:\n    pass\n", "web/app.js": b"x();\n", "README.md": b"# Sample\n", "package-lock.json": b"{}", "node_modules/junk/index.js": b"1", "logo.png": b"\x89\0", "gen/skip.py": b"1\n", "bad.txt": b"a\0b", "empty.py": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = files.judged(files.decoded(files.scan(spark, f"file://{tmp_path}")), ["gen/"])
    reasons = {r.path: r.skip_reason for r in rows.collect()}
    assert reasons == {"auth/jwt.py": None, "web/app.js": None, "README.md": None, "package-lock.json": "lockfile", "logo.png": "binary_suffix", "gen/skip.py": "ignored", "bad.txt": "binary", "empty.py": "too_large"}
    assert files.chosen(rows, 2).count() == 2


def test_cases(spark, tmp_path):
    case = {"id": "a", "question": "q?", "expected_paths": ["x.py"]}
    (tmp_path / "c.jsonl").write_text("// note\n\n# more\n" + json.dumps(case) + "\n")
    row = files.cases(spark, str(tmp_path / "c.jsonl")).first()
    assert (row.id, row.expected_paths, row.must_mention) == ("a", ["x.py"], None)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    held = lexical.build(lexical.tokenised(docs))
    chunks = docs.select(F.col("doc_id").alias("path"), F.lit("text").alias("language"), "text")
    where = f"file://{tmp_path}/one"
    index.save(spark, where, "one", "abcdef0123", chunks=chunks, postings=held.postings, corpus=held.corpus)
    back = index.load(spark, where)
    assert back["postings"].count() == held.postings.count() and set(back) == {"chunks", "postings", "corpus"}
    (tmp_path / "junk").mkdir()
    assert [(r.index_id, r.commit) for r in index.catalogue(spark, f"file://{tmp_path}").collect()] == [("one", "abcdef01")]
    with pytest.raises(KeyError, match="one"):
        index.load_by_name(spark, f"file://{tmp_path}", "two")
    assert index.delete(spark, where) and not index.delete(spark, where)
    with pytest.raises(FileNotFoundError):
        index.load(spark, where)


def test_quota(spark):
    rows = [(i, 1, float(s)) for i, s in enumerate([0, 1, 2, 3, 100, 101])] + [(10, 2, 0.0), (11, 2, 0.0)]
    asked = spark.createDataFrame(rows, "event_id long, visitor long, second double")
    found = {r.event_id: (r.allowed, r.retry_after) for r in quota.visitor_quota(asked, 3, 100).collect()}
    assert found == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (False, 97), 4: (False, 1), 5: (True, 0), 10: (True, 0), 11: (True, 0)}
    assert quota.visitor_quota(asked.limit(0), 3, 100).count() == 0


def test_bucket_capacity(spark):
    rows = [(1, 1, 0.0, 999.0), (2, 1, 0.0, 1.0), (3, 1, 60.0, 20.0)]
    asked = spark.createDataFrame(rows, "event_id long, visitor long, second double, amount double")
    assert [r.taken for r in quota.token_bucket(asked, 100).orderBy("event_id").collect()] == [True, False, True]


def test_streams(spark, smallest, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{smallest}/events.parquet")
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    started = quota.stream_quota(quota.requests(stream), 5, 86_400).writeStream.format("memory").queryName("decisions").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    started.awaitTermination(120)
    key = ["event_id", "allowed", "remaining", "retry_after"]
    assert sorted(spark.table("decisions").select(*key).collect()) == sorted(quota.visitor_quota(quota.requests(events), 5, 86_400).select(*key).collect())
    spans = quota.stream_spans(stream).writeStream.format("memory").queryName("spans").outputMode("complete").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    spans.awaitTermination(120)
    assert spark.table("spans").agg(F.sum("n")).first()[0] == events.count()


def test_repo_map(spark):
    rows = spark.createDataFrame([("src/a.py", "x\ny\n"), ("src/b.py", "x\n"), ("top.py", "z\n")], "path string, content string")
    chunks = spark.createDataFrame([("src/a.py", "Thing", "class", 1), ("src/a.py", "go", "function", 2)], "path string, symbol string, kind string, start_line int")
    found = chunking.repo_map(rows, chunks).first().map
    assert found.startswith("REPOSITORY MAP  |  3 files, 4 lines, 2 indexed chunks") and "src/\n  a.py (2 lines)  -> Thing, go\n  b.py (1 lines)" in found


def test_retry_and_waterfall(spark):
    frame = spark.createDataFrame([("t", "a", None, 1), ("t", "b", "a", 2), ("t", "c", "b", 3), ("t", "d", "lost", 0)], "trace string, span_id string, parent_id string, start int")
    assert {r.span_id: (r.depth, r.place) for r in usage.waterfall(frame).collect()} == {"a": (0, 2), "b": (1, 3), "c": (2, 4), "d": (0, 1)}
    assert spark.range(1).select(usage.retry_delay(F.lit(9), F.lit(True), F.lit(None).cast("double")).alias("d")).first().d == 90.0


def test_partitions_of_a_diff_grow_with_its_scan(spark):
    from pergola.operators import diffs

    rows = spark.createDataFrame([(f"d{i}", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n") for i in range(40)], "diff_id string, text string").repartition(5)
    lines = diffs.marked(rows)
    assert lines.rdd.getNumPartitions() == 5 * diffs.PARTS and lines.count() == 40 * 5


def test_lines_of_a_diff_are_sorted_once(spark):
    from pergola.operators import diffs

    lines = diffs.marked(fixtures.DIFFS.frame(spark))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(lines).count("Sort [") == 1
    # Of a file only the lines that tell something of it are sorted again.
    few = diffs.marked(spark.createDataFrame([("d", "x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n")], "diff_id string, text string"))
    assert [(r.path, r.hunks) for r in diffs.files(few).collect()] == [("x", 1)]
    assert [(r.type, r.old_line, r.new_line, r.position) for r in diffs.diff_lines(few).orderBy("position").collect()] == [("removed", 1, None, 1), ("added", None, 1, 2), ("added", None, 2, 3)]
