"""Bounded ranking over blocks of postings, neighbours over tiles of vectors, versions of a vector store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pergola.operators import lexical, vectors


def corpus(rng, n):
    """Documents of a few common words, some of middling frequency and rare ones, of any length."""
    rows = []
    for i in range(n):
        words = [rng.choice(["common", "usual", "frequent"]) if rng.random() < 0.5 else f"mid{rng.randrange(40)}" if rng.random() < 0.6 else f"rare{rng.randrange(3 * n)}" for _ in range(rng.choice([3, 20, 80]))]
        rows.append((i, " ".join(words)))
    return rows


def ranked(found):
    return sorted((r.qid, r["rank"], r.doc, r.score) for r in found.collect())


@pytest.fixture(scope="module")
def index(spark):
    rows = corpus(random.Random(4), 1500)
    held = lexical.build(lexical.tokenised(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    return held, rows


def test_blocks_hold_all_postings_by_impact(spark, index):
    held, _ = index
    cut = lexical.blocked(held.postings, held.corpus, 16)
    assert cut.where((F.size("docs") > 16) | (F.size("docs") != F.size("impacts")) | (F.col("most") != F.array_max("impacts")) | (F.col("salt") != F.col("place") % lexical.SALTS)).count() == 0
    each = cut.select("term", F.explode("docs").alias("doc"))
    assert each.count() == held.postings.count() and each.exceptAll(held.postings.select("term", "doc")).count() == 0
    assert cut.where("term = 'common'").count() > 16 and cut.groupBy("term", "salt").count().agg(F.max("count")).first()[0] < 20
    assert held.terms.count() == held.postings.select("term").distinct().count()


@pytest.mark.parametrize("k", [1, 5, 40])
def test_bounded_ranking_is_the_ranking(spark, index, k):
    held, rows = index
    rng = random.Random(k)
    asked = [(i, " ".join(rng.sample(rows[rng.randrange(len(rows))][1].split(), 3))) for i in range(30)] + [(40, "common"), (41, "absent"), (42, ""), (43, None), (44, rows[7][1]), (45, "common usual frequent mid1"), (46, "rare5 rare7")]
    terms = lexical.query_terms(spark.createDataFrame(asked, "qid int, text string"))
    assert ranked(lexical.best(held, terms, k)) == ranked(lexical.top(lexical.scores(held, terms), k))


def test_blocks_that_cannot_reach_the_bound_make_no_rows(spark, index):
    held, rows = index
    rare = next(t.split() for _, t in rows if sum(w.startswith("rare") for w in t.split()) > 2)
    query = " ".join([w for w in rare if w.startswith("rare")][:3] + ["common", "usual", "frequent"])
    terms = lexical.query_terms(spark.createDataFrame([(1, query)], "qid int, text string"))
    asked = lexical.weighted(held, terms)
    bounds = lexical.first_bounds(held, asked, 1)
    made = lexical.reached(held, asked, bounds).count()
    assert 0 < made < terms.join(held.postings, "term").count() / 20


def test_search_sends_no_more_than_the_best_of_a_task(spark, monkeypatch):
    """Documents are indexed without a shuffle, and what is shuffled of a search is k rows of a query and task; blocks of queries, small tiles and only common terms change nothing."""
    docs = spark.createDataFrame([(i, f"all some{i % 2} few{i % 50} " * (1 + i % 3)) for i in range(500)], "doc_id long, text string").repartition(2)
    assert "Exchange hash" not in lexical.counted(lexical.tokenised(docs).withColumn("dl", F.size("tokens").cast("long")))._jdf.queryExecution().toString()
    held = lexical.build(lexical.tokenised(docs))
    terms = lexical.query_terms(spark.createDataFrame([(1, "all"), (2, "all some1 few7"), (3, "few9 none"), (4, "none")], "qid int, text string"))
    want = ranked(lexical.top(lexical.scores(held, terms), 3))
    assert ranked(lexical.best(held, terms, 3)) == want == ranked(lexical.best(held, terms, 3, query_bytes=32))
    assert ranked(lexical.best(lexical.LexicalIndex(held.postings, held.corpus), terms, 3)) == want


def vector_rows(rng, n, d, clusters=8):
    centres = rng.normal(size=(clusters, d))
    rows = [(i, (centres[i % clusters] + 0.15 * rng.normal(size=d)).tolist()) for i in range(n)]
    return rows + [(n, [0.0] * d), (n + 1, rows[3][1]), (n + 2, None), (n + 3, [2 * x for x in rows[3][1]])]


def brute(rows, asked, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    out = []
    for q, v in asked:
        best = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in rows if w is not None)[:k]
        out += [(q, r, i, -s + 0.0) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_rows_passed_on_grow_with_the_index_and_the_result():
    for docs in (1000, 100_000, 10_000_000):
        parts, blocks = lexical.dealt(docs, 40, 200 * docs, 12)
        assert parts * docs * 40 <= max(50 * docs, 40 * docs) and parts * blocks >= 12 or docs == 1000
        assert docs * 40 <= blocks * lexical.KEPT_ROWS
    assert lexical.dealt(500, 10, 10_000_000, 12, 3) == (500, 3)


def test_a_search_of_few_parts_passes_on_few_rows(spark, index, monkeypatch):
    held, rows = index
    terms = lexical.query_terms(spark.createDataFrame(rows[::7], "qid long, text string"), "qid")
    monkeypatch.setattr(lexical, "HELD_ROWS", 100)
    monkeypatch.setattr(lexical, "top", lambda found, k: found)
    monkeypatch.setattr(lexical, "POSTINGS_A_ROW", 1000)
    found = lexical.best(held, terms, 4)
    assert found.count() <= 4 * len(rows[::7])
    monkeypatch.undo()
    assert ranked(lexical.top(found, 4)) == ranked(lexical.top(lexical.scores(held, terms), 4))


@pytest.mark.parametrize("query_bytes", [vectors.QUERY_BYTES, 4000])
def test_neighbours_over_tiles_equal_brute_force(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(vectors, "STEP", 64)
    monkeypatch.setattr(vectors, "HELD_ROWS", 500)
    rng = np.random.default_rng(5)
    rows = vector_rows(rng, 600, 6)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [(i, v) for i, v in rows[::7] if v is not None] + [(9000, [0.0] * 6)]
    questions = spark.createDataFrame(asked, "qid long, embedding array<double>")
    want = brute(rows, asked, 9)
    tiles, known = vectors.tiled(frame, 20)
    assert tiles.where("tile = -1").count() == 1 and tiles.count() == len(rows) - 1 and known.radii.max() > 0
    for found in (vectors.nearest(frame, questions, 9, query_bytes=query_bytes), vectors.nearest(tiles, questions, 9, known=known, query_bytes=query_bytes)):
        got = sorted((r.qid, r["rank"], r.doc, r.score + 0.0) for r in found.collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(a[2] == b[2] and abs(a[3] - b[3]) < 2e-6 or abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))


def test_tiles_out_of_reach_are_passed_over(spark, monkeypatch):
    """A tile whose vectors can't reach the bound is not multiplied: its vectors are swapped for ones that would win."""
    rows = [(i, [1.0, i / 1000, 0.0]) for i in range(50)] + [(100 + i, [0.0, i / 1000, 1.0]) for i in range(50)]
    tiles, known = vectors.tiled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1000)
    far = tiles.withColumn("embedding", F.when(F.col("vec_id") >= 100, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.col("embedding")))
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, embedding array<double>")
    assert {r.doc for r in vectors.nearest(far, asked, 3, known=known).collect()} == {0, 1, 2}


def test_reach_is_of_one_tile():
    """What a task holds is a figure a query, not one for each query and tile."""
    way = vectors.Pivots(np.eye(2), np.array([np.pi / 6, 0.0]))
    found = vectors._reach(np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]), way, 0)
    assert found.shape == (3,) and found == pytest.approx([1.0, 0.5, 1.0])


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, embedding array<double>")


def test_store_saved_over_its_own_folder(spark, tmp_path):
    where = f"file://{tmp_path}/v"
    first = vectors.VectorStore(rows_of(spark, ("a", [1.0, 0.0]), ("b", [0.0, 1.0]))).save(where)
    reader = vectors.VectorStore.load(spark, where)
    second = first.add(rows_of(spark, ("b", [1.0, 1.0]), ("c", [0.0, -1.0]))).save(where)
    assert (reader.version, second.version) == (1, 2) and (len(reader), len(second), len(first)) == (2, 3, 2)
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "qid string, embedding array<double>")
    assert reader.search(asked, 1).first().doc == "b" and vectors.VectorStore.load(spark, where).version == 2
    assert second.search(asked, 1).first().score == pytest.approx(0.707107)
    assert len(vectors.VectorStore.load(spark, where, 1)) == 2
    with pytest.raises(ValueError, match="dimensions"):
        second.add(rows_of(spark, ("d", [1.0, 2.0, 3.0])))
    with pytest.raises(ValueError, match="dimensions"):
        vectors.VectorStore(rows_of(spark)).add(rows_of(spark, ("d", [1.0, 2.0, 3.0]), ("e", [1.0])))
    with pytest.raises(FileNotFoundError):
        vectors.VectorStore.load(spark, f"{where}x")
    with pytest.raises(FileNotFoundError):
        vectors.VectorStore.load(spark, where, 9)


def test_table_without_its_file_is_no_version(spark, tmp_path):
    where = f"file://{tmp_path}/v"
    vectors.VectorStore(rows_of(spark, ("a", [1.0, 0.0]))).save(where)
    rows_of(spark, ("z", [1.0, 0.0])).write.parquet(f"{where}/v00000002-left")
    assert vectors.VectorStore.load(spark, where).version == 1


def test_texts_are_counted_as_their_tokens(spark):
    """Words are told apart in slices of texts, not by expressions over each of a row's words; compound words, the cap and odd texts count as they did."""
    odd = ["openHarborByID drain_queue sha256Hash", "KKelvin İstanbul aB", " ".join(f"w{i}_x" for i in range(4100)), " ".join(f"w{i}_x" if i % 3 else f"plain{i}" for i in range(4100)), "éa_b c", "____x9Y __", "HTTPServer2Go A1B2 Ab the THE_", "\x00a\x00bc", "tail9"]
    docs = spark.createDataFrame(list(enumerate([None, "", " ", "x", *odd, " ".join(f"ww{i % 9}" for i in range(5000))])), "doc_id long, text string").repartition(2)
    found = lexical.counted_texts(docs)
    assert "split(" not in found._jdf.queryExecution().toString()
    want = lexical.counted(lexical.tokenised(docs).withColumn("dl", F.greatest(F.size("tokens"), F.lit(1)).cast("long")))
    rows = lambda held: sorted((r.doc, r.dl, sorted(zip(r.terms, r.tfs))) for r in held.collect())
    assert rows(found) == rows(want)


def test_a_file_of_many_terms_numbers_them(spark):
    import random

    import pyarrow.parquet as pq

    rng = random.Random(3)
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(8))
    texts = [" ".join(word(rng.randrange(200_000)) for _ in range(2000)) for _ in range(400)]
    held = lexical.build_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    columns = [g.column(k) for f in held.vectors.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups)) for k in range(m.num_columns)]
    assert sum(c.total_uncompressed_size for c in columns if c.path_in_schema.startswith("terms")) < 6_000_000
    assert held.terms.count() == len({w for t in texts for w in t.split()})


def test_queries_of_the_same_terms_are_searched_once(spark, index, monkeypatch):
    """Words that no document has don't tell queries apart, nor does their order; every query has its rows all the same."""
    held, rows = index
    asked = [(i, f"{'common mid1 rare5' if i % 2 else 'rare5 mid1 common'} absent{i}") for i in range(40)] + [(90, rows[7][1]), (91, "common")]
    terms = lexical.query_terms(spark.createDataFrame(asked, "qid int, text string"))
    sent, asked_of = [], lexical._asked
    monkeypatch.setattr(lexical, "_asked", lambda pairs: sent.append(pairs.num_rows) or asked_of(pairs))
    found = lexical.best(held, terms, 4)
    assert sum(sent) <= 3 + len(set(rows[7][1].split())) + 1
    assert ranked(found) == ranked(lexical.top(lexical.scores(held, terms), 4))


def test_tiles_that_cannot_reach_a_bound_are_passed_over(monkeypatch):
    """Of queries and documents of two vocabularies those of a kind meet; the best are those of all scores."""
    import pyarrow as pa

    from pergola.operators.best import Best

    rng = np.random.default_rng(5)
    side = lambda i: rng.choice(60, size=8, replace=False) + 60 * (i % 2)
    docs = [np.sort(side(i)) for i in range(600)]
    asked = {i: np.sort(side(i)) for i in range(50)} | {60: np.arange(120)}
    weight = 1 + rng.random(120)
    pairs = pa.table({"qid": [q for q, t in asked.items() for _ in t], "h": [int(h) for t in asked.values() for h in t], "idf": [float(weight[h]) for t in asked.values() for h in t]})
    part = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([8] * 600), pa.array([d.tolist() for d in docs]), pa.array([[1 + (i + j) % 3 for j in range(8)] for i in range(600)])], names=["doc", "dl", "hashes", "tfs"])
    for name, value in (("SCORED_DOCS", 64), ("ASKED", 7), ("DENSE_ROWS", 5)):
        monkeypatch.setattr(lexical, name, value)
    own, made, add = lexical._asked(pairs), [], np.bincount
    monkeypatch.setattr(lexical.np, "bincount", lambda x, weights=None, minlength=0: (made.append(minlength) if weights is not None else None) or add(x, weights=weights, minlength=minlength))
    best = Best(np.full(len(own.qids), -np.inf), 3, 0)
    lexical._tile(own, part, 8.0, best)
    found = best.cut()
    assert sum(made) < 0.7 * len(asked) * 600
    tf = lambda i, h: 1 + (i + int(np.searchsorted(docs[i], h))) % 3
    score = lambda q, i: round(sum(weight[h] * tf(i, h) * 2.5 / (tf(i, h) + 1.5) for h in np.intersect1d(asked[q], docs[i])), lexical.PLACES)
    want = sorted((q, -s, i) for q in asked for s, i in sorted(((score(q, i), i) for i in range(600)), key=lambda x: (-x[0], x[1]))[:3] if s > 0)
    rows = sorted((own.qids[q].as_py(), -s, d) for q, s, d in zip(*(found.column(c).to_pylist() for c in ("q", "score", "doc"))))
    assert [(q, d) for q, _, d in rows] == [(q, i) for q, _, i in want] and np.allclose([s for _, s, _ in rows], [s for _, s, _ in want], atol=2e-6)


def test_blocks_of_queries_are_tasks_of_their_own(spark, index, monkeypatch):
    """A union of parts of one partition each is one task for Spark, which would search all blocks one after the other."""
    held, rows = index
    terms = lexical.query_terms(spark.createDataFrame(rows[::7], "qid long, text string"), "qid")
    monkeypatch.setattr(lexical, "HELD_ROWS", 100)
    monkeypatch.setattr(lexical, "POSTINGS_A_ROW", 1000)
    tasks, write = [], lexical.materialise

    def counting(df, *args, **options):
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("written"))
        spark.sparkContext.setJobGroup("written", "")
        out = write(df, *args, **options)
        spark.sparkContext._jsc.clearJobGroup()
        tracker = spark.sparkContext.statusTracker()
        jobs = set(tracker.getJobIdsForGroup("written")) - before
        tasks.append(max((s.numTasks for j in jobs for i in tracker.getJobInfo(j).stageIds for s in [tracker.getStageInfo(i)] if s), default=0))
        return out

    monkeypatch.setattr(lexical, "materialise", counting)
    found = lexical.best(held, terms, 4)
    assert tasks[-1] == spark.sparkContext.defaultParallelism
    monkeypatch.undo()
    assert ranked(found) == ranked(lexical.top(lexical.scores(held, terms), 4))
