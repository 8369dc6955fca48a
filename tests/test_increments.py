"""An index brought up to date against one made anew."""

import random

import pytest
from pyspark.sql import functions as F

from pergola.operators import increments, lexical
from pergola.sources import versions


def texts(rng, n):
    return {i: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 30))) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame(list(held.items()), "doc_id long, text string").repartition(3)


def same(spark, index, held):
    made = lexical.build(lexical.tokenised(frame(spark, held)))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(index.postings, "term", "doc", "tf", "dl") == rows(made.postings, "term", "doc", "tf", "dl")
    assert rows(index.terms, "term", "df") == rows(made.terms, "term", "df")
    a, b = index.corpus.first(), made.corpus.first()
    assert a.n == b.n and a.avgdl == pytest.approx(b.avgdl, rel=1e-12)


def test_updates_equal_an_index_made_anew(spark, tmp_path):
    rng = random.Random(3)
    held = texts(rng, 300) | {900: None, 901: ""}
    own = increments.Increments(spark, f"file://{tmp_path}/i")
    first = own.update(frame(spark, held))
    assert (first.version, first.added, first.unchanged) == (1, 302, 0)
    before = dict(held)
    held |= {5: "another text", 6: None, 900: "now there is one", 1000: "new w1 w2", 1001: ""}
    del held[7], held[8]
    second = own.update(frame(spark, held))
    assert (second.added, second.changed, second.removed, second.unchanged) == (2, 3, 2, 297)
    same(spark, own.index(), held)
    same(spark, own.index(1), before)
    _, manifest = versions.read(spark, own.path)
    newest = spark.read.parquet(f"{own.path}/{manifest['segments'][-1]}")
    assert {r.doc for r in newest.select("doc").distinct().collect()} == {5, 900, 1000}, "only what changed was tokenised"
    third = own.update(frame(spark, held))
    assert (third.unchanged, third.added + third.changed + third.removed) == (302 + 2 - 2, 0) and len(versions.read(spark, own.path)[1]["segments"]) == 2
    own.compact()
    assert len(versions.read(spark, own.path)[1]["segments"]) == 1
    same(spark, own.index(), held)
    own.update(frame(spark, before), segments=1)
    assert len(versions.read(spark, own.path)[1]["segments"]) == 1
    same(spark, own.index(), before)
    terms = lexical.query_terms(spark.createDataFrame([(1, "w1 w2 w3")], "qid int, text string"))
    made = lexical.build(lexical.tokenised(frame(spark, before)))
    assert lexical.best(own.index(), terms, 5).orderBy("rank").select("doc", "score").collect() == lexical.best(made, terms, 5).orderBy("rank").select("doc", "score").collect()


def test_emptied_and_unknown(spark, tmp_path):
    own = increments.Increments(spark, f"file://{tmp_path}/i")
    with pytest.raises(FileNotFoundError):
        own.index()
    own.update(frame(spark, {1: "a word"}))
    gone = own.update(frame(spark, {1: "a word"}).limit(0))
    assert gone.removed == 1 and own.index().postings.count() == 0 and own.index().terms.count() == 0
    assert tuple(own.index().corpus.first()) == (0, 1.0)
    assert own.update(frame(spark, {2: "back again"})).added == 1 and own.index().terms.where(F.col("df") != 1).count() == 0


def test_terms_stay_where_they_are(spark, tmp_path):
    """A segment whose documents are all alive is read as it is; else the few dead are left out without a shuffle of terms."""
    held = increments.Increments(spark, f"file://{tmp_path}/moved")
    texts = {i: f"some words of number{i}" for i in range(40)}
    held.update(frame(spark, texts))
    plan = lambda: held.index().vectors._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan()
    held.update(frame(spark, {**texts, 3: "another text"}))
    assert "Exchange hash" not in plan() and held.index().vectors.count() == 40
    held.compact()
    assert "Join" not in plan() and held.index().vectors.count() == 40
