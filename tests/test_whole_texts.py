"""Queries over texts of more than 4,000 tokens: what only the end of a text says is found, and the SQL says the same."""

import shutil

import pytest
from oracle import TABLES, duck_rows, spark_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from pergola.plans import catalog

LONG = 4100


@pytest.fixture(scope="module")
def ends(spark, smallest, tmp_path_factory):
    """The smallest tables, but for sixty documents, of which 0 and 7 end with a word that is document 9 and a benchmark item; vectors are those of every fiftieth document."""
    where = tmp_path_factory.mktemp("ends")
    for t in set(TABLES) - {"documents", "benchmark", "embeddings"}:
        shutil.copy(f"{smallest}/{t}.parquet", where)
    words = {i: [f"{'ab'[i // 7]}word{n}" for n in range(LONG)] + ["tailword"] for i in (0, 7)} | {9: ["tailword"]}
    docs = [(i, " ".join(words.get(i, [f"own{i}"])), "en", f"src{i}", 1) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{where}/documents.parquet/")
    first = F.min("item_id").over(Window.partitionBy())
    items = spark.read.parquet(f"{smallest}/benchmark.parquet").withColumn("first", first).where("item_id = first").drop("first")
    items.withColumn("text", F.lit("tailword")).coalesce(1).write.parquet(f"{where}/benchmark.parquet/")
    spark.read.parquet(f"{smallest}/embeddings.parquet").where("vec_id % 50 = 0").coalesce(1).write.parquet(f"{where}/embeddings.parquet/")
    return str(where)


#: What a query's rows say of the ends of texts.
SAID = {
    "bm25_term_stats": lambda rows: [r.df for r in rows if r.term == "tailword"] == [3] and len(rows) == 57 + 2 * LONG + 1,
    "csr_offsets": lambda rows: [r.past - r.first for r in rows if r.term == "tailword"] == [3] and max(r.past for r in rows) == 57 + 2 * LONG + 3,
    "incremental_term_stats": lambda rows: [r.df for r in rows if r.term == "tailword"] == [3] and len(rows) == 57 + 2 * LONG + 1,
    "incremental_topk": lambda rows: {r.doc_id for r in rows} == {0, 7, 9},
    "index_build": lambda rows: [(r.n, r.postings, r.terms) for r in rows] == [(60, 57 + 2 * LONG + 3, 57 + 2 * LONG + 1)],
    "lexical_topk": lambda rows: {r.doc_id for r in rows} == {0, 7, 9},
    "rrf_fusion": lambda rows: {r.doc_id for r in rows if r.qid == 0 and r.lexical_rank is not None} == {0, 7, 9},
    "diversify_topk": lambda rows: {r.doc_id for r in rows if r.qid == 0} == {0, 7, 9, 50},
}


@pytest.mark.parametrize("name", SAID)
def test_ends_of_long_texts_count(spark, ends, name):
    found = catalog.QUERIES[name](spark, ends)
    assert SAID[name](found.collect())
    assert spark_rows(found) == duck_rows(catalog.SQL[name], ends)
