"""A corpus from raw documents to token ids: language, near duplicates, benchmark passages, personal data, encoding."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm import bpe_codec, decontaminate, jaccard_join, language_id, pii
from pergola.llm._arrow import key_filter, map_slices, passes, spread, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
#: The least share of the best language; documents without a letter have none.
LEAST_LANGUAGE_SCORE = 0.5
#: Words of a shingle, and the least similarity of near duplicates in percent.
WIDTH = 5
LEAST = 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with LEAST_LANGUAGE_SCORE or more; those without a letter, null and empty ones go; an empty table gives no rows."""
    model = language_id.train(docs.where(language_id.remainder("doc_id", 4) != 2))
    return language_id.predict(docs, model, keep=REST).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id, of rows equal in doc_id and text one; rows without an id stay.

    Documents are linked by 80 % or more of their five-word shingles, as is usual for such a stage; op6's contract has its own numbers. Null and empty
    texts link with nothing and stay; an empty table gives no rows.

    Only rows that a fixed-size filter of the ids to be dropped lets through are joined with those ids; all others pass without a shuffle.
    """
    found = written(jaccard_join.join(docs, width=WIDTH, least=LEAST).where("doc_id IS NOT NULL"))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("component_id") == F.col("doc_id")).alias("stays"))
    odd = written(ids.where("rows > 1 OR NOT stays").select("doc_id", "stays"))
    sent = spark.sparkContext.broadcast(key_filter(odd.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h")), "h"))
    rows = spread(docs.select(*COLUMNS))
    schema = T.StructType([*rows.schema.fields, T.StructField("odd", T.BooleanType())])

    def make():
        held = np.frombuffer(sent.value, np.uint8)

        def step(part):
            names = [b"" if i is None else str(i).encode() for i in part.column("doc_id").to_pylist()]
            return [*(part.column(c) for c in COLUMNS), passes(held, np.array([xxhash.xxh64_intdigest(n, 42) for n in names], np.uint64)).tolist()]

        return step

    marked = map_slices(rows, make, schema)
    maybe = marked.where("odd").drop("odd").join(odd.where("NOT stays").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return marked.where("NOT odd").select(*COLUMNS).unionByName(maybe)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in passages of the benchmark. Null and empty texts stay; repeated rows are judged each; an empty table gives no rows."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=REST)
    return found.where("NOT contaminated").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in square brackets; n_chars follows the text where that changed. Null and empty texts stay as they are; repeated rows stay."""
    found = pii.find(docs.select(*COLUMNS), pii.train(docs), keep=("lang", "source", "n_chars"))
    clean = pii.redacted(found.withColumn("n_chars", F.when(F.size("found") > 0, F.lit(None)).otherwise(F.col("n_chars"))), keep=("lang", "source", "n_chars", "found"))
    return clean.select("doc_id", "text", "lang", "source", F.when(F.size("found") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the digests of the ids and of the text they decode to. Null and empty texts have no ids; repeated rows give a row each."""
    decoded = bpe_codec.encode(docs, decoded=True)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark_passages),
    ("pii", personal_data),
    ("bpe_codec", token_ids),
]

#: Learnt models, components and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
