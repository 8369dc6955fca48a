"""The queries of this subpackage by name, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergola.llm import bpe_codec, decontaminate, fim, jaccard_join, language_id, lm_score, minhash, pii, quality_rules, substring_dedup, token_counts, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = language_id.remainder("doc_id", 3)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(third == 1, F.lit(False)))
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(third != 1))
    return toxicity.score(docs, model, keep=("held_out",))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = language_id.remainder("doc_id", 10)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(tenth == 0, F.lit(False)))
    model = lm_score.train(docs.where(tenth != 0))
    return lm_score.score(docs, model, keep=("held_out",))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode(_read(spark, sf_dir, "documents"), decoded=True))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(language_id.remainder("doc_id", 4) == 2, F.lit(False)))
    model = language_id.train(docs.where(language_id.remainder("doc_id", 4) != 2))
    return language_id.predict(docs, model, keep=("held_out",))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_read(spark, sf_dir, "documents")).drop("ranges")


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(_read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(_read(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_counts, op2_toxicity, op3_lm_score, op4_quality_rules, op5_decontaminate, op6_jaccard_join, op7_bpe_codec, op8_pii, op9_language_id,
        op10_substring_dedup, op11_minhash_dedup, op12_fill_in_middle, op13_whitening,
    )
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "[^\\x20\\x09-\\x0D]+"
_ITEM_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_OP5 = f"""WITH iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + 12], ' '))) AS win FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM documents),
own AS (SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' ')) AS l FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
places AS (SELECT doc_id, n, unnest(l) AS win, unnest(range(len(l))) AS i FROM own),
hits AS (SELECT doc_id, a.n, i, item FROM places a JOIN wins USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hits, range(13) AS r(o) WHERE o < n GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""



def _components(least: int, more: str = "") -> str:
    return f"""WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM dw),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= {least} * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, other FROM reach JOIN both_ways ON x = doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id{more} FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


_OP10 = f"""WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
wins AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' '))) AS h FROM dw WHERE len(w) >= 50),
each AS (SELECT doc_id, unnest(h) AS h, unnest(range(len(h))) AS i FROM wins),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM each) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM late, range(50) AS r(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_UNITS = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
_DRAWS = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))

_OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u, sha256('42:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, {_DRAWS} FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that need no tokenizer and no trained model; the others are held against brute force in tests/llm."""
    return {
        "op5_decontaminate": _OP5,
        "op6_jaccard_join": _components(85),
        "op10_substring_dedup": _OP10,
        "op11_minhash_dedup": _components(80, ", doc_id = component_id AS kept"),
        "op12_fill_in_middle": _OP12,
    }
