"""Every query of the library by name, with the DuckDB SQL that says the same independently where SQL can.

The common tables stand for what an index holds: a document is a chunk of a file named after its source, its text the content; a vector
belongs to the document whose id it has; events are spans, calls and requests; every fiftieth row is a query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergola.functions import paths, text
from pergola.operators import answers, chunking, diffs, evaluation, fusion, increments, lexical, retrieval, reviewing, usage, vectors
from pergola.plans import fixtures
from pergola.session import fingerprint, materialise, shared_folder, spread
from pergola.sources import files
from pergola.streaming import quota

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOP = 10
CANDIDATES = retrieval.CANDIDATES
LINES = 20
OVERLAP = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


PATH_SQL = "source || '/' || lang || '/doc_' || doc_id || '.txt'"


def _path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, doc_id: a file for each document."""
    return read(spark, sf_dir, "documents").select(_path().alias("path"), F.col("text").alias("content"), "doc_id")


def tokens_sql(name: str, table: str, key: str, column: str, most: int | None = text.TOKENS) -> str:
    """{name}(doc, term): a row for each token, of the whole text or up to and with the word that brings their number to `most`."""
    stop = _in(text.STOPWORDS)
    parts = "raw"
    for a, b in (("([a-z0-9])([A-Z])", 2), ("([A-Z])([A-Z][a-z])", 2)):
        parts = f"regexp_replace({parts}, '{a}', '\\1 \\2', 'g')"
    parts = f"replace({parts}, '_', ' ')"
    for a in ("([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        parts = f"regexp_replace({parts}, '{a}', '\\1 \\2', 'g')"
    return f"""{name}_w AS (
  SELECT doc, unnest(w) AS raw, unnest(range(len(w))) AS pos
  FROM (SELECT {key} AS doc, list_filter(string_split_regex(coalesce({column}, ''), '[^A-Za-z0-9_]+'), lambda x: x <> '') AS w FROM {table})
), {name}_e AS (
  SELECT doc, pos, list_concat(
    CASE WHEN length(raw) >= 2 AND lower(raw) NOT IN {stop} THEN [lower(raw)] ELSE [] END,
    CASE WHEN length(raw) > 3 AND (contains(raw, '_') OR regexp_matches(raw, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]'))
         THEN list_filter(string_split_regex(lower({parts}), ' +'), lambda t: length(t) >= 2 AND t NOT IN {stop}) ELSE [] END) AS toks
  FROM {name}_w
), """ + (
        f"{name} AS (SELECT doc, unnest(toks) AS term FROM {name}_e)"
        if most is None
        else f"""{name}_c AS (
  SELECT doc, toks, coalesce(sum(len(toks)) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_e
), {name} AS (SELECT doc, unnest(toks) AS term FROM {name}_c WHERE before < {most})"""
    )


def index_sql(most: int | None = text.TOKENS) -> str:
    return f"""{tokens_sql("tok", "documents", "doc_id", "text", most)},
tf AS (SELECT term, doc, count(*) AS tf FROM tok GROUP BY term, doc),
dl AS (SELECT doc_id AS doc, greatest(count(term), 1) AS dl FROM documents LEFT JOIN tok ON doc = doc_id GROUP BY doc_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


#: Of texts up to 4,000 tokens, and of whole ones.
INDEX_SQL = index_sql()
WHOLE_SQL = index_sql(None)


def scores_sql(name: str, terms: str, k: int) -> str:
    """{name}(qid, doc, score, rank) for the distinct (qid, term) rows of `terms`."""
    return f"""{name}_s AS (
  SELECT qid, tf.doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {terms} JOIN tf USING (term) JOIN dfs USING (term) JOIN dl ON dl.doc = tf.doc, corpus GROUP BY qid, tf.doc
), {name} AS (
  SELECT qid, doc, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1)::INTEGER AS rank FROM {name}_s WHERE score > 0
  QUALIFY rank < {k}
)"""


#: The index of each folder's documents that a session has built, by the files it was built from: an index is made once and searched many times.
_indexes: dict[tuple[str, str, int | None], lexical.LexicalIndex] = {}


def _index(spark: SparkSession, sf_dir: str, most: int | None = text.TOKENS) -> lexical.LexicalIndex:
    """most: where texts are cut; without it they are whole."""
    key = spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/documents.parquet"), most
    if key not in _indexes:
        _indexes[key] = lexical.build_texts(read(spark, sf_dir, "documents"), most=most)
    return _indexes[key]


@query(f"WITH {WHOLE_SQL} SELECT n, (SELECT count(*) FROM tf) AS postings, (SELECT count(*) FROM dfs) AS terms, round(avgdl, 6) AS avgdl FROM corpus")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenises and indexes all documents, whatever was built before."""
    made = lexical.build_texts(read(spark, sf_dir, "documents"))
    sizes = made.terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.count("*").alias("terms"))
    return made.corpus.crossJoin(sizes).select("n", "postings", "terms", F.round("avgdl", 6).alias("avgdl"))


@query(
    f"""WITH {WHOLE_SQL}, {tokens_sql("ask", "benchmark", "item_id", "text", None)}, terms AS (SELECT DISTINCT doc AS qid, term FROM ask),
{scores_sql("best", "terms", TOP)} SELECT qid AS item_id, rank, doc AS doc_id, score FROM best"""
)
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item by BM25."""
    terms = lexical.query_terms(read(spark, sf_dir, "benchmark"), "item_id")
    best = lexical.best(_index(spark, sf_dir, None), terms, TOP)
    return best.select(F.col("qid").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query(f"WITH {WHOLE_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, corpus")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, None).term_stats().select("term", "df", F.round("idf", 6).alias("idf"))


def _updated(spark: SparkSession, sf_dir: str) -> tuple[increments.Increments, increments.Update]:
    """An index of what the documents were, brought up to date: every 97th had another text, was not there yet, or has gone since."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    past = F.col("doc_id") % 97
    before = docs.where(past != 1).withColumn("text", F.when(past == 0, F.concat(F.lit("an older draft of "), "text")).otherwise(F.col("text")))
    before = before.unionByName(docs.where(past == 2).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    held = increments.Increments(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    held.update(before)
    return held, held.update(docs)


@query(f"WITH {WHOLE_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, corpus")
def incremental_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of an index that was brought up to date are those of one made anew."""
    return _updated(spark, sf_dir)[0].index().term_stats().select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH {WHOLE_SQL}, {tokens_sql("ask", "benchmark", "item_id", "text", None)}, terms AS (SELECT DISTINCT doc AS qid, term FROM ask),
{scores_sql("best", "terms", TOP)} SELECT qid AS item_id, rank, doc AS doc_id, score FROM best"""
)
def incremental_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of an index that was brought up to date, then made one segment."""
    held, _ = _updated(spark, sf_dir)
    held.compact()
    best = lexical.best(held.index(), lexical.query_terms(read(spark, sf_dir, "benchmark"), "item_id"), TOP)
    return best.select(F.col("qid").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query(
    """SELECT count(*) FILTER (WHERE doc_id % 97 = 1) AS added, count(*) FILTER (WHERE doc_id % 97 = 0 AND text IS NOT NULL) AS changed, count(*) FILTER (WHERE doc_id % 97 = 2) AS removed,
count(*) FILTER (WHERE doc_id % 97 > 1 OR (doc_id % 97 = 0 AND text IS NULL)) AS unchanged FROM documents"""
)
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents an update found new, changed, gone and as they were."""
    _, update = _updated(spark, sf_dir)
    return spark.createDataFrame([(update.added, update.changed, update.removed, update.unchanged)], "added long, changed long, removed long, unchanged long")


@query(f"WITH {tokens_sql('tok', 'documents', 'doc_id', 'text')} SELECT doc_id, count(term) AS n_tokens, count(DISTINCT term) AS n_distinct FROM documents LEFT JOIN tok ON doc = doc_id GROUP BY doc_id")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.tokenised(read(spark, sf_dir, "documents"), most=text.TOKENS)
    return rows.select(F.col("doc").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(f"WITH {WHOLE_SQL} SELECT term, (row_number() OVER (ORDER BY term) - 1) AS term_id, (sum(df) OVER (ORDER BY term) - df)::BIGINT AS first, (sum(df) OVER (ORDER BY term))::BIGINT AS past FROM dfs")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _index(spark, sf_dir, None)
    return lexical.csr_offsets(held.postings, held.terms)


def dense_sql(k: int) -> str:
    return f"""dense AS (
  SELECT q.vec_id AS qid, v.vec_id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
         (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) - 1)::INTEGER AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank < {k}
)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), k)


@query(f"WITH {dense_sql(TOP)} SELECT qid, rank, doc AS vec_id, score FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every fiftieth one."""
    return _dense(spark, sf_dir, TOP).select("qid", "rank", F.col("doc").alias("vec_id"), "score")


@query(f"WITH {dense_sql(6).replace('q.vec_id % 50 = 0', 'true')} SELECT qid, rank, doc AS vec_id, score FROM dense")
def dense_all_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest of all vectors for every one, over tiles, in one scan."""
    rows, known = vectors.tiled(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    asked = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.nearest(rows, asked, 6, known=known).select("qid", "rank", F.col("doc").alias("vec_id"), "score")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding)::INTEGER AS dims FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dims"))


def rankings_sql(index: str) -> str:
    return f"""{index}, asked AS (SELECT DISTINCT doc AS qid, term FROM tok WHERE doc % 50 = 0), {scores_sql("lex", "asked", CANDIDATES)}, {dense_sql(CANDIDATES)}"""


RANKINGS_SQL = rankings_sql(INDEX_SQL)
WHOLE_RANKINGS_SQL = rankings_sql(WHOLE_SQL)


def fused_sql(dense: bool = True, lex: bool = True, name: str = "fused") -> str:
    lists = []
    if dense:
        lists.append("SELECT qid, doc, rank, 'dense[0]' AS retriever, 1.0::DOUBLE AS w FROM dense")
    if lex:
        lists.append("SELECT qid, doc, rank, 'lexical[0]' AS retriever, 0.85::DOUBLE AS w FROM lex")
    return f"""{name}_r AS ({" UNION ALL ".join(lists)}), {name} AS (
  SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, agreement DESC, best_rank, doc) - 1)::INTEGER AS position FROM (
    SELECT qid, doc, round(sum(w / (60 + rank + 1)), 6) AS score, count(*)::INTEGER AS agreement, min(rank) AS best_rank,
           min(rank) FILTER (WHERE retriever LIKE 'dense%') AS dense_rank, min(rank) FILTER (WHERE retriever LIKE 'lexical%') AS lexical_rank
    FROM {name}_r GROUP BY qid, doc)
)"""


def _lists(spark: SparkSession, sf_dir: str, most: int | None = text.TOKENS) -> tuple[DataFrame, DataFrame]:
    """Both rankings, written down: what follows reads them more than once. most: see _index()."""
    docs = read(spark, sf_dir, "documents")
    terms = lexical.query_terms(docs.where("doc_id % 50 = 0"), "doc_id", most=most)
    return materialise(_dense(spark, sf_dir, CANDIDATES)), materialise(lexical.best(_index(spark, sf_dir, most), terms, CANDIDATES))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, path, start: each document as a chunk of its source's file, in order of its id."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("path"), F.col("doc_id").alias("start"))


@query(f"WITH {WHOLE_RANKINGS_SQL}, {fused_sql()} SELECT qid, doc AS doc_id, score, agreement, best_rank, dense_rank, lexical_rank, position FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(retrieval.ranked_lists(*_lists(spark, sf_dir, None)))
    return fused.select("qid", F.col("doc").alias("doc_id"), "score", "agreement", "best_rank", "dense_rank", "lexical_rank", "position")


@query(
    f"""WITH {RANKINGS_SQL}, {fused_sql()} SELECT qid, doc AS doc_id, concat_ws(' + ', 'dense#' || (dense_rank + 1), 'bm25#' || (lexical_rank + 1)) AS provenance FROM fused"""
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(retrieval.ranked_lists(*_lists(spark, sf_dir)))
    return fused.select("qid", F.col("doc").alias("doc_id"), text.provenance(F.col("dense_rank"), F.col("lexical_rank"), F.lit(None).cast("double")).alias("provenance"))


HINTS = ("/SRC0/", "src1", "")
BOOSTED = "CASE WHEN contains(lower(source), 'src0') OR contains(lower(source), 'src1') THEN score * 1.25 ELSE score END"


@query(f"WITH {RANKINGS_SQL}, {fused_sql()} SELECT qid, doc AS doc_id, source AS path, round({BOOSTED}, 8) AS score FROM fused JOIN documents ON doc = doc_id")
def path_hint_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(retrieval.ranked_lists(*_lists(spark, sf_dir))).join(_chunks(spark, sf_dir), "doc")
    return fused.select("qid", F.col("doc").alias("doc_id"), "path", F.round(fusion.hinted(F.col("path"), F.col("score"), F.array(*map(F.lit, HINTS))), 8).alias("score"))


def short_sql(hints: bool = False, source: str = "fused", name: str = "short") -> str:
    score = f"round({BOOSTED}, 8)" if hints else "score"
    return f"""{name}_p AS (SELECT qid, doc, source AS path, {score} AS score, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, position) - 1 AS position FROM {source} JOIN documents ON doc = doc_id),
{name}_m AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY position) > 4 AS over FROM {name}_p),
{name} AS (SELECT qid, doc, path, score, (row_number() OVER (PARTITION BY qid ORDER BY over, position) - 1)::INTEGER AS place FROM {name}_m QUALIFY place < 40)"""


@query(f"WITH {WHOLE_RANKINGS_SQL}, {fused_sql()}, {short_sql()} SELECT qid, doc AS doc_id, path, score, place FROM short")
def diversify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = retrieval.shortlist(retrieval.ranked_lists(*_lists(spark, sf_dir, None)), _chunks(spark, sf_dir))
    return short.select("qid", F.col("doc").alias("doc_id"), "path", "score", "place")


def neighbours_sql(chosen: str, limit: int = 16) -> str:
    return f"""files AS (SELECT doc_id AS doc, source AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS at FROM documents),
beside AS (SELECT c.qid, c.path, c.score, c.place, o.d, f.at + o.d AS at FROM {chosen} c JOIN files f USING (doc), (VALUES (-1), (1)) AS o(d)),
fresh AS (SELECT b.qid, f.doc, b.path, b.score, b.place FROM beside b JOIN files f ON f.path = b.path AND f.at = b.at
  WHERE NOT EXISTS (SELECT 1 FROM {chosen} c WHERE c.qid = b.qid AND c.doc = f.doc)
  QUALIFY row_number() OVER (PARTITION BY b.qid, f.doc ORDER BY b.place, b.d) = 1),
counted AS (SELECT fresh.*, (SELECT count(*) FROM fresh e WHERE e.qid = fresh.qid AND e.place < fresh.place) AS added, (SELECT count(*) FROM {chosen} c WHERE c.qid = fresh.qid) AS chosen FROM fresh),
expanded AS (SELECT qid, doc, path, score, NULL::INTEGER AS parent FROM {chosen} UNION ALL
  SELECT qid, doc, path, round(score * 0.35, 10), place::INTEGER FROM counted WHERE chosen + added < {limit})"""


@query(f"WITH {RANKINGS_SQL}, {fused_sql()}, {short_sql()}, chosen AS (SELECT * FROM short WHERE place < 12), {neighbours_sql('chosen')} SELECT qid, doc AS doc_id, path, score, parent FROM expanded")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    short = retrieval.shortlist(retrieval.ranked_lists(*_lists(spark, sf_dir)), chunks).where("place < 12")
    return fusion.neighbours(short, chunks, 16).select("qid", F.col("doc").alias("doc_id"), "path", "score", "parent")


HYBRID_RANK = "(row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent IS NOT NULL, doc) - 1)::INTEGER AS rank"


@query(
    f"WITH {RANKINGS_SQL}, {fused_sql()}, {short_sql(True)}, chosen AS (SELECT * FROM short WHERE place < 12), {neighbours_sql('chosen')} SELECT qid, doc AS doc_id, path, score, {HYBRID_RANK} FROM expanded"
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval: two rankings, fused, hinted, diversified, cut to twelve, with neighbours."""
    rows = retrieval.retrieve(retrieval.ranked_lists(*_lists(spark, sf_dir)), _chunks(spark, sf_dir), F.array(*map(F.lit, HINTS)))
    return rows.select("qid", F.col("doc").alias("doc_id"), "path", "score", "rank")


def rerank_sql(source: str = "short", name: str = "reranked") -> str:
    return f"""{name}_w AS (SELECT *, place // 20 AS win, count(*) OVER (PARTITION BY qid) > 12 AS many FROM {source}),
{name}_s AS (SELECT *, CASE WHEN many AND NOT (win = 1 AND qid % 100 = 50) AND doc % 7 <> 0 THEN round(doc % 11 / 1.1, 6) END AS given FROM {name}_w),
{name}_f AS (SELECT *, CASE WHEN max(given IS NOT NULL) OVER (PARTITION BY qid) THEN
  CASE WHEN max(given IS NOT NULL) OVER (PARTITION BY qid, win) THEN coalesce(given, 0.0) ELSE least(5.0, score * 100) END END AS rr FROM {name}_s),
{name} AS (SELECT qid, doc, path, round(rr, 6)::DOUBLE AS rerank_score, coalesce(round(rr, 6)::DOUBLE, score) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(rr, 6) DESC NULLS LAST, {name}_f.place) - 1)::INTEGER AS rank FROM {name}_f QUALIFY rank < 12)"""


def _stand_in(rows: DataFrame) -> DataFrame:
    """A scorer without a model: marks by id, leaves every seventh id out and fails for one window of some queries."""
    answered = rows.where(~((F.col("window") == 1) & (F.col("qid") % 100 == 50)) & (F.col("doc") % 7 != 0))
    return answered.select("qid", "doc", F.round(F.col("doc") % 11 / 1.1, 6).alias("rerank_score"))


@query(f"WITH {RANKINGS_SQL}, {fused_sql()}, {short_sql()}, {rerank_sql()} SELECT qid, doc AS doc_id, rerank_score, rank FROM reranked")
def rerank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = retrieval.shortlist(retrieval.ranked_lists(*_lists(spark, sf_dir)), _chunks(spark, sf_dir))
    return retrieval.rerank(short, _stand_in).select("qid", F.col("doc").alias("doc_id"), "rerank_score", "rank")


MERGE_SQL = """both_lists AS (SELECT qid, doc, score AS final_score, 0 AS round FROM dense WHERE rank < 25 UNION ALL SELECT qid, doc, round(score / 100, 8), 1 FROM lex WHERE rank < 25),
once AS (SELECT * FROM both_lists QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY final_score DESC, round) = 1)
SELECT qid, doc AS doc_id, final_score, round::INTEGER AS round, (row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, round, doc) - 1)::INTEGER AS rank FROM once QUALIFY rank < 30"""


@query(f"WITH {RANKINGS_SQL}, {MERGE_SQL}")
def refine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second round's results into the first's: the better score of each chunk, thirty at most."""
    dense, lex = _lists(spark, sf_dir)
    first = dense.where("rank < 25").select("qid", "doc", F.col("score").alias("final_score"))
    second = lex.where("rank < 25").select("qid", "doc", F.round(F.col("score") / 100, 8).alias("final_score"))
    return retrieval.merged(first, second).select("qid", F.col("doc").alias("doc_id"), "final_score", "round", "rank")


def metrics_sql(retrieved: str, expected: str, k: int | None = None) -> str:
    norm = lambda c: f"lower(replace(ltrim(trim({c}), './'), chr(92), '/'))"
    a, b = norm("r.path"), norm("e.path")
    cut = f"WHERE place <= {k}" if k else ""
    return f"""ranked AS (SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY min(rank), path) AS place FROM {retrieved} GROUP BY case_id, path),
cut AS (SELECT * FROM ranked {cut}), want AS (SELECT DISTINCT case_id, path FROM {expected}),
met AS (SELECT r.case_id, place, e.path AS want FROM cut r JOIN want e USING (case_id) WHERE {a} = {b} OR ends_with({a}, '/' || {b}) OR ends_with({b}, '/' || {a})),
rel AS (SELECT DISTINCT case_id, place FROM met),
m AS (SELECT e.case_id, e.expected, coalesce(r.retrieved, 0) AS retrieved, coalesce(x.matched, 0) AS matched, coalesce(g.hits, 0) AS hits, g.first_rank, coalesce(g.dcg, 0) AS dcg
  FROM (SELECT case_id, count(*) AS expected FROM want GROUP BY 1) e LEFT JOIN (SELECT case_id, count(*) AS retrieved FROM cut GROUP BY 1) r USING (case_id)
  LEFT JOIN (SELECT case_id, count(DISTINCT want) AS matched FROM met GROUP BY 1) x USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS hits, min(place) AS first_rank, sum(1 / log2(place + 1)) AS dcg FROM rel GROUP BY 1) g USING (case_id)),
metrics AS (SELECT case_id, round(matched / expected, 6) AS recall, round(CASE WHEN retrieved > 0 THEN hits / retrieved ELSE 0 END, 6) AS precision, round(coalesce(1 / first_rank, 0), 6) AS mrr,
  round(dcg / list_sum(list_transform(range(1, least(expected, greatest(retrieved, 1)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, matched > 0 AS hit, first_rank::INTEGER AS first_rank, retrieved, expected FROM m)"""


FOUND_SQL = "got AS (SELECT qid AS case_id, rank, './Label' || label || '/part' || (vec_id % 7) || '.txt' AS path FROM dense JOIN embeddings ON vec_id = doc), wanted AS (SELECT vec_id AS case_id, 'label' || label || '/part' || p || '.txt' AS path FROM embeddings, range(3) AS r(p) WHERE vec_id % 50 = 0)"
AVERAGES_SQL = "count(*) AS cases, round(avg(hit::INTEGER), 4) AS hit_rate, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(coalesce(avg(first_rank), 0), 2) AS mean_first_rank"


def _label_path(prefix: str, part: Column) -> Column:
    return F.concat(F.lit(prefix), F.col("label").cast("string"), F.lit("/part"), part.cast("string"), F.lit(".txt"))


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Retrieved and expected paths: vectors lie in files of their label, and three of a query's own label are what it should find."""
    rows = read(spark, sf_dir, "embeddings")
    got = _dense(spark, sf_dir, TOP).join(rows.withColumnRenamed("vec_id", "doc"), "doc").select(F.col("qid").alias("case_id"), "rank", _label_path("./Label", F.col("doc") % 7).alias("path"))
    wanted = rows.where("vec_id % 50 = 0").withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(F.col("vec_id").alias("case_id"), _label_path("label", F.col("p")).alias("path"))
    return got, wanted


@query(f"WITH {dense_sql(TOP)}, {FOUND_SQL}, {metrics_sql('got', 'wanted', 8)} SELECT * FROM metrics")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_metrics(*_cases(spark, sf_dir), k=8)


@query(f"WITH {dense_sql(TOP)}, {FOUND_SQL}, {metrics_sql('got', 'wanted', 8)} SELECT {AVERAGES_SQL} FROM metrics")
def ir_metrics_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.averages(evaluation.retrieval_metrics(*_cases(spark, sf_dir), k=8))


#: Name; whether it ranks densely, lexically; whether it reranks; whether it adds neighbours.
VARIANTS = (("dense only", True, False, False, False), ("lexical only", False, True, False, False), ("hybrid", True, True, False, False), ("hybrid + rerank", True, True, True, False), ("full pipeline", True, True, True, True))


def _ablation_sql() -> str:
    ctes, parts = [RANKINGS_SQL], []
    for i, (_, dense, lex, again, expand) in enumerate(VARIANTS):
        ctes += [fused_sql(dense, lex, f"f{i}"), short_sql(False, f"f{i}", f"s{i}")]
        if again:
            ctes += [rerank_sql(f"s{i}", f"r{i}"), f"c{i} AS (SELECT qid, doc, path, score, rank AS place FROM r{i})"]
        else:
            ctes.append(f"c{i} AS (SELECT * FROM s{i} WHERE place < 12)")
        if expand:
            ctes.append(neighbours_sql(f"c{i}"))
        rows = "expanded" if expand else f"(SELECT *, NULL::INTEGER AS parent FROM c{i})"
        parts.append(f"SELECT {i}::BIGINT * 1000000000 + qid AS case_id, path, {HYBRID_RANK} FROM {rows}")
    got = "got AS (" + " UNION ALL ".join(parts) + ")"
    wanted = f"wanted AS (SELECT i * 1000000000 + doc_id AS case_id, source AS path FROM documents, range({len(VARIANTS)}) AS r(i) WHERE doc_id % 50 = 0)"
    names = " ".join(f"WHEN {i} THEN '{v[0]}'" for i, v in enumerate(VARIANTS))
    return f"WITH {', '.join(ctes)}, {got}, {wanted}, {metrics_sql('got', 'wanted')} SELECT CASE case_id // 1000000000 {names} END AS variant, {AVERAGES_SQL} FROM metrics GROUP BY 1"


@query(_ablation_sql())
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of five ways to retrieve over the same cases; the rankings are shared. A query should find its own document's file."""
    dense, lex = _lists(spark, sf_dir)
    chunks = _chunks(spark, sf_dir)
    asked = read(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("source").alias("path"))
    got = wanted = None
    for i, (_, use_dense, use_lex, again, expand) in enumerate(VARIANTS):
        ranked = retrieval.ranked_lists(dense if use_dense else None, lex if use_lex else None)
        rows = retrieval.retrieve(ranked, chunks, expand=expand, scorer=_stand_in if again else None).select((F.lit(i).cast("long") * 1_000_000_000 + F.col("qid")).alias("case_id"), "rank", "path")
        cases = asked.select((F.lit(i).cast("long") * 1_000_000_000 + F.col("qid")).alias("case_id"), "path")
        got, wanted = (rows, cases) if got is None else (got.unionByName(rows), wanted.unionByName(cases))
    name = F.get(F.array(*(F.lit(v[0]) for v in VARIANTS)), F.floor(F.col("case_id") / 1_000_000_000).cast("int"))
    return evaluation.averages(evaluation.retrieval_metrics(got, wanted).withColumn("variant", name), "variant")


# Files and chunks


REASON_SQL = f"""CASE WHEN list_bool_or(list_transform(string_split(lower(path), '/')[:-2], lambda d: d IN {_in(paths.EXCLUDED_DIRS)} OR starts_with(d, '.git'))) THEN 'excluded_dir'
  WHEN regexp_extract(lower(path), '[^/]*$') IN {_in(paths.LOCKFILES)} THEN 'lockfile'
  WHEN regexp_matches(lower(path), '({"|".join(s.replace(".", "[.]") for s in paths.BINARY_SUFFIXES)})$') THEN 'binary_suffix'
  WHEN strlen(content) > 400000 OR strlen(content) = 0 THEN 'too_large'
  WHEN contains(left(content, 8192), chr(0)) THEN 'binary'
  WHEN length(content) / (length(content) - length(replace(content, chr(10), '')) + 1) > 400 THEN 'minified' END"""
ALL_FILES_SQL = f"files AS (SELECT {PATH_SQL} AS path, text AS content FROM documents UNION ALL SELECT regexp_replace(url, '^[a-z]+://', '') AS path, html AS content FROM pages)"


def _all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("content"))
    rows = _files(spark, sf_dir).select("path", "content").unionByName(pages)
    return rows.withColumn("size_bytes", F.octet_length("content"))


@query(f"WITH {ALL_FILES_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM files) GROUP BY 1")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents and pages would be left out of an index, the first reason that holds."""
    return files.skip_counts(files.judged(_all_files(spark, sf_dir)))


NAME_SQL = "regexp_extract(lower(path), '[^/]*$')"
SUFFIX_SQL = f"regexp_extract({NAME_SQL}, '^.+([.][^.]+)$', 1)"
STEM_SQL = f"regexp_replace({NAME_SQL}, '^(.+)[.][^.]+$', '\\1')"


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


KNOWN = paths.CODE_SUFFIXES | paths.OTHER_SUFFIXES
LANGUAGE_SQL = f"coalesce({_case(paths.SPECIAL_NAMES, NAME_SQL)}, CASE WHEN {SUFFIX_SQL} NOT IN {_in(KNOWN)} THEN {_case(paths.SPECIAL_NAMES, STEM_SQL)} END, {_case(KNOWN, SUFFIX_SQL)}, 'text')"
CODE_SQL = f"({SUFFIX_SQL} IN {_in(paths.CODE_SUFFIXES)} AND {NAME_SQL} NOT IN {_in(paths.SPECIAL_NAMES)})"
#: Names hung on pages in turn, so that every way to tell a language is met.
NAMES = ("index.html", "main.py", "README", "Dockerfile.dev", "app.test.ts", "lib/mod.rs", "docs/guide.md", "notes", ".gitignore", "setup.cfg", "License.txt", "gen/api_pb2.py")
NAMED_SQL = f"named AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '/' || list_extract([{', '.join(repr(n) for n in NAMES)}], (page_id % {len(NAMES)} + 1)::INTEGER) AS path, html FROM pages)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("page_id") % len(NAMES)).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), name).alias("path"), "html")


@query(f"WITH {NAMED_SQL} SELECT page_id, {LANGUAGE_SQL} AS language, {CODE_SQL} AS is_code FROM named")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("page_id", paths.language(F.col("path")).alias("language"), paths.is_code(F.col("path")).alias("is_code"))


DEPTH_SQL = "(length(path) - length(replace(path, '/', '')))"
LINES_SQL = "(length(html) - length(replace(html, chr(10), '')) + 1)"
IMPORTANCE_SQL = f"""round(CASE WHEN {CODE_SQL} THEN 10.0 ELSE 4.0 END + CASE WHEN {NAME_SQL} IN {_in(paths.HIGH_VALUE_NAMES)} THEN 12.0 ELSE 0 END + greatest(0.0, 5.0 - {DEPTH_SQL} * 1.2)
  + CASE WHEN {LINES_SQL} BETWEEN 20 AND 800 THEN 3.0 WHEN {LINES_SQL} > 3000 THEN -4.0 ELSE 0 END - CASE WHEN regexp_matches(lower(path), '{"|".join(paths.TEST_MARKERS)}') THEN 5.0 ELSE 0 END
  - CASE WHEN regexp_matches(lower(path), 'generated|_pb2|[.]pb[.]|autogen') THEN 8.0 ELSE 0 END + CASE WHEN {LANGUAGE_SQL} IN ('markdown', 'rst') AND {DEPTH_SQL} <= 1 THEN 4.0 ELSE 0 END, 6)::DOUBLE"""


@query(f"WITH {NAMED_SQL} SELECT path, importance, (row_number() OVER (ORDER BY importance DESC, path))::INTEGER AS place FROM (SELECT path, {IMPORTANCE_SQL} AS importance FROM named) QUALIFY place <= 100")
def importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred files most worth indexing; the limit is the feature."""
    lines = F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit(""))) + 1
    rows = _named(spark, sf_dir).select("path", F.round(paths.importance(F.col("path"), lines), 6).alias("importance")).orderBy(F.desc("importance"), "path").limit(100)
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "path")))


DOC_LINES_SQL = "(length(rtrim(text, '')) - length(replace(text, chr(10), '')) + CASE WHEN text = '' THEN 0 WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END)"


@query(
    f"""WITH f AS (SELECT source || '/' || lang AS dir, doc_id, {DOC_LINES_SQL.replace("rtrim(text, '')", "text")} AS lines FROM documents),
r AS (SELECT dir, sum(lines)::BIGINT AS lines, count(*) AS files FROM f GROUP BY dir),
o AS (SELECT *, coalesce(sum(least(files, 14)) OVER (ORDER BY lines DESC, dir ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT dir, lines, files, least(files, 14, 260 - before)::BIGINT AS shown, greatest(files - 14, 0)::BIGINT AS more FROM o WHERE before < 260"""
)
def repo_map_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of a repository map: by lines, fourteen files of each, 260 in all; the limits are the feature."""
    return chunking.map_directories(_files(spark, sf_dir))


LINES_CTE = "lined AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> '')"


def windows_sql(source: str, compat: bool = False) -> str:
    """win(doc_id, sect, first, last) over source(doc_id, sect, l, a, b): lines a to b of the list l, from 0."""
    step, most = LINES - OVERLAP, LINES
    keep = "moved" if compat else f"CASE WHEN stop >= b OR moved < s + {step} - 1 THEN stop ELSE moved END"
    return f"""starts AS (SELECT doc_id, sect, l, a, b, unnest(range(a, b + 1, {step})) AS s FROM {source} WHERE b >= a AND b - a + 1 > {most}),
stops AS (SELECT *, least(s + {most} - 1, b) AS stop FROM starts),
hits AS (SELECT *, list_filter(range(stop, greatest(s + 5, stop - 12), -1), lambda i: NOT regexp_matches(l[i + 1], '\\S') OR regexp_matches(l[i + 1], '^\\S'))[1] AS hit FROM stops),
moves AS (SELECT *, CASE WHEN hit IS NULL THEN stop WHEN NOT regexp_matches(l[hit + 1], '\\S') THEN hit ELSE greatest(s, hit - 1) END AS moved FROM hits),
ends AS (SELECT doc_id, sect, b, s, {keep} AS e FROM moves),
cut AS (SELECT *, coalesce(max((e >= b)::INTEGER) OVER (PARTITION BY doc_id, sect ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ends),
win AS (SELECT doc_id, sect, s AS first, e AS last FROM cut WHERE done = 0 UNION ALL SELECT doc_id, sect, a, b FROM {source} WHERE b >= a AND b - a + 1 <= {most})"""


WHOLE_SQL = f"{LINES_CTE}, whole AS (SELECT doc_id, 0 AS sect, l, 0::BIGINT AS a, (len(l) - 1)::BIGINT AS b FROM lined)"
BODY_SQL = "list_aggregate(l[first + 1 : last + 1], 'string_agg', chr(10))"
CHUNK_SQL = f"""chunk AS (SELECT doc_id, {PATH_SQL} AS path, (first + 1)::INTEGER AS start_line, (last + 1)::INTEGER AS end_line, {BODY_SQL} AS body FROM win JOIN lined USING (doc_id) JOIN documents USING (doc_id)),
chunks AS (SELECT *, '// file: ' || path || ' (text)' || chr(10) || body AS content FROM chunk WHERE length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) >= 24)"""
ID_SQL = "left(sha1(path || ':' || start_line || ':' || end_line || ':' || left(content, 256)), 16)"


def _line_chunks(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    return chunking.line_chunks(_files(spark, sf_dir), LINES, OVERLAP, compat)


@query(f"WITH {WHOLE_SQL}, {windows_sql('whole')}, {CHUNK_SQL} SELECT path, start_line, end_line, length(content)::INTEGER AS chars FROM chunks")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_chunks(spark, sf_dir).select("path", "start_line", "end_line", F.length("content").alias("chars"))


@query(f"WITH {WHOLE_SQL}, {windows_sql('whole', True)}, {CHUNK_SQL} SELECT path, start_line, end_line FROM chunks")
def line_chunks_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows under the older rule of where they end."""
    return _line_chunks(spark, sf_dir, True).select("path", "start_line", "end_line")


@query(f"WITH {WHOLE_SQL}, {windows_sql('whole')}, {CHUNK_SQL} SELECT path, start_line, end_line, {ID_SQL} AS chunk_id, greatest(1, length(content) // 4)::BIGINT AS tokens FROM chunks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_chunks(spark, sf_dir).select("path", "start_line", "end_line", "chunk_id", text.token_estimate(F.col("content")).alias("tokens"))


DEDUPE_SQL = f"twice AS (SELECT {ID_SQL} AS chunk_id, path, start_line, end_line FROM chunks UNION ALL SELECT {ID_SQL}, path, start_line, end_line + 1000 FROM chunks)"


@query(f"WITH {WHOLE_SQL}, {windows_sql('whole')}, {CHUNK_SQL}, {DEDUPE_SQL} SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY path DESC, start_line DESC, end_line DESC) = 1")
def chunk_id_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of chunks with equal ids the last wins."""
    rows = _line_chunks(spark, sf_dir).select("chunk_id", "path", "start_line", "end_line")
    return chunking.last_by_id(rows.unionByName(rows.withColumn("end_line", F.col("end_line") + 1000)))


@query(f"WITH {WHOLE_SQL}, {windows_sql('whole')}, {CHUNK_SQL} SELECT path, start_line, end_line FROM chunks WHERE path = 'src1/en/doc_1.txt'")
def source_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pergola.sources import index

    return index.by_path(_line_chunks(spark, sf_dir), "src1/en/doc_1.txt").select("path", "start_line", "end_line")


@query(f"WITH {WHOLE_SQL}, {windows_sql('whole')}, {CHUNK_SQL} SELECT count(*) AS chunks, count(DISTINCT path) AS files, round(avg(end_line - start_line + 1), 1) AS mean_lines FROM chunks")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_chunks(spark, sf_dir)
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 1).alias("mean_lines"))


#: A source file for each document: its lines are comments in a class of one to three methods, a function and a list; every fifth doesn't parse.
#: n: the document's lines; m: methods; h: lines of a method besides them; c: where the class ends; f: where the function begins and how it goes on.
CODE_SQL = f"""based AS (SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n, doc_id % 3 + 1 AS m, CASE WHEN doc_id % 5 = 4 THEN 'no' WHEN doc_id % 2 = 0 THEN 'ts' ELSE 'py' END AS kind FROM documents),
sized AS (SELECT *, n + CASE WHEN kind = 'ts' THEN 3 ELSE 2 END AS h, 'code/' || doc_id || CASE WHEN kind = 'ts' THEN '.ts' ELSE '.py' END AS path FROM based),
placed AS (SELECT *, CASE WHEN kind = 'ts' THEN 3 ELSE 2 END + m * h AS c FROM sized),
steps AS (SELECT *, unnest(range(m)) AS j FROM placed WHERE kind <> 'no'),
whole AS (SELECT doc_id, 1 AS sect, list_concat(['f'], list_transform(range(n), lambda i: '  x'), [CASE WHEN kind = 'ts' THEN '}}' ELSE '  y' END]) AS l, 0::BIGINT AS a, n + 1 AS b, c + 2 AS base FROM placed WHERE kind <> 'no' AND n + 2 > {2 * LINES}
  UNION ALL SELECT doc_id, 2, list_concat(['t'], list_transform(range(n), lambda i: '  x'), ['  1', ']']), 0, n + 2, c + n + 4 FROM placed WHERE kind = 'ts' AND n + 3 > {2 * LINES}
  UNION ALL SELECT doc_id, 3, list_concat(['t'], list_transform(range(n), lambda i: '  x'), ['  1', ']']), 0, n + 2, c + n + 4 FROM placed WHERE kind = 'py'
  UNION ALL SELECT doc_id, 4, list_concat(['d'], list_transform(range(n), lambda i: '  x')), 0, n, 1 FROM placed WHERE kind = 'no'), {windows_sql("whole")},
code AS (
  SELECT path, 1 AS start_line, 1 AS end_line, 'module' AS kind, NULL AS symbol, NULL AS parent_symbol FROM placed WHERE kind <> 'no'
  UNION ALL SELECT path, 2, c, 'class', 'Doc' || doc_id, NULL FROM placed WHERE kind <> 'no'
  UNION ALL SELECT path, 3 + j * h, 2 + (j + 1) * h, CASE WHEN kind = 'ts' THEN 'method' ELSE 'function' END, 'step' || j, 'Doc' || doc_id FROM steps WHERE c - 1 > {LINES}
  UNION ALL SELECT path, c + 2, c + n + 3, 'function', 'open' || doc_id, NULL FROM placed WHERE kind <> 'no' AND n + 2 <= {2 * LINES}
  UNION ALL SELECT path, c + n + 4, c + 2 * n + 6, 'block', 'TAIL' || doc_id, NULL FROM placed WHERE kind = 'ts' AND n + 3 <= {2 * LINES}
  UNION ALL SELECT path, base + first, base + last, ['function', 'block', 'module', 'block'][sect], CASE sect WHEN 1 THEN 'open' || doc_id WHEN 2 THEN 'TAIL' || doc_id END, NULL FROM win JOIN whole USING (doc_id, sect) JOIN placed USING (doc_id))"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: see CODE_SQL."""
    kind = F.when(F.col("doc_id") % 5 == 4, "no").when(F.col("doc_id") % 2 == 0, "ts").otherwise("py")
    said = F.transform(F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "[^A-Za-z0-9 {}()\";]", ""))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 3 + 1).cast("int").alias("m"), kind.alias("kind"), said.alias("said"))
    ts, py = F.transform("said", lambda x: F.concat(F.lit("    // "), x)), F.transform("said", lambda x: F.concat(F.lit("        # "), x))
    step = lambda before, after: F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.concat(F.lit(before), j.cast("string"), F.lit(after)))
    one = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    named = F.col("id")
    web = F.concat(
        one('import { part } from "./lib_', named, '";'), one("export class Doc", named, " {"),
        F.flatten(F.transform(step("  step", "(a) {"), lambda head: F.concat(F.array(head), ts, F.array(F.lit("    return a;"), F.lit("  }"))))), one("}"), one(""),
        one("export function open", named, "() {"), ts, one("}"), one("const TAIL", named, " = ["), ts, one("  1,"), one("]"),
    )
    python = F.concat(
        one("import lib_", named, "_of_the_corpus"), one("class Doc", named, ":"),
        F.flatten(F.transform(step("    def step", "(self, a):"), lambda head: F.concat(F.array(head), py, F.array(F.lit("        return a"))))), one(""),
        one("def open", named, "():"), py, one("    return 1"), one("TAIL", named, " = ["), py, one("    1,"), one("]"),
    )
    broken = F.concat(one("def broken(: # no parser takes this"), py)
    lines = F.when(F.col("kind") == "ts", web).when(F.col("kind") == "py", python).otherwise(broken)
    path = F.concat(F.lit("code/"), "id", F.when(F.col("kind") == "ts", ".ts").otherwise(".py"))
    return materialise(rows.select(path.alias("path"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content")))


@query(f"WITH {CODE_SQL} SELECT path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, kind, symbol, parent_symbol FROM code")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file a document by what it declares; containers of more than 20 lines by their members."""
    return chunking.chunks(_sources(spark, sf_dir), LINES, OVERLAP).select("path", "start_line", "end_line", "kind", "symbol", "parent_symbol")


@query(f"WITH {CODE_SQL} SELECT count(*) AS files, count(*) FILTER (WHERE kind <> 'no') AS declared, count(*) FILTER (WHERE kind = 'no') AS fallback, count(*) FILTER (WHERE kind <> 'no' AND c - 1 > {LINES}) AS skeletons, round(count(*) FILTER (WHERE kind <> 'no') / count(*), 4) AS coverage FROM placed")
def code_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.code_stats(chunking.code_spans(chunking.parsed(_sources(spark, sf_dir), LINES), LINES, OVERLAP))


@query(
    f"""WITH {CODE_SQL} SELECT path, 'Doc' || doc_id AS container, '# Outline of Doc' || doc_id || ' (' || m || ' members)' || chr(10) || CASE WHEN kind = 'ts' THEN 'export class Doc' || doc_id || ' {{' ELSE 'class Doc' || doc_id || ':' END || chr(10)
|| array_to_string(list_transform(range(m), lambda j: CASE WHEN kind = 'ts' THEN '    step' || j || '(a) {{' ELSE '    def step' || j || '(self, a):' END), chr(10)) || chr(10) AS outline FROM placed WHERE kind <> 'no' AND c - 1 > {LINES}"""
)
def code_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = chunking.code_spans(chunking.parsed(_sources(spark, sf_dir), LINES), LINES, OVERLAP).select("path", F.explode_outer("spans").alias("s"))
    return spans.where("s.outline IS NOT NULL").select("path", F.col("s.symbol").alias("container"), F.col("s.outline").alias("outline"))


#: Every third line as a heading, of a level that its place gives.
MARKDOWN_SQL = """lined AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 1 THEN repeat('#', ((i - 1) % 4 + 1)::INTEGER) || ' ' || x ELSE x END) AS l FROM documents WHERE text <> ''),
heads AS (SELECT doc_id, l, list_filter(range(len(l)), lambda i: regexp_matches(l[i + 1], '^#{1,4}\\s+.*$')) AS h FROM lined),
sects AS (SELECT doc_id, l, NULL AS title, -1 AS sect, 0::BIGINT AS a, (len(l) - 1)::BIGINT AS b FROM heads WHERE len(h) = 0
  UNION ALL SELECT doc_id, l, 'preamble', -1, 0, h[1] - 1 FROM heads WHERE len(h) > 0 AND h[1] > 0
  UNION ALL SELECT doc_id, l, trim(regexp_extract(l[h[k] + 1], '^#{1,4}\\s+(.*)$', 1)), k, h[k], coalesce(h[k + 1], len(l)) - 1 FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM heads))"""


@query(f"WITH {MARKDOWN_SQL}, {windows_sql('sects')} SELECT doc_id, title AS symbol, (first + 1)::INTEGER AS start_line, (last + 1)::INTEGER AS end_line FROM win JOIN sects USING (doc_id, sect) WHERE length(regexp_replace({BODY_SQL}, '^\\s+|\\s+$', '', 'g')) >= 24")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every third line as a heading, by sections."""
    lines = F.transform(F.split(F.regexp_replace("text", "\\n$", ""), "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), i % 4 + 1), F.lit(" "), x)).otherwise(x))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(lines, "\n").alias("content"))
    found = chunking.section_chunks(rows, LINES, OVERLAP)
    return found.select(F.regexp_replace("path", "\\.md$", "").cast("long").alias("doc_id"), "symbol", "start_line", "end_line")


@query(
    f"""WITH {LINES_CTE}, own AS (SELECT doc_id, i FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM lined) WHERE regexp_matches(l[i + 1], '\\S') AND length(l[i + 1]) % 3 <> 0),
marked AS (SELECT *, (i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 4 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL)::INTEGER AS new FROM own),
isles AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM marked)
SELECT doc_id, min(i)::INTEGER AS first, max(i)::INTEGER AS last FROM isles GROUP BY doc_id, isle"""
)
def uncovered_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that declarations leave, here those whose length is no multiple of three, in runs."""
    rows = read(spark, sf_dir, "documents").select("doc_id", chunking.lines_of(F.col("text")).alias("lines"))
    covered = F.filter(F.transform("lines", lambda x, i: F.when(F.length(x) % 3 == 0, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("covered", covered)
    return rows.select("doc_id", F.explode(chunking.islands(F.col("lines"), F.col("covered"))).alias("s")).select("doc_id", "s.first", "s.last")


@query("SELECT lang AS language, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 150) AS preview, trim(regexp_replace(lower(lang || '  ' || source || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, case when doc_id % 3 = 0 then 'repo' else lang || '-é' || source || '.git_x' end AS folder FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), text.slug(F.concat("lang", F.lit("  "), "source", F.lit("!"))).alias("slug"), text.folder_slug(F.when(F.col("doc_id") % 3 == 0, " ?! ").otherwise(F.concat(F.lit("  /"), "lang", F.lit(" ?É"), "source", F.lit(".git_x!")))).alias("folder"))


REFS_SQL = """refs AS (SELECT key::BIGINT AS key, ref FROM pulls UNION ALL SELECT 100 + doc_id, CASE doc_id % 6 WHEN 0 THEN source || '/' || lang || '#' || doc_id WHEN 1 THEN 'https://host.example/' || source || '/r.' || lang || '/pull/' || doc_id || '/' WHEN 2 THEN source || '/' || lang
  WHEN 3 THEN 'ssh://git@host.example/' || source || '.git' WHEN 4 THEN 'git@host.example:' || lang || '/' || source ELSE left(text, 40) END FROM documents)"""


@query(f"WITH {fixtures.PULLS.sql()}, {REFS_SQL} SELECT key, CASE WHEN regexp_matches(ref, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') THEN 'hosted' WHEN regexp_matches(ref, '^(https?|ssh|git)://|^git@') THEN 'url' END AS kind, nullif(regexp_extract(ref, '{files.PULL}', 1), '') AS repo, try_cast(regexp_extract(ref, '{files.PULL}', 2) AS INTEGER) AS number FROM refs")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    kinds = (said(source, "/", lang, "#", doc), said("https://host.example/", source, "/r.", lang, "/pull/", doc, "/"), said(source, "/", lang), said("ssh://git@host.example/", source, ".git"), said("git@host.example:", lang, "/", source))
    ref = F.substring("text", 1, 40)
    for k, kind in enumerate(kinds):
        ref = F.when(doc % 6 == k, kind).otherwise(ref)
    rows = fixtures.PULLS.frame(spark).select(F.col("key").cast("long").alias("key"), "ref").unionByName(read(spark, sf_dir, "documents").select((doc + 100).alias("key"), ref.alias("ref")))
    return rows.select("key", files.repository(F.col("ref"), F.lit(False))["kind"].alias("kind"), files.pull_request(F.col("ref"))["repo"].alias("repo"), files.pull_request(F.col("ref"))["number"].alias("number"))


# Answers


DOC_DRAFT_SQL = f"'see [' || {PATH_SQL} || ':' || (n_chars % 50) || '-' || (doc_id % 40) || ', ' || (doc_id % 9 + 1) || '] and [note, 4] or [' || lang || '/doc_' || doc_id || '.txt:7, no.txt:' || doc_id || ' – ' || 5 || ']'"
DRAFTS_SQL = f"{fixtures.DRAFTS.sql()}, told AS (SELECT key::BIGINT AS key, draft FROM drafts UNION ALL SELECT 1000 + doc_id, {DOC_DRAFT_SQL} FROM documents)"
CITED_SQL = f"""{DRAFTS_SQL}, br AS (SELECT key, unnest(regexp_extract_all(coalesce(draft, ''), '\\[([^\\[\\]]{{3,400}}?)\\]', 1)) AS br, unnest(range(len(regexp_extract_all(coalesce(draft, ''), '\\[([^\\[\\]]{{3,400}}?)\\]', 1)))) AS b FROM told),
part AS (SELECT key, b, unnest(string_split(br, ',')) AS part, unnest(range(len(string_split(br, ',')))) AS p FROM br),
kinds AS (SELECT *, regexp_extract(part, '^\\s*([^\\s:]+?[.][A-Za-z0-9_]+):([0-9]+)(?:\\s*[-–]\\s*([0-9]+))?\\s*$', ['path', 'a', 'b']) AS r, regexp_extract(part, '^\\s*([0-9]+)(?:\\s*[-–]\\s*([0-9]+))?\\s*$', ['a', 'b']) AS n FROM part),
runs AS (SELECT *, sum((r.path <> '' OR n.a = '')::INTEGER) OVER (PARTITION BY key, b ORDER BY p) AS run FROM kinds),
given AS (SELECT *, max(r.path) OVER (PARTITION BY key, b, run) AS path, CASE WHEN r.path <> '' THEN r.a ELSE n.a END AS x, CASE WHEN r.path <> '' THEN r.b ELSE n.b END AS y FROM runs WHERE r.path <> '' OR n.a <> ''),
cited AS (SELECT key, path, least(x::INTEGER, coalesce(try_cast(y AS INTEGER), x::INTEGER)) AS first, greatest(x::INTEGER, coalesce(try_cast(y AS INTEGER), x::INTEGER)) AS last FROM given WHERE path <> '')"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, path, first, last of the markers of a few drafts and of one for each document."""
    words = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    text_of = lambda c: c.cast("string")
    doc = F.col("doc_id")
    draft = words("see [", _path(), ":", text_of(F.col("n_chars") % 50), "-", text_of(doc % 40), ", ", text_of(doc % 9 + 1), "] and [note, 4] or [", F.col("lang"), "/doc_", text_of(doc), ".txt:7, no.txt:", text_of(doc), " – 5]")
    rows = fixtures.DRAFTS.frame(spark).select(F.col("key").cast("long").alias("key"), "draft").unionByName(read(spark, sf_dir, "documents").select((doc + 1000).alias("key"), draft.alias("draft")))
    return rows.select("key", F.explode(answers.citations(F.col("draft"))).alias("c")).select("key", "c.path", "c.first", "c.last")


@query(f"WITH {CITED_SQL} SELECT * FROM cited")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir)


RESOLVED_SQL = f"""paths AS (SELECT {PATH_SQL} AS path FROM documents), wantp AS (SELECT DISTINCT path FROM cited),
solved AS (SELECT w.path, k.path AS resolved FROM wantp w JOIN paths k ON k.path = w.path OR (ends_with(k.path, w.path) AND w.path NOT IN (SELECT path FROM paths)) QUALIFY row_number() OVER (PARTITION BY w.path ORDER BY length(k.path), k.path) = 1)"""


@query(f"WITH {CITED_SQL}, {RESOLVED_SQL} SELECT key, path, first, last, resolved FROM cited LEFT JOIN solved USING (path)")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.resolved(_cited(spark, sf_dir), _files(spark, sf_dir).select("path")).select("key", "path", "first", "last", "resolved")


@query(f"WITH {CITED_SQL}, paths AS (SELECT {PATH_SQL} AS path FROM documents) SELECT key, count(*) AS citations, round(avg((path IN (SELECT path FROM paths))::INTEGER), 4) AS valid_rate FROM cited GROUP BY key")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.citation_validity(_cited(spark, sf_dir), _files(spark, sf_dir).select("path"))


@query(
    f"""WITH {CITED_SQL}, {WHOLE_SQL}, {windows_sql('whole')}, {CHUNK_SQL}, named AS (SELECT path, start_line, end_line, body, CASE WHEN start_line % 2 = 1 THEN path || '@' || start_line END AS symbol FROM chunks),
near AS (SELECT c.*, n.* EXCLUDE (path) FROM cited c JOIN named n ON n.path = c.path AND c.first BETWEEN n.start_line AND n.end_line),
best AS (SELECT key, path, first, last, arg_min(symbol, start_line * 100000 + end_line) FILTER (WHERE symbol IS NOT NULL) AS symbol,
  arg_min(left(list_aggregate(string_split(body, chr(10))[first - start_line + 1 : first - start_line + least(6, last - first + 1)], 'string_agg', chr(10)), 600), start_line * 100000 + end_line) AS excerpt FROM near GROUP BY key, path, first, last)
SELECT c.key, c.path, c.first, c.last, symbol, excerpt FROM cited c LEFT JOIN best USING (key, path, first, last)"""
)
def citation_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_chunks(spark, sf_dir)
    body = F.regexp_replace("content", "^[^\\n]*\\n", "")
    named = rows.select("path", "start_line", "end_line", body.alias("body"), F.when(F.col("start_line") % 2 == 1, F.concat("path", F.lit("@"), F.col("start_line").cast("string"))).alias("symbol"))
    return answers.located(_cited(spark, sf_dir), named).select("key", "path", "first", "last", "symbol", "excerpt")


CONFIDENCE_SQL = """WITH {t}, a AS (SELECT key, coalesce(base, 0.5) * CASE WHEN grounded = false THEN 0.55 ELSE 1.0::DOUBLE END * CASE WHEN complete = false THEN 0.8 ELSE 1.0::DOUBLE END AS v, citations, overlap, invalid, errors FROM {n}),
b AS (SELECT *, CASE WHEN citations = 0 THEN v * 0.6::DOUBLE ELSE least(1.0::DOUBLE, v * (0.7::DOUBLE + 0.3::DOUBLE * overlap) * (1.0::DOUBLE + 0.04::DOUBLE * least(citations, 5))) END AS w FROM a),
c AS (SELECT *, CASE WHEN invalid > 0 THEN w * greatest(0.55::DOUBLE, 1.0::DOUBLE - 0.6::DOUBLE * (invalid / (invalid + citations))) ELSE w END AS x FROM b)
SELECT key, round(greatest(0.0::DOUBLE, least(0.97::DOUBLE, CASE WHEN errors > 0 THEN x * 0.9::DOUBLE ELSE x END)), 3) AS confidence FROM c"""


CONFIDENCES_SQL = f"""{fixtures.ANSWERS.sql("some_answers")}, answers AS (SELECT key::BIGINT AS key, base, grounded, complete, citations, overlap, invalid, errors FROM some_answers UNION ALL
  SELECT 100 + event_id, CASE WHEN event_id % 11 > 0 THEN (event_id % 101)::DOUBLE / 100 END, CASE WHEN event_id % 7 > 0 THEN event_id % 2 = 0 END, CASE WHEN event_id % 5 > 0 THEN event_id % 3 = 0 END, (event_id % 9)::INTEGER, (user_id % 5)::DOUBLE / 4, (user_id % 4)::INTEGER, (event_id % 13 // 12)::INTEGER FROM events)"""


@query(CONFIDENCE_SQL.format(t=CONFIDENCES_SQL, n="answers"))
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("base", "grounded", "complete", "citations", "overlap", "invalid", "errors")
    e, u = F.col("event_id"), F.col("user_id")
    made = read(spark, sf_dir, "events").select(
        (e + 100).alias("key"), F.when(e % 11 > 0, (e % 101).cast("double") / 100).alias("base"), F.when(e % 7 > 0, e % 2 == 0).alias("grounded"), F.when(e % 5 > 0, e % 3 == 0).alias("complete"), (e % 9).cast("int").alias("citations"),
        ((u % 5).cast("double") / 4).alias("overlap"), (u % 4).cast("int").alias("invalid"), F.floor(e % 13 / 12).cast("int").alias("errors"),
    )
    return fixtures.ANSWERS.frame(spark).withColumn("key", F.col("key").cast("long")).unionByName(made).select("key", answers.confidence(*map(F.col, columns)).alias("confidence"))


RANKED_DOCS_SQL = "ranked AS (SELECT source AS qid, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS rank, length(text)::BIGINT AS chars FROM documents)"


def _ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("source").alias("qid"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.length("text").cast("long").alias("chars"))


@query(
    f"""WITH {RANKED_DOCS_SQL}, u AS (SELECT *, coalesce(sum(chars) OVER w, 0)::BIGINT AS used FROM ranked WINDOW w AS (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, used + chars > 90000 AS stop, coalesce(bool_or(used + chars > 90000) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM u)
SELECT qid, rank, least(chars, 90000 - used)::BIGINT AS taken FROM s WHERE NOT over AND (NOT stop OR 90000 - used >= 400)"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source into a context of 90,000 characters."""
    return answers.packed(_ranked_docs(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {RANKED_DOCS_SQL}, items AS (SELECT qid, rank, greatest(1, chars // 4) AS cost FROM ranked), walk(qid, rank, used, kept) AS (
  SELECT qid, 0, 0::BIGINT, false FROM (SELECT DISTINCT qid FROM items) UNION ALL
  SELECT i.qid, i.rank, CASE WHEN w.used + i.cost > 8000 THEN w.used ELSE w.used + i.cost END, w.used + i.cost <= 8000 FROM walk w JOIN items i ON i.qid = w.qid AND i.rank = w.rank + 1)
SELECT qid, rank, cost::BIGINT AS cost FROM walk JOIN items USING (qid, rank) WHERE kept"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of what still fits into 8,000 tokens."""
    rows = _ranked_docs(spark, sf_dir).select("qid", "rank", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).cast("long").alias("cost"))
    return answers.budgeted(rows, 8000)


@query(
    """SELECT doc_id, overall, least(c, g, m) >= 3 AND overall >= 3.5 AS passed FROM (SELECT *, round(0.45 * c + 0.35 * g + 0.2 * m, 3)::DOUBLE AS overall
FROM (SELECT doc_id, 1 + 4 * quality AS c, 5 - 3 * toxic AS g, 3 + (doc_id % 3)::INTEGER AS m FROM labels))"""
)
def judge_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read as a judge's marks."""
    overall, passed = answers.judged(1 + 4 * F.col("quality"), 5 - 3 * F.col("toxic"), 3 + (F.col("doc_id") % 3).cast("int"))
    return read(spark, sf_dir, "labels").select("doc_id", overall.cast("double").alias("overall"), passed.alias("passed"))


@query("SELECT conv_id, turn, round(len(list_filter(['the', role, 'AND', 'ment', 'zzz'], lambda t: contains(lower(text), lower(t)))) / 5, 4) AS coverage FROM conversations")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("the"), F.col("role"), F.lit("AND"), F.lit("ment"), F.lit("zzz"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.keyword_coverage(F.col("text"), terms).alias("coverage"))


#: A reply for each turn of a conversation around a JSON value that is told beforehand: a list, an object in prose, one between fences, braces in a string, none.
JSON_SQL = """SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN conv_id::VARCHAR WHEN 2 THEN turn::VARCHAR WHEN 3 THEN '{' || role || '}' END AS a, CASE turn % 5 WHEN 0 THEN (conv_id + turn)::VARCHAR END AS second FROM conversations"""


@query(JSON_SQL)
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON in a model's reply."""
    turn, conv, role = F.col("turn"), F.col("conv_id"), F.col("role")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    words = F.coalesce(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(""))
    reply = F.when(turn % 5 == 0, said(words, " [", turn, ", ", conv + turn, "] ", words)).when(turn % 5 == 1, said("So ", words, ' {"a": ', conv, ', "b": [1]} {"a": 0}')).when(turn % 5 == 2, said(words, '\n```json\n{"a": ', turn, "}\n```\n", words))
    reply = reply.when(turn % 5 == 3, said('{"b": "}", "a": "{', role, '}"} ', words)).otherwise(words)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.json_value(reply).alias("value"))
    return rows.select("conv_id", "turn", F.get_json_object("value", "$.a").alias("a"), F.get_json_object("value", "$[1]").alias("second"))


@query(f"""WITH got AS (SELECT doc_id % 97 AS case_id, doc_id AS rank, source AS path FROM documents), wanted AS (SELECT DISTINCT doc_id % 97 AS case_id, 'src' || (doc_id % 31) AS path FROM documents)
SELECT case_id, path FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.case_id = w.case_id AND g.path = w.path)""")
def missed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    case = (F.col("doc_id") % 97).alias("case_id")
    got = rows.select(case, F.col("doc_id").alias("rank"), F.col("source").alias("path"))
    return evaluation.missed(got, rows.select(case, F.concat(F.lit("src"), (F.col("doc_id") % 31).cast("string")).alias("path")))


RUN_SQL = """run AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'quota' END AS error, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality = 1 END AS passed, 0.5::DOUBLE + toxic / 4 AS confidence, (doc_id % 6)::INTEGER AS citations, toxic AS hallucinations,
  (doc_id % 100) / 10 AS latency, (doc_id % 1000) / 100000 AS cost, (doc_id % 5000)::BIGINT AS tokens, (doc_id % 3)::INTEGER AS refinements FROM labels)"""


@query(
    f"""WITH {RUN_SQL} SELECT count(*) FILTER (WHERE error IS NULL) AS answered, count(*) FILTER (WHERE error IS NOT NULL) AS failed, round(coalesce(avg(passed::INTEGER) FILTER (WHERE error IS NULL), 0), 4) AS pass_rate,
round(avg(confidence) FILTER (WHERE error IS NULL), 4) AS mean_confidence, round(avg(citations) FILTER (WHERE error IS NULL), 2) AS mean_citations, round(avg(latency) FILTER (WHERE error IS NULL), 2) AS mean_latency_s,
round(avg(cost) FILTER (WHERE error IS NULL), 6) AS mean_cost_usd, floor(avg(tokens) FILTER (WHERE error IS NULL))::BIGINT AS mean_tokens, (sum(refinements) FILTER (WHERE error IS NULL))::BIGINT AS refinements,
count(*) FILTER (WHERE error IS NULL AND passed IS NOT NULL AND hallucinations > 0) AS hallucination_cases FROM run"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = read(spark, sf_dir, "labels").select(
        F.when(doc % 11 == 0, "quota").alias("error"),
        F.when(doc % 5 != 0, F.col("quality") == 1).alias("passed"),
        (0.5 + F.col("toxic") / 4).alias("confidence"),
        (doc % 6).cast("int").alias("citations"),
        F.col("toxic").alias("hallucinations"),
        ((doc % 100) / 10).alias("latency"),
        ((doc % 1000) / 100000).alias("cost"),
        (doc % 5000).alias("tokens"),
        (doc % 3).cast("int").alias("refinements"),
    )
    return evaluation.run_summary(rows)


@query("SELECT doc_id, repeat('#', round_even(greatest(0, least(1, (n_chars % 120) / 100)) * 18, 0)::INTEGER) AS bar FROM documents")
def report_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", evaluation.bar((F.col("n_chars") % 120) / 100).alias("bar"))


# Diffs and reviews


#: A diff for each document beside those of the fixture: a file in which lines in turn stay, go and are new, with a second hunk that has lines like headers; every second
#: document has a new file too, every third a deleted one that isn't text, every fifth a file without git's line. Findings: one for each document, every fourth's twice.
DOC_DIFF_SQL = """lined_diff AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[^ -~]', '', 'g')) AS l FROM documents),
doc_diffs AS (SELECT 'doc' || doc_id AS diff_id, 'diff --git a/src/doc_' || doc_id || '.txt b/src/doc_' || doc_id || '.txt' || chr(10) || 'index 1..2 100644' || chr(10) || '--- a/src/doc_' || doc_id || '.txt' || chr(10) || '+++ b/src/doc_' || doc_id || '.txt' || chr(10)
  || '@@ -1,' || (len(l) - len(l) // 3) || ' +1,' || (len(l) - (len(l) + 1) // 3) || ' @@ ' || doc_id || chr(10) || array_to_string(list_transform(l, lambda x, i: [' ', '-', '+'][(i - 1) % 3 + 1] || x), chr(10)) || chr(10)
  || '@@ -900,2 +900 @@' || chr(10) || '--- not_a_header' || chr(10) || '-gone_too' || chr(10) || '+++ nor_this_one' || chr(10) || chr(92) || ' No newline at end of file' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'diff --git a/docs/new_' || doc_id || '.md b/docs/new_' || doc_id || '.md' || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/docs/new_' || doc_id || '.md' || chr(10) || '@@ -0,0 +1,' || len(l) || ' @@' || chr(10) || array_to_string(list_transform(l, lambda x: '+' || x), chr(10)) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN 'diff --git a/old_' || doc_id || '.bin b/old_' || doc_id || '.bin' || chr(10) || 'deleted file mode 100644' || chr(10) || 'Binary files a/old and /dev/null differ' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN '--- a/plain_' || doc_id || '.sql' || chr(9) || 'today' || chr(10) || '+++ b/plain_' || doc_id || '.sql' || chr(10) || '@@ -3 +3,2 @@' || chr(10) || '-select_old' || chr(10) || '+select_new' || chr(10) || '+select_more' || chr(10) ELSE '' END AS text FROM lined_diff),
doc_findings AS (SELECT doc_id + 1000 AS finding_id, 'src/doc_' || doc_id || '.txt' AS path, (doc_id % (len(l) + 6))::INTEGER AS line, ['critical', ' HIGH', 'odd', 'low', 'info', 'Medium'][doc_id % 6 + 1] AS severity, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'On ' || left(l[1], 30) END AS title,
  CASE WHEN doc_id % 14 = 0 THEN '' ELSE ' See ' || len(l) || ' lines ' END AS body, ['Security', '', 'style'][doc_id % 3 + 1] AS category, ((doc_id * 7) % 100)::DOUBLE / 100 AS confidence FROM lined_diff),
both_findings AS (SELECT * FROM doc_findings UNION ALL SELECT finding_id + 1000000000, path, line, severity, upper(title), body || 'again', category, confidence FROM doc_findings WHERE finding_id % 4 = 0)"""


def _doc_diffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """diffs and findings of documents, see DOC_DIFF_SQL."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, "[^ -~]", ""))
    rows = read(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).withColumn("d", F.col("doc_id").cast("string")).withColumn("n", F.size("l"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    d, n = F.col("d"), F.col("n")
    marks = F.array(F.lit(" "), F.lit("-"), F.lit("+"))
    changed = F.array_join(F.transform("l", lambda x, i: F.concat(F.get(marks, i % 3), x)), "\n")
    first = said("diff --git a/src/doc_", d, ".txt b/src/doc_", d, ".txt\nindex 1..2 100644\n--- a/src/doc_", d, ".txt\n+++ b/src/doc_", d, ".txt\n@@ -1,", n - F.floor(n / 3), " +1,", n - F.floor((n + 1) / 3), " @@ ", d, "\n", changed, "\n")
    second = said("@@ -900,2 +900 @@\n--- not_a_header\n-gone_too\n+++ nor_this_one\n\\ No newline at end of file\n")
    new = said("diff --git a/docs/new_", d, ".md b/docs/new_", d, ".md\nnew file mode 100644\n--- /dev/null\n+++ b/docs/new_", d, ".md\n@@ -0,0 +1,", n, " @@\n", F.array_join(F.transform("l", lambda x: F.concat(F.lit("+"), x)), "\n"), "\n")
    binary = said("diff --git a/old_", d, ".bin b/old_", d, ".bin\ndeleted file mode 100644\nBinary files a/old and /dev/null differ\n")
    plain = said("--- a/plain_", d, ".sql\ttoday\n+++ b/plain_", d, ".sql\n@@ -3 +3,2 @@\n-select_old\n+select_new\n+select_more\n")
    part = lambda test, text: F.when(test, text).otherwise("")
    doc = F.col("doc_id")
    whole = F.concat(first, second, part(doc % 2 == 0, new), part(doc % 3 == 0, binary), part((doc % 5 == 0) & (doc % 3 != 0), plain))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    found = rows.select(
        (doc + 1000).alias("finding_id"), said("src/doc_", d, ".txt").alias("path"), (doc % (n + 6)).cast("int").alias("line"), pick(("critical", " HIGH", "odd", "low", "info", "Medium"), doc % 6).alias("severity"),
        F.when(doc % 7 == 0, "").otherwise(F.concat(F.lit("On "), F.substring(F.get("l", 0), 1, 30))).alias("title"), F.when(doc % 14 == 0, "").otherwise(said(" See ", n, " lines ")).alias("body"),
        pick(("Security", "", "style"), doc % 3).alias("category"), (((doc * 7) % 100).cast("double") / 100).alias("confidence"),
    )
    twice = found.where("finding_id % 4 = 0").select((F.col("finding_id") + 1_000_000_000).alias("finding_id"), "path", "line", "severity", F.upper("title").alias("title"), F.concat("body", F.lit("again")).alias("body"), "category", "confidence")
    return rows.select(said("doc", d).alias("diff_id"), whole.alias("text")), found.unionByName(twice)


def _diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    marked = diffs.marked(fixtures.DIFFS.frame(spark).unionByName(_doc_diffs(spark, sf_dir)[0]))
    return marked, diffs.files(marked), diffs.diff_lines(marked)


DIFF_SQL = f"""{DOC_DIFF_SQL}, {fixtures.DIFFS.sql("some_diffs")}, diffs AS (SELECT * FROM some_diffs UNION ALL SELECT * FROM doc_diffs), raw_lines AS (SELECT diff_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS raw, unnest(range(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))))) AS n FROM diffs),
tagged AS (SELECT *, regexp_matches(raw, '^diff --git a/.+? b/.+$') AS git, regexp_extract(raw, '{diffs.HUNK}', ['os', 'oc', 'ns', 'nc', 'h']) AS hk FROM raw_lines),
segs AS (SELECT *, hk.os <> '' AS hunk, sum((git OR hk.os <> '')::INTEGER) OVER (PARTITION BY diff_id ORDER BY n) AS seg FROM tagged),
heads AS (SELECT diff_id, seg, any_value(hk) FILTER (WHERE hunk) AS hd, bool_or(git) AS in_git, bool_or(hunk) AS in_hunk FROM segs GROUP BY diff_id, seg),
uses AS (SELECT s.*, h.hd, h.in_git, h.in_hunk AND NOT s.hunk AS body, (h.in_hunk AND NOT s.hunk AND left(raw, 1) NOT IN ('+', chr(92)))::INTEGER AS o, (h.in_hunk AND NOT s.hunk AND left(raw, 1) NOT IN ('-', chr(92)))::INTEGER AS w FROM segs s JOIN heads h USING (diff_id, seg)),
before AS (SELECT *, coalesce(sum(o) OVER x, 0)::INTEGER AS ob, coalesce(sum(w) OVER x, 0)::INTEGER AS wb FROM uses WINDOW x AS (PARTITION BY diff_id, seg ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ins AS (SELECT *, body AND (ob < coalesce(try_cast(hd.oc AS INTEGER), 1) OR wb < coalesce(try_cast(hd.nc AS INTEGER), 1)) AS inside FROM before),
filed AS (SELECT *, sum((git OR (starts_with(raw, '--- ') AND NOT inside AND NOT in_git))::INTEGER) OVER (PARTITION BY diff_id ORDER BY n) AS file_no FROM ins),
hunked AS (SELECT *, sum(hunk::INTEGER) OVER (PARTITION BY diff_id, file_no ORDER BY n) AS hunk_no FROM filed WHERE file_no > 0),
dlines AS (SELECT diff_id, file_no, hunk_no, CASE left(raw, 1) WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'context' END AS type, substr(raw, 2) AS content,
  CASE WHEN left(raw, 1) <> '+' THEN hd.os::INTEGER + ob END AS old_line, CASE WHEN left(raw, 1) <> '-' THEN hd.ns::INTEGER + wb END AS new_line,
  (row_number() OVER (PARTITION BY diff_id, file_no, hunk_no ORDER BY n))::INTEGER AS position FROM hunked WHERE inside AND left(raw, 1) <> chr(92)),
shorn AS (SELECT *, regexp_replace(trim(string_split(substr(raw, 5), chr(9))[1]), '^[ab]/', '') AS p FROM hunked),
dfiles AS (SELECT diff_id, file_no, coalesce(max(nullif(regexp_extract(raw, '{diffs.GIT}', 2), '')), max(p) FILTER (WHERE NOT inside AND starts_with(raw, '+++ ') AND p <> '/dev/null'), max(p) FILTER (WHERE NOT inside AND starts_with(raw, '--- ')), 'unknown') AS path,
  bool_or(NOT inside AND (starts_with(raw, 'new file mode') OR (starts_with(raw, '--- ') AND p = '/dev/null'))) AS is_new, bool_or(NOT inside AND (starts_with(raw, 'deleted file mode') OR (starts_with(raw, '+++ ') AND p = '/dev/null'))) AS is_deleted,
  bool_or(NOT inside AND (starts_with(raw, 'Binary files') OR starts_with(raw, 'GIT binary patch'))) AS is_binary, max(hunk_no) AS hunks FROM shorn GROUP BY diff_id, file_no)"""


@query(f"WITH {DIFF_SQL} SELECT diff_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, type, content, old_line, new_line, position FROM dlines")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)[2]


@query(f"WITH {DIFF_SQL} SELECT diff_id, file_no::BIGINT AS file_no, path, is_new, is_deleted, is_binary, hunks::BIGINT AS hunks FROM dfiles")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)[1].drop("old_path", "is_renamed")


@query(
    f"""WITH {DIFF_SQL} SELECT diff_id, count(*) AS files, count(*) FILTER (WHERE NOT is_deleted AND NOT is_binary AND hunks > 0) AS reviewable,
(SELECT count(*) FROM dlines l WHERE l.diff_id = f.diff_id AND type = 'added') AS additions, (SELECT count(*) FROM dlines l WHERE l.diff_id = f.diff_id AND type = 'removed') AS deletions FROM dfiles f GROUP BY diff_id"""
)
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, lines = _diff(spark, sf_dir)
    return diffs.stats(found, lines)


@query(
    f"""WITH {DIFF_SQL}, w AS (SELECT diff_id, file_no, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS term FROM dlines WHERE type <> 'context')
SELECT diff_id, file_no::BIGINT AS file_no, term, count(*) AS n, (row_number() OVER (PARTITION BY diff_id, file_no ORDER BY count(*) DESC, term))::INTEGER AS place FROM w GROUP BY diff_id, file_no, term QUALIFY place <= 12"""
)
def diff_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.search_terms(_diff(spark, sf_dir)[2])


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, lines = _diff(spark, sf_dir)
    added = lines.where("type = 'added'").join(found.select("diff_id", "file_no", "path"), ["diff_id", "file_no"]).select("path", "new_line")
    given = fixtures.FINDINGS.frame(spark).withColumn("finding_id", F.col("finding_id").cast("long"))
    return diffs.validated(given.unionByName(_doc_diffs(spark, sf_dir)[1]), added)


VALID_SQL = f"""{DIFF_SQL}, {fixtures.FINDINGS.sql("some_findings")}, findings AS (SELECT * FROM some_findings UNION ALL SELECT * FROM both_findings), added AS (SELECT DISTINCT path, new_line FROM dlines JOIN dfiles USING (diff_id, file_no) WHERE type = 'added'),
good AS (SELECT finding_id, path, line, CASE WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(severity)) ELSE 'medium' END AS severity, coalesce(nullif(left(trim(title), 200), ''), 'Issue') AS title, trim(body) AS body,
  coalesce(nullif(left(lower(trim(category)), 40), ''), 'correctness') AS category, confidence FROM findings WHERE confidence >= 0.5 AND (title <> '' OR body <> '')),
valid AS (SELECT finding_id, path, CASE WHEN path IN (SELECT path FROM added) THEN (SELECT a.new_line FROM added a WHERE a.path = good.path AND abs(a.new_line - good.line) <= 3 ORDER BY abs(a.new_line - good.line), a.new_line LIMIT 1) ELSE line END AS line,
  severity, title, body, category, confidence FROM good)"""


@query(f"WITH {VALID_SQL} SELECT * FROM valid")
def finding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir)


RANK_SQL = "list_position(['critical', 'high', 'medium', 'low', 'info'], severity) - 1"
UNIQUE_SQL = f"""{VALID_SQL}, once AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY path, coalesce(line, -1), left(lower(title), 60) ORDER BY confidence DESC, finding_id) = 1),
six AS (SELECT *, ({RANK_SQL})::INTEGER AS severity_rank FROM once QUALIFY row_number() OVER (PARTITION BY path ORDER BY {RANK_SQL}, confidence DESC, finding_id) <= 6)"""


@query(f"WITH {UNIQUE_SQL} SELECT * FROM six ORDER BY severity_rank, path, coalesce(line, 0), finding_id LIMIT 25")
def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.deduplicated(_valid(spark, sf_dir))


@query(
    f"""WITH {UNIQUE_SQL} SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info, coalesce(bool_or(severity_rank <= 1), false) AS blocked FROM (SELECT * FROM six ORDER BY severity_rank, path, coalesce(line, 0), finding_id LIMIT 25)"""
)
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.blocked(diffs.deduplicated(_valid(spark, sf_dir)))


RELATED_SQL = f"""{DIFF_SQL}, w AS (SELECT diff_id, file_no, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS term FROM dlines WHERE type <> 'context'),
said AS (SELECT diff_id, file_no, term, row_number() OVER (PARTITION BY diff_id, file_no ORDER BY count(*) DESC, term) AS place FROM w GROUP BY diff_id, file_no, term QUALIFY place <= 6),
sought AS (SELECT diff_id || '#' || file_no AS key, path, string_agg(term, ' ' ORDER BY place) AS q0, path || ' ' || string_agg(term, ' ' ORDER BY place) FILTER (WHERE place <= 3) AS q1 FROM said JOIN dfiles USING (diff_id, file_no) WHERE NOT is_deleted AND NOT is_binary AND hunks > 0 GROUP BY 1, 2),
asked_for AS (SELECT key || '#0' AS id, q0 AS q FROM sought UNION ALL SELECT key || '#1', q1 FROM sought), {INDEX_SQL}, {tokens_sql("ask", "asked_for", "id", "q")}, terms AS (SELECT DISTINCT doc AS qid, term FROM ask), {scores_sql("lex", "terms", CANDIDATES)},
lists AS (SELECT regexp_replace(qid, '#[01]$', '') AS qid, doc, rank FROM lex),
merged AS (SELECT qid, doc, round(sum(0.85::DOUBLE / (60 + rank + 1)), 6) AS score, count(*) AS agreement, min(rank) AS best_rank FROM lists GROUP BY qid, doc),
placed AS (SELECT m.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, agreement DESC, best_rank, doc) AS position FROM merged m),
lifted AS (SELECT p.qid, doc, source AS path, s.path AS own, position, CASE WHEN contains(s.path, '/') AND contains(lower(source), lower(regexp_replace(s.path, '/[^/]*$', ''))) THEN round(score * 1.25, 8) ELSE round(score, 8) END AS score FROM placed p JOIN sought s ON s.key = p.qid JOIN documents ON doc_id = doc),
again AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS spot FROM lifted),
spread AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY spot) > 4 AS over FROM again),
cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY over, spot) AS place FROM spread QUALIFY place <= 6)"""


@query(f"WITH {RELATED_SQL} SELECT qid AS file, doc AS doc_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1)::INTEGER AS rank FROM cut WHERE path <> own")
def review_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review of each file of the documents' diffs is given from the index: two searches a file, all files at once."""
    from pergola.plans import agent

    marked = materialise(diffs.marked(fixtures.DIFFS.frame(spark).unionByName(_doc_diffs(spark, sf_dir)[0])))
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("path"), F.col("doc_id").alias("start_line"))
    find = agent.retriever(chunks, _index(spark, sf_dir), top_k=reviewing.CHUNKS, expand=False, most=text.TOKENS)
    found = reviewing.related(materialise(reviewing.searches(marked)), find)
    return found.select(F.col("key").alias("file"), F.col("doc").alias("doc_id"), "rank")


# Usage, spans, quotas


@query("SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total_ms, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1")
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.span_summary(read(spark, sf_dir, "events"))


PRICES_SQL = "prices(prefix, price_in, price_out) AS (VALUES " + ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE)" for p, a, b in usage.PRICES) + ")"
MODEL_SQL = "['gemini-2.0-flash-001', 'models/Gemini-2.5-Flash-Lite', 'unknown', 'llama-3.1-8b-instant', 'gemini-pro-latest'][(user_id % 5 + 1)::INTEGER]"
EVENT_CALLS_SQL = f"calls AS (SELECT event_id, event_type, {MODEL_SQL} AS model, (event_id % 3000)::BIGINT AS prompt_tokens, (event_id % 700)::BIGINT AS completion_tokens, event_id % 4 = 0 AS cached FROM events)"
COST_SQL = "round((prompt_tokens * coalesce(price_in, 0.1) + completion_tokens * coalesce(price_out, 0.4)) / 1000000, 8)"
MATCH_SQL = "LEFT JOIN prices p ON p.prefix = (SELECT max_by(prefix, length(prefix)) FROM prices q WHERE starts_with(regexp_replace(lower(trim(model)), '^models/', ''), q.prefix))"


CALLS_SQL = f"""{fixtures.CALLS.sql("some_calls")}, calls AS (SELECT call_id::BIGINT AS call_id, model, prompt_tokens, completion_tokens, cached FROM some_calls UNION ALL SELECT 100 + event_id, (['gemini-2.0-flash-001', 'models/Gemini-2.5-Pro', 'text-embedding-004', event_type])[event_id % 4 + 1], user_id * 100, event_id % 5000, event_id % 3 = 0 FROM events)"""


@query(f"WITH {CALLS_SQL}, {PRICES_SQL} SELECT call_id, coalesce(price_in, 0.1)::DOUBLE AS price_in, {COST_SQL}::DOUBLE AS cost FROM calls {MATCH_SQL}")
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    model = F.get(F.array(F.lit("gemini-2.0-flash-001"), F.lit("models/Gemini-2.5-Pro"), F.lit("text-embedding-004"), "event_type"), (e % 4).cast("int"))
    made = read(spark, sf_dir, "events").select((e + 100).alias("call_id"), model.alias("model"), (F.col("user_id") * 100).alias("prompt_tokens"), (e % 5000).alias("completion_tokens"), (e % 3 == 0).alias("cached"))
    calls = fixtures.CALLS.frame(spark).withColumn("call_id", F.col("call_id").cast("long")).unionByName(made)
    return usage.priced(calls, usage.prices(spark)).select("call_id", "price_in", "cost")


@query(
    f"""WITH {EVENT_CALLS_SQL}, {PRICES_SQL}, names AS (SELECT model, p.price_in, p.price_out FROM (SELECT DISTINCT model FROM calls) {MATCH_SQL}), costed AS (SELECT calls.*, {COST_SQL}::DOUBLE AS cost FROM calls JOIN names USING (model))
SELECT event_type, (sum(prompt_tokens) FILTER (WHERE NOT cached))::BIGINT AS prompt_tokens, (sum(completion_tokens) FILTER (WHERE NOT cached))::BIGINT AS completion_tokens, count(*) FILTER (WHERE NOT cached) AS llm_calls,
count(*) FILTER (WHERE cached) AS cache_hits, round(sum(cost) FILTER (WHERE NOT cached), 6) AS cost_usd FROM costed GROUP BY 1"""
)
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as calls of models by user; every fourth came from the cache."""
    names = F.array(*map(F.lit, ("gemini-2.0-flash-001", "models/Gemini-2.5-Flash-Lite", "unknown", "llama-3.1-8b-instant", "gemini-pro-latest")))
    rows = read(spark, sf_dir, "events").select(
        "event_type",
        F.get(names, (F.col("user_id") % 5).cast("int")).alias("model"),
        (F.col("event_id") % 3000).alias("prompt_tokens"),
        (F.col("event_id") % 700).alias("completion_tokens"),
        (F.col("event_id") % 4 == 0).alias("cached"),
    )
    return usage.rollup(usage.priced(rows, usage.prices(spark)), "event_type")


LOOKUPS_SQL = "looked AS (SELECT event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400000000, false) AS hit FROM events)"


@query(f"WITH {LOOKUPS_SQL} SELECT event_type, count(*) AS lookups, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 4) AS rate FROM looked GROUP BY 1")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as lookups of a user's entry of each type, which lives for a day."""
    rows = read(spark, sf_dir, "events").withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    return usage.hit_rate(usage.cache_lookups(rows, 86_400), "event_type")


@query("WITH cache AS (SELECT user_id, max(ts) AS stored FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT DISTINCT e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.user_id = e.user_id AND c.stored > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a purchase in the week before the end of the events' month."""
    events = read(spark, sf_dir, "events")
    cache = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("stored"))
    return usage.misses(events.select("user_id").distinct(), cache, F.lit("2024-01-31 00:00:00").cast("timestamp"), 7 * 86_400, "user_id")


@query(
    """WITH s AS (SELECT event_type, epoch_us(ts) AS a, epoch_us(ts) + round(value * 60000000)::BIGINT AS b FROM events), e AS (SELECT event_type, a AS t, 1 AS d FROM s WHERE b > a UNION ALL SELECT event_type, b, -1 FROM s WHERE b > a),
t AS (SELECT event_type, t, sum(d) AS d FROM e GROUP BY 1, 2), o AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS open FROM t) SELECT event_type, max(open)::BIGINT AS peak FROM o GROUP BY 1"""
)
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as spans of `value` minutes: the most that were open at once."""
    return usage.peak_concurrency(read(spark, sf_dir, "events").withColumn("seconds", F.col("value") * 60), "event_type", "ts")


@query("SELECT event_id, left(sha256(coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id END, ''), 'host' || user_id) || '|' || event_type), 20) AS visitor FROM events")
def visitor_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 1.2.3.4"))).otherwise("")
    return read(spark, sf_dir, "events").select("event_id", text.visitor_id(F.concat(F.lit("host"), user), forwarded, F.col("event_type")).alias("visitor"))


QUOTA_SQL = """WITH RECURSIVE asked AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
walk(user_id, n, event_id, hist, allowed, remaining, retry_after) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], false, 0, 0 FROM (SELECT DISTINCT user_id FROM asked) UNION ALL
  SELECT user_id, n, event_id, CASE WHEN len(h) < 5 THEN list_append(h, s) ELSE h END, len(h) < 5, CASE WHEN len(h) < 5 THEN 4 - len(h)::INTEGER ELSE 0 END, CASE WHEN len(h) < 5 THEN 0 ELSE greatest(1, trunc(86400 - (s - h[1])))::INTEGER END
  FROM (SELECT a.user_id, a.n, a.event_id, a.s, list_filter(w.hist, lambda x: x >= a.s - 86400) AS h FROM walk w JOIN asked a ON a.user_id = w.user_id AND a.n = w.n + 1))
SELECT event_id, allowed, remaining, retry_after FROM walk WHERE n > 0"""


@query(QUOTA_SQL)
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five admissions of a user in any day."""
    return quota.visitor_quota(quota.requests(read(spark, sf_dir, "events")), 5, 86_400).select("event_id", "allowed", "remaining", "retry_after")


BUCKET_SQL = """WITH RECURSIVE asked AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS s, least(1 + event_id % 3, 4)::DOUBLE AS want, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, n, event_id, tokens, s, taken) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, 4.0::DOUBLE, min(s), false FROM asked GROUP BY user_id UNION ALL
  SELECT user_id, n, event_id, CASE WHEN t >= want THEN t - want ELSE t END, s, t >= want
  FROM (SELECT a.*, least(4.0::DOUBLE, w.tokens + (a.s - w.s) * (0.0005::DOUBLE / 60.0::DOUBLE)) AS t FROM walk w JOIN asked a ON a.user_id = w.user_id AND a.n = w.n + 1))
SELECT event_id, taken, round("tokens", 4) AS left_over FROM walk WHERE n > 0"""


@query(BUCKET_SQL)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket of four for each user, which takes a day and more to fill."""
    asked = quota.requests(read(spark, sf_dir, "events")).withColumn("amount", (1 + F.col("event_id") % 3).cast("double"))
    return quota.token_bucket(asked, 0.0005, 4).select("event_id", "taken", F.round("left", 4).alias("left_over"))


#: One walk over all requests in order of time, with what was served before and the day's count as state.
DAILY_SQL = """WITH RECURSIVE asked AS (SELECT event_id, user_id AS u, epoch_us(ts) / 1000000 AS s, ts::DATE AS d, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
everything AS MATERIALIZED (SELECT list({'event_id': event_id, 'u': u::BIGINT, 's': s::DOUBLE, 'd': d} ORDER BY n) AS l FROM asked),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::DATE AS d, 0 AS used, []::STRUCT(u BIGINT, s DOUBLE)[] AS served, '' AS scope, 0 AS retry_after UNION ALL
  SELECT n, event_id, d, used + (scope = '')::INTEGER, CASE WHEN scope = '' THEN list_append(kept, {'u': u, 's': s}) ELSE kept END, scope,
    CASE scope WHEN 'visitor' THEN greatest(1, trunc(86400 - (s - own[1].s)))::INTEGER WHEN 'global' THEN greatest(1, 86399 - floor(s % 86400))::INTEGER ELSE 0 END
  FROM (SELECT *, CASE WHEN len(own) >= 5 THEN 'visitor' WHEN used >= 200 THEN 'global' ELSE '' END AS scope
    FROM (SELECT *, list_filter(kept, lambda x: x.u = u) AS own
      FROM (SELECT w.n + 1 AS n, a.event_id, a.d, a.u, a.s, CASE WHEN a.d = w.d THEN w.used ELSE 0 END AS used, list_filter(w.served, lambda x: x.s >= a.s - 86400) AS kept
        FROM (SELECT w.*, l[w.n + 1] AS a FROM walk w, everything WHERE w.n < len(l)) w))))
SELECT event_id, scope = '' AS allowed, scope, retry_after FROM walk WHERE n > 0"""


@query(DAILY_SQL)
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five admissions of a user in any 24 hours and 200 a day for all."""
    return quota.budget(quota.requests(read(spark, sf_dir, "events")), 5, 86_400, 200).select("event_id", "allowed", "scope", "retry_after")


# Texts, plans, routes, reports


@query(
    f"""SELECT doc_id, 'emb:model-a:' || lang || ':64:' || sha256(text) AS cache_key, md5({PATH_SQL} || ' | block: ' || {PATH_SQL} || chr(10) || left(text, 8000)) AS embedding_text,
md5(array_to_string(list_filter([{PATH_SQL}, {PATH_SQL}, CASE WHEN doc_id % 2 = 0 THEN source END, text], lambda x: x <> ''), chr(10))) AS lexical_text, CASE WHEN doc_id % 2 = 0 THEN lang || '.' || source ELSE {PATH_SQL} END AS qualified FROM documents"""
)
def rendered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys, and digests of what is embedded and what is indexed of a chunk."""
    path = _path()
    symbol = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        text.cache_key(F.lit("model-a"), F.col("lang"), F.lit(64), F.col("text")).alias("cache_key"),
        F.md5(text.embedding_text(path, F.lit("block"), path, F.col("text"))).alias("embedding_text"),
        F.md5(text.lexical_text(path, path, symbol, F.col("text"))).alias("lexical_text"),
        text.qualified_name(path, F.col("lang"), symbol).alias("qualified"),
    )


@query(
    """WITH t AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w, CASE WHEN turn % 3 = 0 THEN [] WHEN turn % 3 = 1 THEN [' ' || role || ' ', role, '', text] ELSE ['a', 'b', 'a', 'c', 'd', 'e', 'f', 'g', 'h', 'i'] END AS s FROM conversations),
o AS (SELECT *, list_filter(list_transform(s, lambda x: trim(x)), lambda x: x <> '') AS own FROM t), d AS (SELECT *, list_filter(own, lambda x, i: list_position(own, x) = i) AS u FROM o),
b AS (SELECT *, CASE WHEN len(u) > 0 THEN u ELSE [text] END AS base FROM d)
SELECT conv_id, turn, array_to_string((CASE WHEN turn % 2 = 0 THEN list_append(base, array_to_string(w[1:6], ' ')) ELSE base END)[1:8], '|') AS queries FROM b"""
)
def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan's searches and hints become."""
    turn = F.col("turn")
    none = F.array().cast("array<string>")
    searches = F.when(turn % 3 == 0, none).when(turn % 3 == 1, F.array(F.concat(F.lit(" "), "role", F.lit(" ")), "role", F.lit(""), "text")).otherwise(F.array(*(F.lit(c) for c in "abacdefghi")))
    hints = F.when(turn % 2 == 0, F.split("text", " ")).otherwise(none)
    found = retrieval.planned_queries(F.col("text"), F.lit(""), searches, hints)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("queries"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN coalesce(CASE WHEN event_id % 10 = 0 THEN 7.5::DOUBLE END, least(90.0::DOUBLE, 4.0 * pow(2, event_id % 6))) ELSE least(20.0::DOUBLE, 0.75 * pow(2, event_id % 6)) END AS seconds FROM events")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    told = F.when(n % 10 == 0, F.lit(7.5))
    return read(spark, sf_dir, "events").select("event_id", usage.retry_delay((n % 6).cast("double"), n % 2 == 0, told).alias("seconds"))


@query(
    f"""WITH {UNIQUE_SQL}, r AS (SELECT * FROM six ORDER BY severity_rank, path, coalesce(line, 0), finding_id LIMIT 25),
x AS (SELECT severity_rank, path, coalesce(line, 0) AS l, '- **' || upper(severity) || '** `' || path || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || '` ' || title AS t FROM r)
SELECT coalesce((SELECT string_agg(n || ' ' || severity, ', ' ORDER BY severity_rank) FROM (SELECT severity, severity_rank, count(*) AS n FROM r GROUP BY ALL)) || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY severity_rank, path, l, t), 'No issues found.') AS markdown FROM x"""
)
def review_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.summary_markdown(diffs.deduplicated(_valid(spark, sf_dir)))


@query(
    f"""WITH {UNIQUE_SQL}, r AS (SELECT * FROM six ORDER BY severity_rank, path, coalesce(line, 0), finding_id LIMIT 25)
SELECT CASE WHEN coalesce(bool_or(severity_rank <= 1), false) THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event, count(*) FILTER (WHERE line IS NOT NULL) AS comments FROM r"""
)
def review_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a posted review asks for, and how many inline comments it has."""
    return diffs.review_payload(diffs.deduplicated(_valid(spark, sf_dir)), True).select("event", F.size("comments").cast("long").alias("comments"))


@query(
    """WITH c AS (SELECT conv_id AS review, turn AS comment_id, CASE WHEN turn % 3 = 1 THEN '<!-- mark -->' || text ELSE text END AS body FROM conversations), first AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY review ORDER BY comment_id) <= 100), own AS (SELECT review, min(comment_id) AS comment_id FROM first WHERE contains(body, '<!-- mark -->') GROUP BY 1)
SELECT DISTINCT review, '<!-- mark -->' || chr(10) || 'summary ' || review AS body, comment_id, CASE WHEN comment_id IS NULL THEN 'create' ELSE 'update' END AS action FROM c LEFT JOIN own USING (review) SELECT_"""
    .replace("SELECT DISTINCT review", "SELECT DISTINCT c.review").replace("'summary ' || review", "'summary ' || c.review").replace("comment_id, CASE WHEN comment_id", "own.comment_id, CASE WHEN own.comment_id").replace(" SELECT_", "")
)
def comment_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read as reviews' comments: each summary updates the first that carries its mark, or is new."""
    rows = read(spark, sf_dir, "conversations")
    marked = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<!-- mark -->"), "text")).otherwise(F.col("text"))
    comments = rows.select(F.col("conv_id").alias("review"), F.col("turn").alias("comment_id"), marked.alias("body"))
    wanted = rows.select(F.col("conv_id").alias("review")).distinct().withColumn("body", F.concat(F.lit("summary "), F.col("review").cast("string")))
    return diffs.upserts(wanted, comments, "<!-- mark -->")


@query(
    """WITH v AS (SELECT lang AS variant, rank() OVER (ORDER BY lang)::INTEGER AS position, round(avg(n_chars % 97) / 97, 4) AS recall FROM documents GROUP BY lang)
SELECT round((max(recall) FILTER (WHERE variant = 'fr') - max(recall) FILTER (WHERE variant = 'de')) / max(recall) FILTER (WHERE variant = 'de'), 4) AS lift, arg_max(variant, struct_pack(r := recall, p := -position)) AS best_variant FROM v"""
)
def variant_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better one variant is than another, and the best; languages stand for variants."""
    rows = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("variant")).agg(F.round(F.avg(F.col("n_chars") % 97) / 97, 4).alias("recall"))
    position = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("variant")).cast("int")
    return evaluation.lift(rows.withColumn("position", position), "de", "fr")


@query("SELECT avg(quality) >= 0.5 AND avg(toxic) >= 0.05 AS ok FROM labels")
def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").agg(F.avg("quality").alias("recall"), F.avg("toxic").alias("pass_rate"))
    return evaluation.gates(rows, 0.5, 0.05)


SPANS_SQL = "s AS (SELECT user_id AS trace, event_id AS span_id, CASE WHEN event_id % 4 > 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent_id, epoch_us(ts) AS start FROM events)"


@query(
    f"""WITH RECURSIVE {SPANS_SQL}, w(trace, span_id, start, depth) AS (SELECT trace, span_id, start, 0 FROM s WHERE parent_id IS NULL UNION ALL SELECT s.trace, s.span_id, s.start, w.depth + 1 FROM w JOIN s ON s.trace = w.trace AND s.parent_id = w.span_id)
SELECT trace, span_id, depth::INTEGER AS depth, (row_number() OVER (PARTITION BY trace ORDER BY start, span_id))::INTEGER AS place FROM w"""
)
def span_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans under the user's event before, three of four: their depth and order."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 4 > 0, before).alias("parent_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return usage.waterfall(rows).select("trace", "span_id", "depth", "place")


@query(
    """SELECT conv_id, turn, CASE WHEN v = 'refine' AND n > 0 THEN 'retrieve' ELSE 'finalise' END AS route, CASE WHEN coalesce(p, true) THEN 'retrieve' ELSE 'analyse' END AS first_route
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'refine' ELSE 'accept' END AS v, conv_id % 3 AS n, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 2 = 0 END AS p FROM conversations)"""
)
def agent_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pergola.plans import agent

    follow = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("conv_id") % 3).cast("int"))
    verdict = F.when(F.col("turn") % 2 == 0, "refine").otherwise("accept")
    needs = F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 2 == 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", agent.routed(verdict, follow).alias("route"), agent.first_route(needs).alias("first_route"))




@query(
    f"""WITH {INDEX_SQL}, asked AS (SELECT 'q' || i AS qid, t.term FROM (VALUES (0, ['the', 'handler']), (1, ['token', 'request', 'with'])) AS v(i, l), unnest(l) AS t(term) WHERE t.term NOT IN {_in(text.STOPWORDS)}), {scores_sql("lex", "asked", 6)}
SELECT qid, doc AS doc_id, score, rank FROM lex"""
)
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a diff's review: searches made of its terms, six results of each."""
    asked = spark.createDataFrame([("q0", "the handler"), ("q1", "token request with")], "qid string, text string")
    best = lexical.best(_index(spark, sf_dir), lexical.query_terms(asked, most=text.TOKENS), 6)
    return best.select("qid", F.col("doc").alias("doc_id"), "score", "rank")


@query(
    f"""WITH {UNIQUE_SQL} SELECT finding_id, '### ' || title || chr(10) || '`' || path || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || '` | ' || upper(severity) || ' | ' || category || ' | ' || printf('%.2f', confidence) || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END AS markdown FROM six ORDER BY severity_rank, path, coalesce(line, 0), finding_id LIMIT 25"""
)
def finding_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding of a report as a comment by itself."""
    return diffs.finding_markdown(diffs.deduplicated(_valid(spark, sf_dir)))


@query("SELECT event_id, CASE WHEN s = 429 THEN 'limited' WHEN s >= 500 OR s = 408 THEN 'transient' WHEN s >= 300 THEN 'rejected' END AS failure FROM (SELECT event_id, [200, 204, 301, 400, 401, 404, 408, 422, 429, 500, 502, 503][event_id % 12 + 1] AS s FROM events)")
def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hosted model's statuses ask for."""
    from pergola.plans import client

    status = F.get(F.array(*map(F.lit, (200, 204, 301, 400, 401, 404, 408, 422, 429, 500, 502, 503))), (F.col("event_id") % 12).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", client.failure(status).alias("failure"))


@query("SELECT event_id, greatest(1, 86399 - (epoch_us(ts) // 1000000) % 86400)::INTEGER AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts IS NOT NULL")
def day_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's UTC day, and the seconds to its end."""
    at = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", quota.seconds_left(F.unix_micros(at) / 1e6).alias("seconds"), F.date_format(at, "yyyy-MM-dd").alias("day"))


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || doc_id || ',"source":null}') AS stable, '### ' || source || ':3-9' || CASE WHEN doc_id % 2 = 0 THEN ' (' || lang || ')' ELSE '' END || chr(10) || 'x' AS rendered FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of fields in the order of their names, and chunks as prompts show them."""
    rows = read(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    fields = {"source": F.lit(None).cast("string"), "n": F.col("doc_id"), "lang": F.col("lang")}
    shown = text.rendered(F.col("source"), F.lit(3), F.lit(9), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("x"))
    return rows.select("doc_id", text.stable_hash(fields).alias("stable"), shown.alias("rendered"))
