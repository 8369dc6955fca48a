"""Questions to answers with citations: plan, retrieve, write, criticise, and again while the critic asks for it. All questions go through a round together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergola.functions.text import json_value, location, preview
from pergola.operators import answers, fusion, lexical, retrieval, vectors
from pergola.plans.provider import Provider
from pergola.session import materialise

PLAN = "intent string, restated_question string, search_queries array<string>, keyword_hints array<string>, path_hints array<string>, needs_retrieval boolean"
CRITIQUE = "grounded boolean, complete boolean, confidence double, follow_up_queries array<string>, verdict string"
MAX_REFINEMENTS = 2
MAP_CHARS = 14_000
#: The answer where nothing was found to answer from.
NOTHING = "I could not find anything in the index that answers this."
FOLLOW_UPS = 5

Retrieve = Callable[[DataFrame], DataFrame]


def checked(questions: DataFrame, least: int = 3, most: int = 4000) -> DataFrame:
    """Questions (qid, question) of an admissible length; the others are an error."""
    n = F.length(F.trim("question"))
    return questions.where(F.assert_true(F.coalesce(n.between(least, most), F.lit(False)), F.lit(f"a question has {least} to {most} characters")).isNull())


def planned(questions: DataFrame, provider: Provider) -> DataFrame:
    """qid, question, queries, needs_retrieval: the plan's queries; a plan that can't be read leaves the question itself."""
    replies = provider.complete(questions.select(F.col("qid").alias("key"), F.lit("plan").alias("role"), F.col("question").alias("prompt")))
    plan = F.from_json(json_value(F.col("reply")), PLAN)
    rows = questions.join(replies.select(F.col("key").alias("qid"), plan.alias("p")), "qid", "left")
    none = F.array().cast("array<string>")
    queries = retrieval.planned_queries(F.col("question"), F.col("p.restated_question"), F.coalesce("p.search_queries", none), F.coalesce("p.keyword_hints", none))
    return rows.select("qid", "question", retrieval.normal_queries(queries).alias("queries"), F.coalesce("p.needs_retrieval", F.lit(True)).alias("needs_retrieval"))


def retriever(chunks: DataFrame, index: lexical.LexicalIndex, provider: Provider | None = None, vectors_of: DataFrame | None = None, top_k: int = retrieval.TOP_K, candidates: int = retrieval.CANDIDATES, expand: bool = True, most: int | None = None) -> Retrieve:
    """qid, queries -> qid, doc, path, score, rank: every query of a question ranked lexically, and densely if there are vectors, all fused; paths that hold a
    question's hints, if it has a column of them, weigh more. most: where texts of queries are cut."""

    def run(asked: DataFrame) -> DataFrame:
        each = asked.select("qid", F.posexplode("queries").alias("n", "text"))
        each = each.withColumn("key", F.concat_ws("#", "qid", "n"))
        terms = lexical.query_terms(each, "key", most=most)
        found = lexical.best(index, terms, candidates).select("qid", "doc", "rank", F.lit("lexical").alias("family"), F.lit(fusion.LEXICAL_WEIGHT).alias("weight"))
        if vectors_of is not None and provider is not None:
            asked_vectors = provider.embed(each.select("key", "text")).where("embedding IS NOT NULL").select(F.col("key").alias("qid"), "embedding")
            dense = vectors.nearest(vectors_of, asked_vectors, candidates, key="doc")
            found = found.unionByName(dense.select("qid", "doc", "rank", F.lit("dense").alias("family"), F.lit(fusion.DENSE_WEIGHT).alias("weight")))
        named = found.select(F.substring_index("qid", "#", -1).alias("n"), F.regexp_replace("qid", "#[0-9]+$", "").alias("qid"), "doc", F.col("rank").cast("int").alias("rank"), "family", "weight")
        ranked = named.select("qid", "doc", "rank", F.concat("family", F.lit("["), "n", F.lit("]")).alias("retriever"), "weight")
        return retrieval.retrieve(ranked, chunks.select("doc", "path", F.col("start_line").alias("start"), *(["at"] if "at" in chunks.columns else [])), asked if "hints" in asked.columns else None, top_k, expand)

    return run


def context(found: DataFrame, chunks: DataFrame, most: int = answers.MAX_CHARS) -> DataFrame:
    """qid, context: the retrieved chunks in order, as many as fit in `most` characters, each under its place."""
    rows = found.select("qid", "doc", "rank").join(chunks.select("doc", "path", "start_line", "end_line", "language", "content"), "doc")
    sized = rows.withColumn("chars", F.length("content").cast("long")).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc")))
    fits = answers.packed(sized.select("qid", F.col("place").alias("rank"), "chars"), most).withColumnRenamed("rank", "place")
    kept = sized.join(fits, ["qid", "place"])
    body = F.concat(F.substring("content", F.lit(1), F.col("taken").cast("int")), F.when(F.col("taken") < F.col("chars"), "\n... (snippet truncated)").otherwise(""))
    text = F.concat(F.lit("### Snippet "), F.col("place").cast("string"), F.lit(" - "), location(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit("\n```"), "language", F.lit("\n"), body, F.lit("\n```"))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def context_summary(found: DataFrame, chunks: DataFrame, most: int = 40) -> DataFrame:
    """qid, summary: a line for each of the first `most` chunks, then how many more there are."""
    rows = found.select("qid", "doc", "rank").join(chunks.select("doc", "path", "start_line", "end_line", "content"), "doc")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc"))
    rows = rows.withColumn("place", place).withColumn("all", F.count("*").over(Window.partitionBy("qid"))).where(F.col("place") <= most)
    line = F.concat(F.col("place").cast("string"), F.lit(". "), location(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(" "), preview(F.col("content")))
    lines = rows.groupBy("qid", "all").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]).alias("lines"))
    more = F.when(F.col("all") > most, F.array(F.concat(F.lit("... and "), (F.col("all") - most).cast("string"), F.lit(" more snippets")))).otherwise(F.array().cast("array<string>"))
    return lines.select("qid", F.array_join(F.concat("lines", more), "\n").alias("summary"))


def routed(verdict: Column, follow_ups: Column) -> Column:
    """Where a criticised draft goes: retrieve again, or finalise."""
    return F.when((verdict == "refine") & (F.size(follow_ups) > 0), "retrieve").otherwise("finalise")


def first_route(needs_retrieval: Column) -> Column:
    """Where a planned question goes; without a plan it retrieves."""
    return F.when(F.coalesce(needs_retrieval, F.lit(True)), "retrieve").otherwise("analyse")


def criticised(drafts: DataFrame, provider: Provider, refinements: int, max_refinements: int) -> DataFrame:
    """drafts (qid, draft) with grounded, complete, critic, follow_ups, verdict. An unreadable critique accepts at 0.5; with no round left all are accepted."""
    replies = provider.complete(drafts.select(F.col("qid").alias("key"), F.lit("critique").alias("role"), F.col("draft").alias("prompt")))
    rows = drafts.join(replies.select(F.col("key").alias("qid"), F.from_json(json_value(F.col("reply")), CRITIQUE).alias("c")), "qid", "left")
    none = F.array().cast("array<string>")
    verdict = F.lit("accept") if refinements >= max_refinements else F.coalesce("c.verdict", F.lit("accept"))
    return rows.select(
        "qid",
        "draft",
        F.coalesce("c.grounded", F.lit(True)).alias("grounded"),
        F.coalesce("c.complete", F.lit(True)).alias("complete"),
        F.coalesce("c.confidence", F.lit(0.5)).alias("critic"),
        F.slice(F.coalesce("c.follow_up_queries", none), 1, FOLLOW_UPS).alias("follow_ups"),
        verdict.alias("verdict"),
    )


def finalised(drafts: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, draft, confidence, citations, invalid: what the draft cites that is known, and how far it is to be trusted."""
    cited = drafts.select(F.col("qid").alias("key"), F.explode(answers.citations(F.col("draft"))).alias("c")).select("key", "c.*")
    solved = answers.resolved(cited, chunks.select("path").distinct())
    invalid = solved.where("resolved IS NULL").groupBy("key").agg(F.count("*").alias("invalid"))
    good = solved.where("resolved IS NOT NULL").select("key", F.col("resolved").alias("path"), "first", "last").distinct()
    seen = found.select(F.col("qid").alias("key"), "path").distinct().withColumn("seen", F.lit(1))
    share = good.select("key", "path").distinct().join(seen, ["key", "path"], "left").groupBy("key").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("overlap"))
    listed = good.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("path", "first", "last"))).alias("citations"))
    rows = drafts
    for part in (invalid, share, listed):
        rows = rows.join(part.withColumnRenamed("key", "qid"), "qid", "left")
    n, bad = F.coalesce(F.size("citations"), F.lit(0)), F.coalesce("invalid", F.lit(0))
    n = F.greatest(n, F.lit(0))
    sure = answers.confidence(F.col("critic"), F.col("grounded"), F.col("complete"), n, F.coalesce("overlap", F.lit(0.0)), bad, F.lit(0))
    return rows.select("qid", "draft", sure.alias("confidence"), "citations", bad.alias("invalid"), "refinements")


def ask(questions: DataFrame, chunks: DataFrame, retrieve: Retrieve, provider: Provider, max_refinements: int = MAX_REFINEMENTS, overview: str = "") -> DataFrame:
    """qid, draft, confidence, citations, invalid, refinements for each question (qid string, question).

    A round is a handful of plans over all questions still open and is written down before the next, so the loop is as long as
    max_refinements + 1 and no longer, and its lineage does not grow. chunks: doc, path, start_line, end_line, language, content.
    A question whose plan needs no retrieval is answered from the repository's map, cut at MAP_CHARS. Where there is neither context nor map no model
    is asked: the answer is NOTHING, with no confidence.
    """
    plan = materialise(planned(questions, provider))
    asked = plan.where(first_route(F.col("needs_retrieval")) == "retrieve").select("qid", "queries")
    found = materialise(retrieve(asked).select("qid", "doc", "path", F.col("score").alias("final_score"), "rank"))
    by_map = (first_route(F.col("needs_retrieval")) != "retrieve") & F.lit(bool(overview))
    open_ = plan.select("qid", "question", F.when(by_map, F.lit(overview[:MAP_CHARS])).alias("map"))
    done = None
    for n in range(max_refinements + 1):
        prompt = F.concat_ws("\n\n", "question", "map", "context")
        prompts = materialise(open_.join(context(found, chunks), "qid", "left"))
        bare = prompts.where("map IS NULL AND context IS NULL").select("qid", F.lit(NOTHING).alias("draft"), F.lit(False).alias("grounded"), F.lit(False).alias("complete"), F.lit(0.0).alias("critic"), F.array().cast("array<string>").alias("follow_ups"), F.lit("accept").alias("verdict"))
        full = prompts.where("map IS NOT NULL OR context IS NOT NULL").select(F.col("qid").alias("key"), F.lit("answer").alias("role"), prompt.alias("prompt"))
        drafts = provider.complete(full).select(F.col("key").alias("qid"), F.coalesce("reply", F.lit("")).alias("draft"))
        judged = materialise(criticised(drafts, provider, n, max_refinements).unionByName(bare).withColumn("refinements", F.lit(n)))
        again = judged.where(routed(F.col("verdict"), F.col("follow_ups")) == "retrieve")
        ended = judged.join(again.select("qid"), "qid", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        if n == max_refinements or again.limit(1).count() == 0:
            break
        fresh = retrieve(again.select("qid", F.col("follow_ups").alias("queries"))).select("qid", "doc", "path", F.col("score").alias("final_score"))
        merged = retrieval.merged(found.select("qid", "doc", "path", "final_score"), fresh)
        found = materialise(merged.select("qid", "doc", "path", "final_score", "rank"))
        open_ = open_.join(again.select("qid"), "qid", "left_semi")
    return finalised(done, found, chunks)
