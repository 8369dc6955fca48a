"""What a review asks of a model: a prompt for each changed file, with the code of the repository that is related to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergola.operators import diffs

#: Terms of the two searches of a file, and chunks of its context.
TERMS, TERMS_WITH_PATH = 6, 3
CHUNKS = 6
CONTEXT_CHARS = 18_000


def file_key() -> Column:
    """What tells a file of a diff from any other, of another diff or of the same path."""
    return F.concat_ws("#", F.col("diff_id").cast("string"), F.col("file_no").cast("string"))


def searches(marked: DataFrame) -> DataFrame:
    """key, path, queries, hints of each reviewable file that has terms: its foremost terms; its path and the first of them; the folder it is in."""
    listed = diffs.reviewable(diffs.files(marked)).select("diff_id", "file_no", "path")
    terms = diffs.search_terms(diffs.diff_lines(marked)).where(F.col("place") <= TERMS)
    own = terms.groupBy("diff_id", "file_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    joined = lambda n: F.array_join(F.slice("terms", 1, n), " ")
    folder = F.when(F.contains("path", F.lit("/")), F.array(F.regexp_replace("path", "/[^/]*$", ""))).otherwise(F.array().cast("array<string>"))
    return listed.join(own, ["diff_id", "file_no"]).select(file_key().alias("key"), "path", F.array(joined(TERMS), F.concat_ws(" ", "path", joined(TERMS_WITH_PATH))).alias("queries"), folder.alias("hints"))


def related(asked: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, doc, rank: the chunks found for all files at once, but for those of the file itself. asked: searches()."""
    found = retrieve(asked.select(F.col("key").alias("qid"), "queries", "hints"))
    own = asked.select(F.col("key").alias("qid"), F.col("path").alias("own"))
    return found.join(own, "qid").where(F.col("path") != F.col("own")).select(F.col("qid").alias("key"), "doc", "rank")


def bodies(marked: DataFrame) -> DataFrame:
    """key, path, body of each reviewable file: its lines in order, hunk by hunk, each with its mark and its new number."""
    listed = diffs.reviewable(diffs.files(marked)).select("diff_id", "file_no", "path")
    lines = diffs.diff_lines(marked).join(listed, ["diff_id", "file_no"])
    mark = F.when(F.col("type") == "added", "+").when(F.col("type") == "removed", "-").otherwise(" ")
    line = F.concat(mark, F.coalesce(F.col("new_line").cast("string"), F.lit("")), F.lit(" "), F.col("content"))
    each = lines.groupBy("diff_id", "file_no", "path").agg(F.sort_array(F.collect_list(F.struct("hunk_no", "position", line.alias("t")))).alias("l"))
    return each.select(file_key().alias("key"), "path", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("body"))


def prompts(marked: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """key, role, prompt of each reviewable file; contexts: key, context of those that have one."""
    rows = bodies(marked)
    if contexts is None:
        rows = rows.withColumn("context", F.lit(None).cast("string"))
    else:
        rows = rows.join(contexts.select("key", "context"), "key", "left")
    before = F.when(F.col("context") != "", F.concat(F.lit("From the same repository, not part of the change:\n\n"), "context", F.lit("\n\n"))).otherwise("")
    return rows.select("key", F.lit("review").alias("role"), F.concat(before, F.lit("Review this change of "), "path", F.lit(":\n"), "body").alias("prompt"))


def first(found: DataFrame, n: int = CHUNKS) -> DataFrame:
    """The n chunks of least rank of each key."""
    order = Window.partitionBy("key").orderBy("rank", "doc")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")
