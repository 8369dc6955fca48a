"""Citations of a draft, what they resolve to, how far the answer is to be trusted, and the context it is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CEILING = 0.97
MAX_CHARS = 90_000
LEAST_REST = 400
#: Characters at a path's end by which suffix matches are found.
TAIL = 24

BRACKET = "\\[([^\\[\\]]{3,400}?)\\]"
REFERENCE = "^\\s*([^\\s:]+?\\.[A-Za-z0-9_]+):([0-9]+)(?:\\s*[-–]\\s*([0-9]+))?\\s*$"
RANGE = "^\\s*([0-9]+)(?:\\s*[-–]\\s*([0-9]+))?\\s*$"


def citations(draft: Column) -> Column:
    """Array of structs path, first, last for the markers in square brackets.

    Inside a bracket a bare range takes the path before it; anything else ends that. One fold over a bracket's parts carries the path.
    """
    empty = F.struct(F.lit(None).cast("string").alias("path"), F.array().cast("array<struct<path:string,first:int,last:int>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        path = F.nullif(F.regexp_extract(part, REFERENCE, 1), F.lit(""))
        bare = path.isNull() & acc["path"].isNotNull() & part.rlike(RANGE)
        own = F.when(path.isNotNull(), path).when(bare, acc["path"])
        a = F.when(path.isNotNull(), F.regexp_extract(part, REFERENCE, 2)).otherwise(F.regexp_extract(part, RANGE, 1)).try_cast("int")
        b = F.when(path.isNotNull(), F.regexp_extract(part, REFERENCE, 3)).otherwise(F.regexp_extract(part, RANGE, 2)).try_cast("int")
        b = F.coalesce(b, a)
        one = F.array(F.struct(own.alias("path"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last")))
        return F.struct(own.alias("path"), F.when(own.isNotNull(), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    brackets = F.regexp_extract_all(F.coalesce(draft, F.lit("")), F.lit(BRACKET), F.lit(1))
    return F.flatten(F.transform(brackets, lambda b: F.aggregate(F.split(b, ","), empty, step, lambda acc: acc["found"])))


def resolved(cited: DataFrame, paths: DataFrame) -> DataFrame:
    """cited (any columns with path) with `resolved`: the path itself if known, else the shortest known path that ends in it, then by name; null if none.

    The suffix match is an equality of the last TAIL characters with a check of the rest, so it stays a hash join. For a path no longer than that the
    known paths of each ending are cut to the best one first, so that a name that many folders have is one row and not all of them.
    """
    known = paths.select(F.col("path").alias("known")).distinct()
    wanted = cited.select("path").distinct()
    exact = wanted.join(known, F.col("path") == F.col("known"), "left_semi")
    rest = wanted.join(exact, "path", "left_anti").withColumn("n", F.length("path"))
    best = F.min(F.struct(F.length("known").alias("n"), F.col("known").alias("known")))["known"].alias("resolved")
    ends = known.select("known", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(TAIL), F.length("known"))), lambda n: F.right(F.col("known"), n))).alias("path")).groupBy("path").agg(best)
    short = rest.where(F.col("n") <= TAIL).join(ends, "path").select("path", "resolved")
    tails = known.where(F.length("known") >= TAIL).withColumn("tail", F.right("known", F.lit(TAIL)))
    long = rest.where(F.col("n") > TAIL).withColumn("tail", F.right("path", F.lit(TAIL))).join(tails, "tail").where(F.endswith("known", F.col("path"))).groupBy("path").agg(best)
    found = short.unionByName(long)
    all_found = exact.select("path", F.col("path").alias("resolved")).unionByName(found)
    return cited.join(all_found, "path", "left")


def located(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """cited (key, path, first, last) with symbol and excerpt of the first chunk of that file that holds its first line.

    chunks: path, start_line, end_line, symbol, body (their lines without a header). The excerpt has six lines and 600 characters at most.
    """
    near = cited.join(chunks, "path").where(F.col("first").between(F.col("start_line"), F.col("end_line")))
    lines = F.slice(F.split("body", "\n"), F.col("first") - F.col("start_line") + 1, F.least(F.lit(6), F.col("last") - F.col("first") + 1))
    best = near.groupBy("key", "path", "first", "last").agg(
        F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.struct("start_line", "end_line"))).alias("symbol"),
        F.min_by(F.substring(F.array_join(lines, "\n"), 1, 600), F.struct("start_line", "end_line")).alias("excerpt"),
    )
    return cited.join(best, ["key", "path", "first", "last"], "left")


def confidence(base: Column, grounded: Column, complete: Column, citations: Column, overlap: Column, invalid: Column, errors: Column) -> Column:
    """How far an answer is to be trusted, 0 to CEILING, from the critic's own figure and what became of the citations."""
    value = F.coalesce(base, F.lit(0.5))
    value = value * F.when(~F.coalesce(grounded, F.lit(True)), 0.55).otherwise(1.0)
    value = value * F.when(~F.coalesce(complete, F.lit(True)), 0.8).otherwise(1.0)
    with_some = F.least(F.lit(1.0), value * (0.7 + 0.3 * overlap) * (1.0 + 0.04 * F.least(citations, F.lit(5))))
    value = F.when(citations == 0, value * 0.6).otherwise(with_some)
    share = invalid / F.greatest(F.lit(1), invalid + citations)
    value = F.when(invalid > 0, value * F.greatest(F.lit(0.55), 1.0 - 0.6 * share)).otherwise(value)
    value = F.when(errors > 0, value * 0.9).otherwise(value)
    # A double's decimals and its thousandfold fall on different sides of a half: the thousandfold decides, as in SQL on doubles.
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(CEILING), value)) * 1000) / 1000


def packed(ranked: DataFrame, most: int = MAX_CHARS, least_rest: int = LEAST_REST) -> DataFrame:
    """qid, rank, taken: how many characters of each ranked content (qid, rank, chars) fit; the one that passes `most` is cut, and ends the context if less than least_rest is left."""
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.withColumn("used", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    rows = rows.withColumn("stop", (F.col("used") + F.col("chars") > most).cast("int"))
    earlier = rows.withColumn("stopped", F.coalesce(F.max("stop").over(before), F.lit(0)))
    fits = (F.col("stopped") == 0) & ((F.col("stop") == 0) | (most - F.col("used") >= least_rest))
    return earlier.where(fits).select("qid", "rank", F.least(F.col("chars"), F.lit(most) - F.col("used")).cast("long").alias("taken"))


def budgeted(ranked: DataFrame, most: int) -> DataFrame:
    """qid, rank, cost of what a greedy pass keeps: each item that still fits, whatever was left out before. One fold over a query's list, which a shortlist bounds."""
    items = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "cost"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(items.schema["items"].dataType).alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["cost"] > most, a).otherwise(F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept")))
    return items.select("qid", F.explode(F.aggregate("items", start, step, lambda a: a["kept"])).alias("x")).select("qid", "x.rank", "x.cost")


def judged(correct: Column, grounded: Column, complete: Column) -> tuple[Column, Column]:
    """A judge's overall mark and whether the answer passes; a missing mark counts as 3."""
    c, g, m = (F.coalesce(x, F.lit(3)) for x in (correct, grounded, complete))
    overall = F.round(0.45 * c + 0.35 * g + 0.20 * m, 3)
    return overall, (F.least(c, g, m) >= 3) & (overall >= 3.5)
