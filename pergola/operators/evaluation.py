"""Retrieval and answer metrics for many cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergola.functions.paths import normal_path, same_path


def retrieval_metrics(retrieved: DataFrame, expected: DataFrame, k: int | None = None) -> DataFrame:
    """A row for each case of `expected` (case_id, path) from `retrieved` (case_id, rank, path).

    Paths count once, at their first rank, and the first k of them; a path is relevant if it matches any expected one. A case's paths meet
    only its own expected ones, by an equality of case_id.
    """
    wanted = expected.select("case_id", F.col("path").alias("want")).distinct()
    seen = retrieved.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "path"))
    ranked = seen.withColumn("place", place)
    if k is not None:
        ranked = ranked.where(F.col("place") <= k)
    met = ranked.join(wanted, "case_id").where(same_path(normal_path(F.col("path")), normal_path(F.col("want"))))
    relevant = met.groupBy("case_id", "place").agg(F.lit(1).alias("rel"))
    matched = met.groupBy("case_id").agg(F.countDistinct("want").alias("matched"))
    gains = relevant.groupBy("case_id").agg(F.count("*").alias("hits"), F.min("place").alias("first_rank"), F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"))
    sizes = ranked.groupBy("case_id").agg(F.count("*").alias("retrieved"))
    cases = wanted.groupBy("case_id").agg(F.count("*").alias("expected"))
    rows = cases.join(sizes, "case_id", "left").join(matched, "case_id", "left").join(gains, "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    best = F.least(F.col("expected"), F.when(n("retrieved") > 0, n("retrieved")).otherwise(F.lit(1)))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), best), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return rows.select(
        "case_id",
        F.round(n("matched") / F.col("expected"), 6).alias("recall"),
        F.round(F.when(n("retrieved") > 0, n("hits") / n("retrieved")).otherwise(0.0), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
        (n("matched") > 0).alias("hit"),
        F.col("first_rank").cast("int").alias("first_rank"),
        n("retrieved").cast("long").alias("retrieved"),
        F.col("expected").cast("long").alias("expected"),
    )


def missed(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, path of what no retrieved path matches."""
    want = expected.select("case_id", F.col("path").alias("want")).distinct()
    met = retrieved.select("case_id", F.col("path").alias("got")).distinct().join(want, "case_id").where(same_path(normal_path(F.col("got")), normal_path(F.col("want"))))
    return want.join(met.select("case_id", "want").distinct(), ["case_id", "want"], "left_anti").select("case_id", F.col("want").alias("path"))


def averages(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over cases to four places; the mean first rank over cases with a hit, 0 without any."""
    mean = lambda c: F.round(F.avg(c), 4)
    return metrics.groupBy(*by).agg(
        F.count("*").alias("cases"),
        mean(F.col("hit").cast("int")).alias("hit_rate"),
        mean("recall").alias("recall"),
        mean("precision").alias("precision"),
        mean("mrr").alias("mrr"),
        mean("ndcg").alias("ndcg"),
        F.round(F.coalesce(F.avg("first_rank"), F.lit(0.0)), 2).alias("mean_first_rank"),
    )


def citation_validity(cited: DataFrame, paths: DataFrame, key: str = "key") -> DataFrame:
    """key, citations, valid_rate: the share of a draft's cited paths that are known."""
    known = paths.select("path").distinct().withColumn("known", F.lit(1))
    return cited.join(known, "path", "left").groupBy(key).agg(F.count("*").alias("citations"), F.round(F.avg(F.coalesce("known", F.lit(0))), 4).alias("valid_rate"))


def run_summary(answers: DataFrame) -> DataFrame:
    """One row for a run: answers has error, passed (null if not judged), confidence, citations, hallucinations, latency, cost, tokens, refinements."""
    good = F.col("error").isNull()
    judged = good & F.col("passed").isNotNull()
    mean = lambda c, places: F.round(F.coalesce(F.avg(F.when(good, c)), F.lit(0.0)), places)
    return answers.agg(
        F.count_if(good).alias("answered"),
        F.count_if(~good).alias("failed"),
        F.round(F.coalesce(F.avg(F.when(judged, F.col("passed").cast("int"))), F.lit(0.0)), 4).alias("pass_rate"),
        mean(F.col("confidence"), 4).alias("mean_confidence"),
        mean(F.col("citations"), 2).alias("mean_citations"),
        mean(F.col("latency"), 2).alias("mean_latency_s"),
        mean(F.col("cost"), 6).alias("mean_cost_usd"),
        F.coalesce(F.floor(F.avg(F.when(good, F.col("tokens")))), F.lit(0)).cast("long").alias("mean_tokens"),
        F.coalesce(F.sum(F.when(good, F.col("refinements"))), F.lit(0)).cast("long").alias("refinements"),
        F.count_if(judged & (F.col("hallucinations") > 0)).alias("hallucination_cases"),
    )


def lift(variants: DataFrame, baseline: str = "dense only", best: str = "full pipeline") -> DataFrame:
    """lift of recall over the baseline, null where that is 0, and the variant (variant, position, recall) of greatest recall, the first among equals."""
    of = lambda name: F.max(F.when(F.col("variant") == name, F.col("recall")))
    base = F.coalesce(of(baseline), F.lit(0.0))
    return variants.agg(
        F.when(base != 0, F.round((F.coalesce(of(best), F.lit(0.0)) - base) / base, 4)).alias("lift"),
        F.max_by("variant", F.struct("recall", -F.col("position"))).alias("best_variant"),
    )


def gates(summary: DataFrame, min_recall: float, min_pass_rate: float) -> DataFrame:
    """Whether a run may pass: recall and pass_rate at their least or more."""
    return summary.select(((F.col("recall") >= min_recall) & (F.col("pass_rate") >= min_pass_rate)).alias("ok"))


def bar(value: Column, width: int = 18) -> Column:
    """A share as a bar of '#'."""
    return F.repeat(F.lit("#"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * width, 0).cast("int"))


def share(value: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(value * 100, 1), F.lit("%")), F.lit("n/a"))


#: Headline rows of a report: what a run_summary() column is called, and how it is written.
HEADLINE = (
    ("Answer pass rate", "pass_rate", share),
    ("Mean confidence", "mean_confidence", lambda c: F.format_string("%.2f", c)),
    ("Mean citations per answer", "mean_citations", lambda c: F.format_string("%.1f", c)),
    ("Cases with hallucinations", "hallucination_cases", lambda c: c.cast("string")),
    ("Mean latency", "mean_latency_s", lambda c: F.format_string("%.1fs", c)),
    ("Mean cost per answer", "mean_cost_usd", lambda c: F.format_string("$%.5f", c)),
    ("Mean tokens per answer", "mean_tokens", lambda c: F.format_number(c, 0)),
)


def report(summary: DataFrame, variants: DataFrame, cases: DataFrame, title: str = "Evaluation report") -> DataFrame:
    """One row, markdown: the run's headline figures, a row and a bar for each variant (position, variant, hit_rate, recall, precision, mrr, ndcg), a row for each
    case (case_id, category, error, passed, overall, confidence, recall, citations), and the cases that failed."""
    table = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    listed = lambda rows, order, text: rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("text")))), lambda x: x["text"]), "\n").alias("t"))
    number = lambda c: F.format_string("%.3f", F.col(c))
    head = summary.select(F.concat_ws("\n", *(table(F.lit(name), form(F.col(column))) for name, column, form in HEADLINE)).alias("head"))
    ways = listed(variants, ["position"], table(F.concat(F.lit("**"), "variant", F.lit("**")), share(F.col("hit_rate")), share(F.col("recall")), share(F.col("precision")), number("mrr"), number("ndcg")))
    bars = listed(variants, ["position"], F.concat(F.rpad("variant", 18, " "), F.lit(" "), F.rpad(bar(F.col("recall")), 18, "."), F.lit(" "), number("recall")))
    failed = F.col("error").isNotNull()
    verdict = F.when(failed, "ERROR").otherwise(F.concat(F.coalesce(F.col("overall").cast("string"), F.lit("-")), F.when(F.col("passed"), " (pass)").otherwise(" (fail)")))
    each = listed(cases, ["case_id"], table(F.concat(F.lit("`"), "case_id", F.lit("`")), "category", verdict, F.when(failed, "-").otherwise(F.format_string("%.2f", "confidence")), F.when(failed, "-").otherwise(share(F.col("recall"))), F.when(failed, "-").otherwise(F.col("citations").cast("string"))))
    weak = listed(cases.where(failed | ~F.coalesce("passed", F.lit(True))), ["case_id"], F.concat(F.lit("- `"), "case_id", F.lit("` "), F.coalesce("error", F.lit("did not pass"))))
    one = head.crossJoin(ways.withColumnRenamed("t", "ways")).crossJoin(bars.withColumnRenamed("t", "bars")).crossJoin(each.withColumnRenamed("t", "each")).crossJoin(weak.withColumnRenamed("t", "weak"))
    parts = [F.lit(f"# {title}\n\n## Headline\n\n| Metric | Value |\n|-|-|"), "head", F.lit("\n## Variants\n\n| Variant | hit rate | recall | precision | MRR | nDCG |\n|-|-|-|-|-|-|"), "ways", F.lit("\n```"), "bars", F.lit("```\n\n## Cases\n\n| Case | Category | Judge | Confidence | Recall | Citations |\n|-|-|-|-|-|-|"), "each"]
    tail = F.when(F.col("weak") != "", F.concat(F.lit("\n\n## Failures and weak answers\n\n"), "weak")).otherwise("")
    return one.select(F.concat(F.concat_ws("\n", *parts), tail, F.lit("\n")).alias("markdown"))
