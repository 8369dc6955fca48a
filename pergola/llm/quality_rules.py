"""Quality statistics in native expressions, and decision lists learnt on them by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergola.llm._arrow import documents

#: Labelled rows the rules are learnt from at most, by a hash of their id.
SAMPLE_ROWS = 20_000
#: Rules, conditions in a rule, thresholds tried for a statistic.
MOST_RULES = 12
MOST_CONDITIONS = 3
THRESHOLDS = 24
#: A rule is kept if so large a share of the pruning rows that it rejects is labelled low, and it rejects so many at least.
LEAST_PRECISION = 0.9
LEAST_ROWS = 5

SPACE = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

#: What the rules see: name -> expression over the statistics' columns.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def statistics(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the counts of each whole text, in JVM expressions alone: no row leaves its partition.

    n_repeat_words: three-word windows are 64-bit hashes; those of a text that has a repeat are sorted with their places, equal neighbours
    mark windows found twice or more, and the places they cover are counted once. Null texts count as empty.
    """
    rows = documents(df, text=text, key=key).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_CHAR)).alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
        ).alias("windows"),
    )
    kept = ["doc_id", "n", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits", "n_lines", "n_dup_lines", "n_distinct_words"]
    has_repeat = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(*kept, F.when(has_repeat, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    repeated = F.filter("ordered", lambda e, j: (e["h"] == F.get("ordered", j - 1)["h"]) | (e["h"] == F.get("ordered", j + 1)["h"]))
    rows = rows.select(*kept, F.transform(repeated, lambda e: e["i"]).alias("at"))
    covered = F.size(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2))))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        *kept[2:],
        F.when(F.col("at").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def _holds(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= (x[c.feature] >= c.threshold) if c.at_least else (x[c.feature] < c.threshold)
    return out


def _grow(x: dict[str, np.ndarray], low: np.ndarray) -> list[Condition]:
    """Adds the condition of greatest information gain while it gains."""
    rule: list[Condition] = []
    inside = np.ones(len(low), bool)
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = int((inside & low).sum()), int((inside & ~low).sum())
        if not p0 or not n0:
            break
        best, chosen = 1e-9, None
        for name, values in x.items():
            for t in np.unique(np.quantile(values[inside & low], np.linspace(0, 1, THRESHOLDS))):
                for at_least in (True, False):
                    held = inside & ((values >= t) if at_least else (values < t))
                    p, n = int((held & low).sum()), int((held & ~low).sum())
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                    if gain > best:
                        best, chosen = gain, Condition(name, at_least, float(t))
        if chosen is None:
            break
        rule.append(chosen)
        inside = _holds(rule, x)
    return rule


def _pruned(rule: list[Condition], x: dict[str, np.ndarray], low: np.ndarray) -> tuple[list[Condition], float, int]:
    """The prefix of the rule that does best on rows it was not grown on, with its precision there and the rows it covers."""
    best = ([], 0.0, 0)
    for n in range(1, len(rule) + 1):
        held = _holds(rule[:n], x)
        rows, hits = int(held.sum()), int((held & low).sum())
        if rows and hits / rows > best[1]:
            best = (rule[:n], hits / rows, rows)
    return best


def learn(x: dict[str, np.ndarray], low: np.ndarray) -> list[list[Condition]]:
    """Ordered rejecting rules: each is grown on two thirds of the rows that earlier rules leave, pruned on the rest, and kept if precise there."""
    grown_on = np.arange(len(low)) % 3 != 2
    rules: list[list[Condition]] = []
    left = np.ones(len(low), bool)
    while len(rules) < MOST_RULES:
        grow, prune = left & grown_on, left & ~grown_on
        if not (grow & low).any() or not prune.any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, low[grow])
        rule, precision, rows = _pruned(rule, {k: v[prune] for k, v in x.items()}, low[prune])
        if not rule or precision < LEAST_PRECISION or rows < LEAST_ROWS:
            break
        rules.append(rule)
        left &= ~_holds(rule, x)
    return rules


def training_rows(stats_of: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, quality: str = "quality", key: str = "doc_id") -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The features of at most `sample` labelled documents, in order of a hash of their id, and whether they are labelled low.

    Null ids and labels teach nothing; of several labels of a document the lowest counts.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col(quality).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = documents(stats_of).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(joined).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("order"), "label", *(F.expr(e).alias(k) for k, e in FEATURES.items())).collect()
    rows.sort(key=lambda r: (r["order"], *r[1:]))
    return {k: np.array([r[k] for r in rows], float) for k in FEATURES}, np.array([r["label"] == 0 for r in rows], bool)


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression over the statistics: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def judge(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each document with base_failed and kept; kept is false where base_failed, else the learnt list's verdict.

    Without labelled rows of both kinds the list is empty and keeps all that does not fail the base rules. A repeated row gives a row each.
    """
    x, low = training_rows(df, labels)
    rules = learn(x, low) if low.any() and not low.all() else []
    return statistics(df).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
