"""What calls cost, how spans add up, what a cache saves, how many ran at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pergola.session import materialise

# Dollars a million tokens in and out by the start of a model's name.
PRICES = (
    ("gemini-flash-lite-latest", 0.10, 0.40), ("gemini-flash-latest", 0.30, 2.50), ("gemini-pro-latest", 1.25, 10.00), ("gemini-3-flash", 0.30, 2.50),
    ("gemini-3-pro", 1.25, 10.00), ("gemini-2.5-pro", 1.25, 10.00), ("gemini-2.5-flash-lite", 0.10, 0.40), ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-2.0-flash-lite", 0.075, 0.30), ("gemini-2.0-flash", 0.10, 0.40), ("gemini-1.5-flash", 0.075, 0.30), ("gemini-1.5-pro", 1.25, 5.00),
    ("text-embedding-004", 0.0, 0.0), ("gemini-embedding-001", 0.15, 0.0), ("gemini-embedding-2", 0.15, 0.0),
    ("llama-3.3-70b-versatile", 0.59, 0.79), ("llama-3.1-8b-instant", 0.05, 0.08),
)
FALLBACK = (0.10, 0.40)


def prices(spark: SparkSession) -> DataFrame:
    """prefix, price_in, price_out: a table of fixed size."""
    return spark.createDataFrame(list(PRICES), "prefix string, price_in double, price_out double")


def model_name(model: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(model)), "^models/", "")


def priced(calls: DataFrame, table: DataFrame) -> DataFrame:
    """calls (model, prompt_tokens, completion_tokens) with price_in, price_out and cost.

    The longest prefix of the name decides, else the fallback. Only distinct names are matched with the table, so calls are joined by equality.
    """
    names = calls.select("model").distinct().withColumn("name", model_name(F.col("model")))
    found = names.join(F.broadcast(table), F.startswith("name", F.col("prefix"))).groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("p"))
    rows = calls.join(found, "model", "left")
    a, b = F.coalesce("p.price_in", F.lit(FALLBACK[0])), F.coalesce("p.price_out", F.lit(FALLBACK[1]))
    cost = F.round((F.col("prompt_tokens") * a + F.col("completion_tokens") * b) / 1_000_000, 8)
    return rows.select(*calls.columns, a.alias("price_in"), b.alias("price_out"), cost.alias("cost"))


def rollup(calls: DataFrame, *by: str) -> DataFrame:
    """Tokens, calls, cache hits and cost; a cached call is a hit and costs nothing."""
    paid = lambda c: F.coalesce(F.sum(F.when(~F.col("cached"), F.col(c))), F.lit(0))
    return calls.groupBy(*by).agg(
        paid("prompt_tokens").cast("long").alias("prompt_tokens"),
        paid("completion_tokens").cast("long").alias("completion_tokens"),
        F.count_if(~F.col("cached")).alias("llm_calls"),
        F.count_if(F.col("cached")).alias("cache_hits"),
        F.round(F.coalesce(F.sum(F.when(~F.col("cached"), F.col("cost"))), F.lit(0.0)), 6).alias("cost_usd"),
    )


def span_summary(spans: DataFrame, name: str = "event_type", ms: str = "value") -> DataFrame:
    """operation, n, total_ms, mean_ms by falling total."""
    rows = spans.groupBy(F.col(name).alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum(ms), 4).alias("total_ms"), F.round(F.avg(ms), 4).alias("mean_ms"))
    return rows.orderBy(F.desc("total_ms"), "operation")


def waterfall(spans: DataFrame) -> DataFrame:
    """Spans (trace, span_id, parent_id, start) in order of start with their depth.

    A span whose parent is unknown is a root. Each round doubles the distance that a span looks up, so there are as many rounds as the depth has
    bits, each written down before the next; spans that are their own ancestors have no depth.
    """
    ids = spans.select("trace", F.col("span_id").alias("parent_id")).withColumn("has", F.lit(True))
    rows = spans.join(ids, ["trace", "parent_id"], "left").withColumn("up", F.when(F.col("has"), F.col("parent_id"))).withColumn("far", F.when(F.col("has"), 1).otherwise(0)).drop("has")
    rows, left = materialise(rows), None
    while (n := rows.where("up IS NOT NULL").count()) and n != left:
        left = n
        above = rows.select("trace", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        rows = materialise(rows.join(above, ["trace", "up"], "left").withColumn("far", F.col("far") + F.coalesce("more", F.lit(0))).withColumn("up", F.col("next")).drop("next", "more"))
    rows = rows.withColumn("depth", F.when(F.col("up").isNull(), F.col("far"))).drop("up", "far")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("trace").orderBy("start", "span_id")))


def cache_lookups(lookups: DataFrame, ttl_seconds: int, key: str = "key", at: str = "ts") -> DataFrame:
    """lookups with hit: whether the key was looked up no more than ttl_seconds before; each lookup renews its entry."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    order = Window.partitionBy(key).orderBy(at, "event_id")
    last = F.lag(seconds).over(order)
    return lookups.withColumn("hit", F.coalesce(seconds - last <= ttl_seconds, F.lit(False)))


def hit_rate(lookups: DataFrame, *by: str) -> DataFrame:
    """lookups, hits, rate (0 without lookups)."""
    n = F.count("*")
    return lookups.groupBy(*by).agg(n.alias("lookups"), F.count_if("hit").alias("hits"), F.round(F.coalesce(F.count_if("hit") / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("rate"))


def misses(wanted: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int, key: str = "key") -> DataFrame:
    """The wanted keys that no entry of the cache (key, stored) younger than its time answers."""
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("stored") < ttl_seconds).select(key)
    return wanted.join(live, key, "left_anti")


def peak_concurrency(spans: DataFrame, by: str, start: str = "start", seconds: str = "seconds", bucket: int = 3600) -> DataFrame:
    """by, peak: how many spans were open at once at most; one that ends as another starts is over.

    Spans are cut at the bounds of buckets of time, so that each bucket is counted through alone and a group of any size is dealt out.
    """
    a = F.unix_micros(F.col(start).cast("timestamp"))
    b = a + F.round(F.col(seconds) * 1_000_000).cast("long")
    width = bucket * 1_000_000
    rows = spans.select(F.col(by).alias("by"), a.alias("a"), b.alias("b")).where("b > a")
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    lo, hi = F.greatest(F.col("a"), F.col("bucket") * width), F.least(F.col("b"), (F.col("bucket") + 1) * width)
    edges = rows.select("by", "bucket", F.explode(F.array(F.struct(lo.alias("t"), F.lit(1).alias("d")), F.struct(hi.alias("t"), F.lit(-1).alias("d")))).alias("e")).select("by", "bucket", "e.t", "e.d")
    steps = edges.groupBy("by", "bucket", "t").agg(F.sum("d").alias("d"))
    open_now = F.sum("d").over(Window.partitionBy("by", "bucket").orderBy("t"))
    return steps.withColumn("open", open_now).groupBy("by").agg(F.max("open").cast("long").alias("peak")).withColumnRenamed("by", by)


def retry_delay(attempt: Column, rate_limited: Column, retry_after: Column) -> Column:
    """Seconds before a further attempt, without the random share: told, or doubling from 4 up to 90 if limited, from 0.75 up to 20 if not."""
    return F.when(rate_limited, F.coalesce(retry_after, F.least(F.lit(90.0), 4.0 * F.pow(F.lit(2.0), attempt)))).otherwise(F.least(F.lit(20.0), 0.75 * F.pow(F.lit(2.0), attempt)))
