"""Calls of a model as frames: cache, rate, slots, retries with delays, replies of a schema with one repair."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergola.functions.text import json_value, stable_hash
from pergola.operators.usage import misses
from pergola.plans.provider import Provider
from pergola.session import materialise

ATTEMPTS = 6
EMBED_BATCH = 32
CACHE_SECONDS = 7 * 86_400
CACHE_ROWS = 4096


def failure(status: Column) -> Column:
    """What a response's status asks for: null for success; 'limited' and 'transient' are tried again, 'rejected' is not. No status at all is transient."""
    return F.when(status.between(200, 299), F.lit(None)).when(status == 429, "limited").when(status.isNull() | (status >= 500) | (status == 408), "transient").otherwise("rejected")


def delay(attempt: int, limited: bool, retry_after: float | None = None, chance: Callable[[], float] = random.random) -> float:
    """Seconds before a further attempt: told, or doubling up to a bound, of which a random share between a half and all is waited."""
    most = (retry_after if retry_after is not None else min(90.0, 4.0 * 2**attempt)) if limited else min(20.0, 0.75 * 2**attempt)
    return most * (0.5 + 0.5 * chance())


class Bucket:
    """Tokens that refill evenly, `per_minute` a minute up to a burst; without a rate none are needed."""

    def __init__(self, per_minute: int, burst: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.capacity = per_minute / 60.0, float(burst if burst is not None else max(1, per_minute // 5))
        self.tokens, self.clock, self.sleep, self.then = self.capacity, clock, sleep, clock()
        self.lock = threading.Lock()

    def take(self, amount: float = 1.0) -> float:
        """Waits until the amount, or the capacity if that is less, is there; the seconds waited."""
        if self.rate <= 0:
            return 0.0
        amount, waited = min(amount, self.capacity), 0.0
        with self.lock:
            while True:
                now = self.clock()
                self.tokens, self.then = min(self.capacity, self.tokens + (now - self.then) * self.rate), now
                if self.tokens >= amount - 1e-9:
                    self.tokens -= amount
                    return waited
                pause = (amount - self.tokens) / self.rate
                self.sleep(pause)
                waited += pause


class Slots:
    """No more than `most` calls at once; peak: the most there have been."""

    def __init__(self, most: int):
        self.free, self.lock, self.now, self.peak = threading.Semaphore(most), threading.Lock(), 0, 0

    def __enter__(self):
        self.free.acquire()
        with self.lock:
            self.now += 1
            self.peak = max(self.peak, self.now)
        return self

    def __exit__(self, *_):
        with self.lock:
            self.now -= 1
        self.free.release()


@dataclass
class Client:
    """A provider with what surrounds each call. Frames go to the provider whole, so its calls run where the rows are; a bucket token and a slot are
    taken for each frame sent. The cache is a table of key, reply, stored; entries older than `ttl` don't answer, and the latest `rows` stay."""

    provider: Provider
    attempts: int = ATTEMPTS
    bucket: Bucket = field(default_factory=lambda: Bucket(0))
    slots: Slots = field(default_factory=lambda: Slots(4))
    ttl: int = CACHE_SECONDS
    rows: int = CACHE_ROWS
    sleep: Callable[[float], None] = time.sleep
    cache: DataFrame | None = None

    def complete(self, prompts: DataFrame) -> DataFrame:
        """key, reply: from the cache by a hash of role and prompt, else from the provider, which is asked again for rows without a reply."""
        asked = materialise(prompts.withColumn("hash", stable_hash({"role": F.col("role"), "prompt": F.col("prompt")})))
        spark = prompts.sparkSession
        held = self.cache if self.cache is not None else spark.createDataFrame([], "hash string, reply string, stored timestamp")
        missing = misses(asked, held, F.current_timestamp(), self.ttl, "hash")
        left, fresh = materialise(missing.dropDuplicates(["hash"]).withColumn("key", F.col("hash"))), None
        for attempt in range(self.attempts):
            self.bucket.take()
            with self.slots:
                got = materialise(self.provider.complete(left.drop("hash")).where("reply IS NOT NULL").select(F.col("key").alias("hash"), "reply"))
            fresh = got if fresh is None else fresh.unionByName(got)
            left = materialise(left.join(got.select("hash"), "hash", "left_anti"))
            if left.isEmpty() or attempt + 1 == self.attempts:
                break
            self.sleep(delay(attempt, False))
        live = held.where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("stored") < self.ttl)
        both = live.unionByName(fresh.withColumn("stored", F.current_timestamp()))
        self.cache = materialise(both.groupBy("hash").agg(F.max_by("reply", "stored").alias("reply"), F.max("stored").alias("stored")).orderBy(F.desc("stored"), "hash").limit(self.rows))
        answers = live.select("hash", "reply").unionByName(fresh).dropDuplicates(["hash"])
        return asked.select("key", "hash").join(answers, "hash", "left").select("key", "reply")

    def structured(self, prompts: DataFrame, schema: str) -> DataFrame:
        """key, value: replies as values of a schema. A reply that can't be read is sent back once to be repaired; then its value is null."""
        ask = F.concat("prompt", F.lit(f"\n\nReply with one JSON object of this form and nothing else: {schema}"))
        asked = materialise(prompts.withColumn("prompt", ask))
        read = lambda c: F.from_json(json_value(c), schema, {"mode": "PERMISSIVE"})
        first = materialise(asked.join(self.complete(asked), "key", "left").withColumn("value", F.when(json_value(F.col("reply")).isNotNull(), read(F.col("reply")))))
        bad = first.where("value IS NULL AND reply IS NOT NULL")
        repair = bad.withColumn("prompt", F.concat("prompt", F.lit("\n\nThis reply could not be read:\n"), F.substring("reply", 1, 2000))).drop("reply", "value")
        again = self.complete(repair).select("key", F.when(json_value(F.col("reply")).isNotNull(), read(F.col("reply"))).alias("mended"))
        return first.join(again, "key", "left").select("key", F.coalesce("value", "mended").alias("value"))

    def stream(self, prompts: DataFrame):
        """Replies one after the other as (key, reply), as partitions end."""
        for row in self.complete(prompts).toLocalIterator():
            yield row.key, row.reply

    def embed(self, texts: DataFrame) -> DataFrame:
        """key, embedding for all texts; a text that can't be embedded has an empty one. A provider that gives more or fewer rows than it was asked for is an error."""
        self.bucket.take()
        with self.slots:
            got = materialise(self.provider.embed(texts))
        n, m = texts.count(), got.count()
        if n != m:
            raise ValueError(f"{n} texts were embedded into {m} rows")
        return got.select("key", F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"))
