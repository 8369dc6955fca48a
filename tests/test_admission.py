"""Stateful streams against the batch operators, for requests in order of time over several micro-batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pergola.streaming import admission, quota

SHAPE = "event_id long, visitor long, second double, amount double"


@pytest.fixture(scope="module")
def asked(spark, smallest):
    before = {k: spark.conf.get(k, None) for k in admission.STORE}
    for k, v in admission.STORE.items():
        spark.conf.set(k, v)
    rows = quota.requests(spark.read.parquet(f"{smallest}/events.parquet")).withColumn("visitor", F.col("visitor") % 12).withColumn("amount", (F.col("event_id") % 3 + 1).cast("double"))
    yield spark.createDataFrame(rows.orderBy("second", "event_id").limit(400).toPandas(), SHAPE)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, asked, build, where, last=None):
    """The rows of a stream over four files in order of time, and one more if given."""
    frame = asked.toPandas().sort_values(["second", "event_id"])
    parts = [frame.iloc[len(frame) * k // 4 : len(frame) * (k + 1) // 4] for k in range(4)]
    os.makedirs(where / "in")
    for k, part in enumerate([*parts, *([last.toPandas()] if last is not None else [])]):
        part.to_parquet(where / "in" / f"{k}.parquet")
        os.utime(where / "in" / f"{k}.parquet", (time.time() - 1000 + 10 * k,) * 2)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(where / "in"))
    name = f"t{abs(hash(str(where)))}"
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{where}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.table(name)


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_visitors_and_their_state(spark, asked, tmp_path):
    last = spark.createDataFrame([(10_000, 99, 4e9, 1.0), (10_001, 99, 4e9 + 100_000, 1.0)], SHAPE)
    found = streamed(spark, asked, lambda s: admission.visitor_quota(s, 3, 86_400), tmp_path, last)
    columns = ("event_id", "visitor", "allowed", "remaining", "retry_after")
    assert rows(found, *columns) == rows(quota.visitor_quota(asked.unionByName(last), 3, 86_400), *columns)
    assert found.where("NOT allowed").count() > 10
    held = spark.read.format("statestore").option("stateVarName", "admitted").load(f"{tmp_path}/c")
    assert {r.key.visitor for r in held.select("key").collect()} <= {99}


def test_days(spark, asked, tmp_path):
    found = streamed(spark, asked, lambda s: admission.budget(s, None, 4, 7200, 9), tmp_path)
    columns = ("event_id", "visitor", "day", "allowed", "scope", "remaining", "remaining_today", "retry_after")
    want = quota.budget(asked, 4, 7200, 9)
    assert rows(found, *columns) == rows(want, *columns)
    assert {r.scope for r in want.select("scope").distinct().collect()} >= {"", "global"}


def test_buckets(spark, asked, tmp_path):
    found = streamed(spark, asked, lambda s: admission.token_bucket(s, 0.0005, 4), tmp_path)
    columns = ("event_id", "visitor", "taken", "left")
    assert rows(found, *columns) == rows(quota.token_bucket(asked, 0.0005, 4), *columns)
    assert found.where("NOT taken").count() > 5
