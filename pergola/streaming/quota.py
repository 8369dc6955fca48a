"""Admission under quotas: in batch over sorted partitions, and as a stateful stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pergola.session import materialise

VISITOR_LIMIT = 5
WINDOW_SECONDS = 3600
DAILY_LIMIT = 200

DECISION = "event_id long, visitor long, second double, allowed boolean, remaining int, retry_after int"


def admit(history: deque[float], now: float, limit: int, window: int) -> tuple[bool, int, int]:
    """One request of a visitor at `now`: whether it is let in, how many more would be, and seconds to wait.

    Only admitted requests are in the history; one exactly a window old still counts.
    """
    while history and history[0] < now - window:
        history.popleft()
    if len(history) >= limit:
        return False, 0, max(1, int(window - (now - history[0])))
    history.append(now)
    return True, limit - len(history), 0


def requests(events: DataFrame, visitor: str = "user_id", at: str = "ts", key: str = "event_id") -> DataFrame:
    """event_id, visitor, second (since 1970); rows without a visitor or time ask for nothing."""
    return events.select(F.col(key).alias("event_id"), F.col(visitor).cast("long").alias("visitor"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("second")).where("visitor IS NOT NULL AND second IS NOT NULL")


def visitor_quota(asked: DataFrame, limit: int = VISITOR_LIMIT, window: int = WINDOW_SECONDS) -> DataFrame:
    """A decision for each request, visitor by visitor in order of time, then of event_id.

    The rule is sequential, as refusals don't count, so it can't be a window function. Each partition is sorted by visitor and time and read
    through once; what is held is one visitor's last `limit` admissions, however many requests a visitor has.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, history = None, deque()
        for batch in batches:
            out = []
            for v, now in zip(batch.column("visitor").to_pylist(), batch.column("second").to_pylist()):
                if v != visitor:
                    visitor, history = v, deque()
                out.append(admit(history, now, limit, window))
            columns = [batch.column("event_id"), batch.column("visitor"), batch.column("second"), pa.array([d[0] for d in out], pa.bool_()), pa.array([d[1] for d in out], pa.int32()), pa.array([d[2] for d in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["event_id", "visitor", "second", "allowed", "remaining", "retry_after"])

    return asked.repartition("visitor").sortWithinPartitions("visitor", "second", "event_id").mapInArrow(run, DECISION)


DAY = 86_400
BUDGET = "event_id long, visitor long, second double, day long, allowed boolean, scope string, remaining int, remaining_today int, retry_after int"


def seconds_left(second: Column) -> Column:
    """Seconds to the last one of a UTC day, 1 at least."""
    return F.greatest(F.lit(1), F.lit(DAY - 1) - F.floor(F.pmod(second, F.lit(float(DAY)))).cast("int"))


def _day_by_day(rows: DataFrame, limit: int, window: int, daily: int) -> DataFrame:
    """Decisions for event_id, visitor, second, day, carried rows: each day is sorted by time and read through once, in batches.

    Carried rows are admissions of earlier days; they fill their visitors' windows and are not decided again. What is held is the admissions
    that may still count: no more than a day's limit for each day that a window reaches over.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        today, served, used = None, {}, 0
        for batch in batches:
            out = []
            for e, v, now, day, carried in zip(*(batch.column(c).to_pylist() for c in ("event_id", "visitor", "second", "day", "carried"))):
                if day != today:
                    today, served, used = day, {}, 0
                history = served.setdefault(v, deque())
                if carried:
                    history.append(now)
                    continue
                while history and history[0] < now - window:
                    history.popleft()
                if len(history) >= limit:
                    out.append((e, v, now, day, False, "visitor", 0, max(0, daily - used), max(1, int(window - (now - history[0])))))
                elif used >= daily:
                    out.append((e, v, now, day, False, "global", limit - len(history), 0, max(1, DAY - 1 - int(now % DAY))))
                else:
                    history.append(now)
                    used += 1
                    out.append((e, v, now, day, True, "", limit - len(history), daily - used, 0))
                if not history:
                    del served[v]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["event_id", "visitor", "second", "day", "allowed", "scope", "remaining", "remaining_today", "retry_after"])

    return rows.repartition("day").sortWithinPartitions("day", "second", "event_id").mapInArrow(run, BUDGET)


def _carried(decided: DataFrame, window: int) -> DataFrame:
    """The admissions that still count at the start of a later day, once for each such day."""
    reach = -(-window // DAY)
    later = decided.where("allowed").select("visitor", "second", F.col("day").alias("of"), F.explode(F.sequence(F.col("day") + 1, F.col("day") + reach)).alias("day"))
    return later.where(F.col("second") >= F.col("day") * DAY - window).select(F.lit(None).cast("long").alias("event_id"), "visitor", "second", "day", F.lit(True).alias("carried"))


def budget(asked: DataFrame, limit: int = VISITOR_LIMIT, window: int = WINDOW_SECONDS, daily: int = DAILY_LIMIT) -> DataFrame:
    """A decision for each request, in order of time, then of event_id: a visitor's window first (scope 'visitor'), then the UTC day's limit for all ('global').

    Only requests that are served count, in the window and in the day. A day is decided from its own requests and from what earlier days
    admitted within a window of it, so all days are decided at once, and again those for which that has changed, until none has:
    the first day is right after the first round, each later one a round after those before it at the latest. retry_after: seconds until the
    oldest admission leaves the window, or until the day ends. The one sequence of a day is one task's by nature, whatever its visitors.
    """
    rows = asked.select("event_id", "visitor", "second", F.floor(F.col("second") / DAY).cast("long").alias("day"), F.lit(False).alias("carried"))
    rows = materialise(rows)
    decided, before = materialise(_day_by_day(rows, limit, window, daily)), None
    while True:
        carried = materialise(_carried(decided, window))
        marks = carried.groupBy("day").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("visitor", "second")).alias("x"))
        marks = {r.day: (r.n, r.x) for r in marks.collect()}
        known = before or {}
        changed = [d for d in {*marks, *known} if marks.get(d) != known.get(d)]
        if not changed:
            return decided
        before = marks
        days = asked.sparkSession.createDataFrame([(d,) for d in changed], "day long")
        again = _day_by_day(rows.join(F.broadcast(days), "day", "left_semi").unionByName(carried.join(F.broadcast(days), "day", "left_semi")), limit, window, daily)
        decided = materialise(decided.join(F.broadcast(days), "day", "left_anti").select(*again.columns).unionByName(again))


def token_bucket(calls: DataFrame, per_minute: int, burst: int | None = None) -> DataFrame:
    """calls (event_id, visitor, second, amount) with taken and left: a bucket for each visitor, full at first.

    Capacity is burst, or a fifth of the rate and 1 at least; it refills evenly; an amount over the capacity counts as the capacity; a call
    that finds too little is refused and takes nothing. A rate of 0 or less lets all in.
    """
    capacity = float(burst if burst is not None else max(1, per_minute // 5))
    rate = per_minute / 60.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, tokens, then = None, capacity, 0.0
        for batch in batches:
            taken, left = [], []
            for v, now, amount in zip(*(batch.column(c).to_pylist() for c in ("visitor", "second", "amount"))):
                if v != visitor:
                    visitor, tokens, then = v, capacity, now
                tokens, then = min(capacity, tokens + (now - then) * rate), now
                want = min(float(amount), capacity)
                ok = per_minute <= 0 or tokens >= want
                if ok and per_minute > 0:
                    tokens -= want
                taken.append(ok)
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("visitor"), pa.array(taken, pa.bool_()), pa.array(left, pa.float64())], names=["event_id", "visitor", "taken", "left"])

    return calls.repartition("visitor").sortWithinPartitions("visitor", "second", "event_id").mapInArrow(run, "event_id long, visitor long, taken boolean, left double")


def stream_quota(asked: DataFrame, limit: int = VISITOR_LIMIT, window: int = WINDOW_SECONDS) -> DataFrame:
    """The decisions of visitor_quota as a stream: a visitor's admissions are its state, dropped when it has been idle for a window.

    Requests that come in one micro-batch are decided in order of time; across micro-batches as they come.
    """
    import pandas as pd

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["second", "event_id"])
        out = [(e, key[0], s, *admit(history, s, limit, window)) for e, s in zip(rows.event_id, rows.second)]
        state.update((list(history),))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame(out, columns=["event_id", "visitor", "second", "allowed", "remaining", "retry_after"])

    return asked.groupBy("visitor").applyInPandasWithState(decide, DECISION, "admitted array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_spans(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", name: str = "event_type", at: str = "ts", ms: str = "value") -> DataFrame:
    """Span sums by operation and window of event time; what comes later than the watermark is left out. The watermark is an addition of ours."""
    stamped = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", window).alias("w"), F.col(name).alias("operation")).agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms")).select(F.col("w.start").alias("start"), "operation", "n", "total_ms")
