"""Arrow batches of documents: bounded slices, words as 64-bit values, shared folders, fixed-size filters."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.session import CLEANUP

#: Bytes of text that one step works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 3 << 19
#: Words a task remembers the hash of before it starts anew.
MEMO_WORDS = 150_000


def documents(df: DataFrame, *more: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the columns an operator reads; other columns, whatever their names, stay out of its way."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *(m for m in more if m not in ("doc_id", "text")))


#: Plan nodes below which the number of partitions isn't known without running something.
SHUFFLING = ("Join", "Aggregate", "Distinct", "Window", "Sort", "Repartition", "RepartitionByExpression", "GlobalLimit", "Deduplicate", "Intersect", "Except", "FlatMapGroups")


def _nodes(plan) -> Iterator[str]:
    yield plan.getClass().getSimpleName()
    below = plan.children()
    for k in range(below.size()):
        yield from _nodes(below.apply(k))


def spread(df: DataFrame) -> DataFrame:
    """The same rows on every core where a small table comes in fewer partitions than there are cores.

    Only plans without a shuffle are asked for their partitions; asking others would run them.
    """
    if any(name.startswith(SHUFFLING) for name in _nodes(df._jdf.queryExecution().optimizedPlan())):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


#: Steps of an octave in which a sample's threshold is found: samples are at most a hundredth short of what is asked for.
STEPS = 64


def sampled(df: DataFrame, group: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of each group: those whose hash of the key is below the group's threshold, nearly as many as allowed.

    The threshold comes from a histogram of the hash in steps that get finer towards 0, so nothing is ranked, no task sees more of a group
    than the histogram's few thousand counts, and a large group is joined by group and step. Rows of one key stay or go together.
    """
    share = (F.xxhash64(key).bitwiseAND((1 << 63) - 1).cast("double") + 1) / float(1 << 63)
    rows = df.withColumn("step", F.floor(F.log2(share) * -STEPS).cast("int"))
    counts = rows.groupBy(group, "step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(F.desc("step")))
    allowed = counts.withColumn("upto", upto).where(F.col("upto") <= most).select(group, "step")
    return rows.join(allowed, [group, "step"]).drop("step")


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows whose count is so large that at most `most` rows have it or more: a threshold from a histogram, so that nothing is sorted."""
    bucket = F.when(F.col(n) < 4096, F.col(n)).otherwise(4096 + F.floor(F.log2(F.col(n)) * 64)).cast("long")
    held, least = 0, None
    for row in sorted(counts.groupBy(bucket.alias("bucket")).count().collect(), key=lambda r: -r.bucket):
        held += row["count"]
        if held > most:
            break
        least = row.bucket
    return counts.where(bucket >= least) if least is not None else counts.where(F.lit(False))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about SLICE_BYTES of text each."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        yield batch.slice(start, stop - start)


def release() -> None:
    """Gives memory that a finished task no longer needs back to the machine; workers outlive tasks, and share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: T.StructType, column: str = "text") -> DataFrame:
    """make() runs once in each task; its result turns a slice into the output's columns, in the schema's order."""
    plain = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        step = make()
        for batch in batches:
            for part in slices(batch, column):
                columns = step(part)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, plain)], schema=plain)
        del step
        release()

    return df.mapInArrow(run, schema)


def struct(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """doc_id as the input has it, then the given fields."""
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType, True), *(T.StructField(n, t, True) for n, t in fields)])


def raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets all when it has grown past MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs_of(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive values; shorter inputs have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x243F6A8885A308D3 + seed, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
        if i % 4 == 3:
            out = mix(out)
    return mix(out)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a local session takes the machine's own temporary folder; any other is refused, as its executors would not see one another's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        if base.isDefined():
            base = base.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = f"file://{tempfile.gettempdir()}/pergola-shared"
        else:
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def dropped(spark: SparkSession, where: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    files, path = _file_system(spark, where)
    files.delete(path, True)


def saved(df: DataFrame, *parts: str) -> str:
    """The folder of a new table of the rows in the shared folder, cut by the columns in parts; it goes when the session's JVM ends.

    The shuffle files of the job that wrote it are deleted at once: the table takes their place, and nothing recomputes from them.
    """
    spark = df.sparkSession
    where = shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(where)
    finally:
        spark.conf.set(CLEANUP, before)
    files, path = _file_system(spark, where)
    files.deleteOnExit(path)
    return where


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df))


#: Bits of the smallest and the largest filter, and bits for each key in between.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 20, 29, 64
#: Bits of a part of a filter, which one task makes.
PART_BITS = 20


def key_filter(keys: DataFrame, column: str) -> bytes:
    """A one-hash Bloom filter of a column of 64-bit keys of a written table: BITS_A_KEY bits a key, up to 2**MOST_BITS in all (64 MB).

    It only ever passes too much, so what it passes is joined exactly afterwards. Keys travel as distinct bits to the part that holds them, so a
    task holds one part, whatever the number of tasks and keys.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (keys.count() * BITS_A_KEY).bit_length()))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> PART_BITS, pa.int32()), pa.array(slots & ((1 << PART_BITS) - 1), pa.int32())], names=["part", "slot"])

    def fold(rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << PART_BITS, np.uint8)
        own[rows.column("slot").to_numpy()] = 1
        return pa.table({"part": rows.column("part")[:1].cast(pa.int32()), "cut": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    slots = keys.select(column).mapInArrow(place, "part int, slot int").distinct()
    whole, size = bytearray(1 << (bits - 3)), 1 << (PART_BITS - 3)
    for row in slots.groupBy("part").applyInArrow(fold, "part int, cut binary").collect():
        whole[row.part * size : (row.part + 1) * size] = row.cut
    return bytes(whole)


def passes(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = (len(filter_bytes) * 8).bit_length() - 1
    slot = mix(keys) >> np.uint64(64 - bits)
    return (filter_bytes[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


#: Values in a row of a vector that groups of rows give; parts that are added up first.
CHUNK = 16_384
SALTS = 16


def vector_sum(df: DataFrame, group: str, learn: Callable[[int, pa.Table], np.ndarray]) -> np.ndarray | None:
    """The sum of learn(number, rows), vectors of one bounded length, over the groups of a column of numbers; None without rows.

    The vectors travel in chunks and are added up in two steps, first within salted parts, so no task holds a chunk from every other.
    Each step adds in the order of the groups, so that the sum doesn't depend on how rows were dealt.
    """

    def run(rows: pa.Table) -> pa.Table:
        number = rows.column(group)[0].as_py()
        values = np.ascontiguousarray(learn(number, rows), np.float64)
        cuts = [values[k : k + CHUNK].tobytes() for k in range(0, len(values), CHUNK)]
        return pa.table({"chunk": pa.array(range(len(cuts)), pa.int32()), "salt": pa.array([number % SALTS] * len(cuts), pa.int64()), "number": pa.array([number] * len(cuts), pa.int64()), "sums": pa.array(cuts, pa.binary())})

    def add(by: str) -> Callable[[pa.Table], pa.Table]:
        def step(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(by)
            total = np.zeros(len(rows.column("sums")[0].as_py()) // 8)
            for k in range(rows.num_rows):
                total += np.frombuffer(rows.column("sums")[k].as_py(), np.float64)
            return pa.table({"chunk": rows.column("chunk")[:1].cast(pa.int32()), "salt": rows.column("salt")[:1].cast(pa.int64()), "number": rows.column("number")[:1].cast(pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        return step

    shape = "chunk int, salt long, number long, sums binary"
    summed = df.groupBy(group).applyInArrow(run, shape).groupBy("chunk", "salt").applyInArrow(add("number"), shape).groupBy("chunk").applyInArrow(add("salt"), shape)
    rows = sorted(summed.collect(), key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(r.sums, np.float64) for r in rows]) if rows else None
