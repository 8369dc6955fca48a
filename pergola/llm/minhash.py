"""Near duplicates by banded min-hash signatures: sequential Bayesian comparison of candidates, exact confirmation of what survives it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import WordHashes, documents, dropped, key_filter, map_slices, mix, passes, raw, release, saved, signed, spread, struct, written
from pergola.llm.components import components
from pergola.llm.jaccard_join import shingles, words_of

#: Words of a shingle; a link needs LEAST / 100 of the union shared.
WIDTH = 4
LEAST = 80
#: A signature has BANDS * ROWS values. Two sets that share 0.8 of their union agree in no band with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Values compared before a pair is judged again.
BATCH = 16
#: A pair is dropped once the probability that it is a link, given the values that agree so far, is less.
MISS = 1e-6
#: Shingles of a chunk of a bucket's side; two chunks meet in one task. What a set weighs besides its shingles.
CHUNK = 400_000
SET_WEIGHT = 64

_FACTORS = (np.random.default_rng(11).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def signatures(shingle_hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hashes over each set; sets lie one after the other and none is empty."""
    out = np.empty((len(starts), len(_FACTORS)), np.uint32)
    held = np.empty_like(shingle_hashes)
    for k, factor in enumerate(_FACTORS):
        np.multiply(shingle_hashes, factor, out=held)
        out[:, k] = np.minimum.reduceat(held.view("<u4")[1::2], starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band's number and values."""
    pairs = np.ascontiguousarray(signature).view("<u8").reshape(len(signature), BANDS, ROWS // 2)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signature), BANDS))
    for k in range(ROWS // 2):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + pairs[:, :, k])
    return out


def least_matches(least: int = LEAST, miss: float = MISS) -> list[int]:
    """For each number of values compared the matches below which a pair is dropped.

    With every similarity as likely beforehand, the similarity's distribution after m of n matches is a beta distribution; that it is t or more then
    has the probability that n + 1 draws with a chance of t succeed m times at most.
    """
    t = least / 100
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two arrays of signatures may still be links after all batches, and how many values agree in them."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive, matches[alive]


def _key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k (16 bytes that stand for the set), sig."""

    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> list:
            sets = [shingles(words_of(t), hashes, width) for t in raw(part.column("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            found: list[bytes | None] = [None] * len(sets)
            if len(full):
                starts = np.cumsum(sizes[full]) - sizes[full]
                for k, row in zip(full.tolist(), signatures(np.concatenate([sets[k] for k in full]), starts)):
                    found[k] = row.tobytes()
            return [part.column("doc_id"), sizes, [_key(s) for s in sets], found]

        return step

    return map_slices(docs, make, struct(docs, ("n_shingles", T.LongType()), ("k", T.BinaryType()), ("sig", T.BinaryType())))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BANDS * ROWS)


def _postings(sets: DataFrame) -> DataFrame:
    """band, node: a row for each band of each set."""

    def run(batches):
        for batch in batches:
            names = bands(_matrix(batch.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(signed(names.ravel())), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["band", "node"])

    return sets.select("node", "sig").mapInArrow(run, "band long, node long")


def _compared(pairs: DataFrame, sets: DataFrame, needed: list[int], least: int) -> DataFrame:
    """The pairs a, b whose signatures may still be those of a link after all batches, and whose sizes allow one."""
    side = sets.select("node", "n_shingles", "sig")
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
    both = both.join(side.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            alive, _ = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), needed)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * least).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _open(members: DataFrame, sets: DataFrame) -> DataFrame:
    """band, i, j, place, node, class, n_shingles, sig: the sets of buckets that hold several classes, but for their pivots, in groups to be compared.

    members: band, pivot, node, class, home (the class of the pivot). One side of a bucket has the sets of its pivot's class, which need no
    comparison among themselves, the other side all others. Each side is dealt into chunks by node, and each two chunks that have pairs meet in
    a group of their own, so a task holds two chunks, however large the bucket is.
    """
    away = F.col("class") != F.col("home")
    weight = F.col("n_shingles") + SET_WEIGHT
    rows = members.where("node <> pivot").join(sets.select("node", "n_shingles"), "node").withColumn("away", away)
    sized = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.when(F.col("away"), weight).otherwise(0)).alias("far"), F.sum(F.when(F.col("away"), 0).otherwise(weight)).alias("near"))
    sized = sized.where("far > 0 AND n > 1").select("band", *(F.ceil(F.col(c) / CHUNK).cast("int").alias(c) for c in ("far", "near")))
    rows = rows.join(sized, "band")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("away"), F.col("far")).otherwise(F.greatest("near", F.lit(1))).cast("long")).cast("int"))
    # chunks of the pivot's class are numbered -1, -2, ...; a chunk of the others meets them and all chunks of the others
    rows = rows.withColumn("place", F.when(F.col("away"), F.col("chunk")).otherwise(-1 - F.col("chunk")))
    others = F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda c: F.struct(F.least(c, F.col("place")).alias("i"), F.greatest(c, F.col("place")).alias("j")))
    homes = F.transform(F.sequence(-F.col("near"), F.lit(-1)), lambda c: F.struct(c.alias("i"), F.col("place").alias("j")))
    dealt = rows.withColumn("group", F.explode(F.when(F.col("away") & (F.col("near") > 0), F.concat(others, homes)).otherwise(others)))
    return dealt.select("band", "group.i", "group.j", "place", "node", "class", "n_shingles")


def _compared_in_groups(groups: DataFrame, needed: list[int], least: int) -> DataFrame:
    """a, b: links between sets of different classes of a group, as many as make one class of what is linked.

    groups: _open() with sig and own (the whole set). A pair that agrees in several bands is compared in the first of them alone. Of a set's survivors
    those most alike come first; what a link has made one class by then isn't compared.
    """

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sig, own = _matrix(rows.column("sig").chunk(0)), [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("own").chunk(0)]
        node, label, size, place = (rows.column(c).to_numpy().copy() for c in ("node", "class", "n_shingles", "place"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        names = bands(sig)
        band = int(np.flatnonzero(signed(names[0]) == rows.column("band")[0].as_py())[0])
        left, right = np.flatnonzero(place == i), np.flatnonzero(place == j)
        links = []
        for q in left.tolist():
            ok = right[(label[right] != label[q]) & (100 * np.minimum(size[right], size[q]) >= least * np.maximum(size[right], size[q]))]
            if i == j:
                ok = ok[node[ok] > node[q]]
            ok = ok[~(names[ok, :band] == names[q, :band]).any(axis=1)]
            alive, matches = survivors(np.broadcast_to(sig[q], (len(ok), BANDS * ROWS)), sig[ok], needed)
            for r in ok[alive[np.argsort(-matches, kind="stable")]].tolist():
                if label[r] != label[q] and _linked(own[q], own[r], least):
                    links.append((node[q], node[r]))
                    label[label == label[r]] = label[q]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return groups.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether two sets, both sorted, share least / 100 of their union."""
    if 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    shared = int((x[at] == y).sum())
    return 100 * shared >= least * (len(x) + len(y) - shared)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, own: the whole sorted sets of the nodes in wanted (node, k, doc_id), read anew from the documents that a filter of their ids lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h")), "h"))

    def make():
        held, hashes = np.frombuffer(sent.value, np.uint8), WordHashes()

        def step(part: pa.RecordBatch) -> list:
            names = [b"" if i is None else str(i).encode() for i in part.column("doc_id").to_pylist()]
            kept = part.filter(pa.array(passes(held, np.array([xxhash.xxh64_intdigest(n, 42) for n in names], np.uint64))))
            sets = [shingles(words_of(t), hashes, width) for t in raw(kept.column("text"))]
            return [kept.column("doc_id"), [_key(s) for s in sets], [s.tobytes() for s in sets]]

        return step

    found = map_slices(docs, make, struct(docs, ("k", T.BinaryType()), ("own", T.BinaryType())))
    return written(found.join(wanted, ["doc_id", "k"]).dropDuplicates(["node"]).select("node", "own"))


def _confirmed(pairs: DataFrame, full: DataFrame, least: int) -> DataFrame:
    """The pairs a, b whose whole sets share least / 100 of their union."""
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("own").alias("wa")), "a").join(full.select(F.col("node").alias("b"), F.col("own").alias("wb")), "b")

    def run(batches):
        release()
        for batch in batches:
            pairs = zip(batch.column("wa"), batch.column("wb"))
            linked = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
        release()

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def deduplicate(df: DataFrame, width: int = WIDTH, least: int = LEAST, miss: float = MISS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (doc_id is its component's).

    Two sets are candidates if their signatures agree in a band, and a link if they share least / 100 of their union. Equal sets are one from the start.
    First each set of a bucket is compared with the bucket's pivot, its least set. Then, in buckets that hold several classes by then, sets of
    different classes are compared in tasks that hold their signatures and whole sets, and only links that make one class of two leave them. A
    comparison goes through the signatures batch by batch and ends once a link has become less probable than `miss`; what survives is
    confirmed on the whole sets. So a link is lost only if it agrees in no band or falls under `miss`; none is made up. Nothing is capped.

    Null texts and texts without words have an empty set, link with nothing and are kept. Rows that share a doc_id have each its own set;
    rows with a null id link with nothing, have a null component and are kept; an empty table gives no rows; other columns are not read.
    """
    needed = least_matches(least, miss)
    docs = spread(documents(df, text=text, key=key))
    spark, profiled = df.sparkSession, _profiles(docs, width)
    first_table = saved(profiled)
    profiles = spark.read.schema(profiled.schema).parquet(first_table)
    grouped = profiles.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sets = written(grouped.withColumn("node", F.monotonically_increasing_id()))
    # signatures are in sets now, and bands are no longer needed once those that sets share are written: neither is kept twice
    rows = written(profiles.select("doc_id", "n_shingles", "k"))
    dropped(spark, first_table)
    all_bands = saved(_postings(sets))
    postings = spark.read.schema("band long, node long").parquet(all_bands)
    shared = postings.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("band", "pivot")
    members = written(postings.join(shared, "band"))
    dropped(spark, all_bands)
    stars = written(_compared(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets, needed, least))
    nodes = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    full = _sets(docs, written(sets.join(nodes, "node").select("node", "k", "doc_id")), width)
    links = written(_confirmed(stars, full, least))
    tied = components(_across(docs, sets, members, links, full, needed, width, least))
    named = sets.select("node", "k", F.col("doc_id").alias("first")).join(tied, "node")
    together = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("k", "component_id")
    firsts = sets.select("k", F.col("doc_id").alias("first")).join(together, "k", "left").select("k", F.coalesce("component_id", "first").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "k").join(firsts, "k", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(docs: DataFrame, sets: DataFrame, members: DataFrame, links: DataFrame, full: DataFrame, needed: list[int], width: int, least: int) -> DataFrame:
    """links, and those between sets of one bucket that the links with pivots leave in different classes."""
    tied = written(components(links))
    at = members.join(tied, "node", "left").select("band", "pivot", "node", F.coalesce("root", "node").alias("class"))
    at = at.join(tied.select(F.col("node").alias("pivot"), F.col("root").alias("home")), "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))
    groups = written(_open(written(at), sets))
    fresh = groups.select("node").distinct().join(full.select("node"), "node", "left_anti")
    full = full.unionByName(_sets(docs, written(sets.join(fresh, "node").select("node", "k", "doc_id")), width))
    return written(links.unionByName(_compared_in_groups(groups.join(sets.select("node", "sig"), "node").join(full, "node"), needed, least)))
