"""Documents whose sets of word shingles overlap: T-occurrence search with DivideSkip inside neighbourhoods of rare shingles."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import WordHashes, documents, key_filter, map_slices, mix, passes, raw, runs_of, signed, spread, struct, written
from pergola.llm.components import components

#: Words of a shingle; a link needs LEAST / 100 of the union shared.
WIDTH = 4
LEAST = 85
#: Shingles whose hash is less are those whose frequency is counted: three eighths, over twice what a prefix needs, so that one mostly finds rare ones.
COUNTED = np.uint64(3 << 61)
#: Frequency levels: the number of rows from which a shared shingle is in the level. Each has a filter as large as its number of shingles asks for.
LEVELS = (2, 4, 8, 16, 64)
#: Shingles of one block of a neighbourhood; a larger neighbourhood is searched by pairs of blocks.
BLOCK_SHINGLES = 600_000
#: What a set weighs besides its shingles.
DOC_WEIGHT = 200
#: Sets of a range that lists are merged over at once.
MERGED = 256
#: The weight of list length in DivideSkip's choice of the number of long lists.
MU = 0.0085


def shingles(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The set as sorted 64-bit hashes; fewer words than `width` are one shingle, none have none."""
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.array(words)
    if len(words) < width:
        return runs_of(values, len(words), len(words))
    return np.unique(runs_of(values, width, width))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def needed(size: int, least: int) -> int:
    """Shared shingles that any link of a set of this size needs: least / 100 of it."""
    return -(-least * size // 100)


def _profiles(docs: DataFrame, width: int, least: int) -> DataFrame:
    """doc_id, n_shingles, k (16 bytes that stand for the set), low: the set's least hashes, all below COUNTED and a prefix's number at least."""

    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> list:
            sizes, keys, lows = [], [], []
            for t in raw(part.column("text")):
                own = shingles(words_of(t), hashes, width)
                sizes.append(len(own))
                keys.append(_key(own))
                lows.append(signed(own[: max(int(np.searchsorted(own, COUNTED)), prefix_size(len(own), least))]))
            return [part.column("doc_id"), sizes, keys, lows]

        return step

    return map_slices(docs, make, struct(docs, ("n_shingles", T.LongType()), ("k", T.BinaryType()), ("low", T.ArrayType(T.LongType()))))


def _key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def prefix_size(size: int, least: int) -> int:
    return size - needed(size, least) + 1 if size else 0


def _k1() -> Column:
    return F.xxhash64("k")


def _filters(rows: DataFrame) -> list[bytes]:
    """A filter for each level of the shingles below COUNTED that different sets share, over all rows."""
    low = F.filter("low", lambda h: (h >= 0) & (h < int(COUNTED)))
    postings = rows.select(_k1().alias("node"), F.explode(low).alias("shingle"))
    counted = postings.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    shared = written(counted.where("a <> b").select("shingle", "n"))
    return [key_filter(shared.where(F.col("n") >= least), "shingle") for least in LEVELS]


def _neighbourhoods(rows: DataFrame, least: int) -> DataFrame:
    """node (hash of a set), root: sets joined by chains of shared prefix shingles; linked sets are always in one of them.

    The order of shingles: counted ones by frequency level and hash, then the others by hash. It is the same for all documents, so linked
    sets share a shingle of their prefixes whatever the filters let through. A counted shingle that no other set has is not sent at all.
    Each shingle ties its sets to the least of them: n - 1 rows and not all pairs.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_filters(rows))

    def make():
        held = [np.frombuffer(f, np.uint8) for f in sent.value]

        def step(part: pa.RecordBatch) -> list:
            lists = part.column("low")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if not lengths.sum():
                return [[], []]
            low = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            level = np.sum([passes(f, low) for f in held], axis=0)
            level[low >= COUNTED] = len(LEVELS) + 1
            owner = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((low, level, owner))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            sizes = part.column("n_shingles").to_numpy(zero_copy_only=False)
            first = np.array([prefix_size(int(n), least) for n in sizes])
            chosen = order[np.arange(len(low)) - starts[owner] < first[owner]]
            chosen = chosen[level[chosen] > 0]
            return [part.column("node").to_numpy(zero_copy_only=False)[owner[chosen]], signed(low[chosen])]

        return step

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingle", T.LongType())])
    postings = written(map_slices(rows.select(_k1().alias("node"), "n_shingles", "low", "k"), make, schema, column="k"))
    shared = postings.groupBy("shingle").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("shingle", "pivot")
    edges = postings.join(shared, "shingle").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    return written(components(edges))


def size_class(low: int, least: int) -> tuple[int, int, int, int]:
    """Of the links whose smaller set has `low` shingles or up to a 100 / least-th of it: that many, the larger set's most, parts, spare parts.

    Two such sets differ in at most k shingles, so of k + 1 + 2 * spare parts at least 1 + 2 * spare are the same in both, and one still is when
    each set leaves out any `spare` of its own.
    """
    high = max(low, (100 * low - 1) // least)
    most = 100 * high // least
    k = (high + most) * (100 - least) // (100 + least)
    spare = (k + 2) // 4
    return high, most, k + 1 + 2 * spare, spare


def classes(size: int, least: int) -> list[tuple[int, int, int]]:
    """low, parts, spare of the classes that a set of this size is in, as the smaller or the larger set of a link."""
    out, low = [], 1
    while low <= size:
        high, most, parts, spare = size_class(low, least)
        if size <= most:
            out.append((low, parts, spare))
        low = high + 1
    return out


def part_keys(own: np.ndarray, low: int, parts: int) -> np.ndarray:
    """A 64-bit name of what a set holds of each part of all shingles; a part is told by a shingle's hash."""
    at = ((mix(own) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    upper = np.bincount(at, weights=own >> np.uint64(32), minlength=parts).astype(np.uint64)
    lower = np.bincount(at, weights=own & np.uint64(0xFFFFFFFF), minlength=parts).astype(np.uint64)
    return mix(mix((upper << np.uint64(32)) + lower) + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(low))


def _narrowed(large: DataFrame, width: int, least: int) -> DataFrame:
    """node, root: the sets of large neighbourhoods (node, k, text, root) in smaller ones, which linked sets still are in together. A set that links with none drops out.

    Shared passages chain a neighbourhood. Here shingles are dealt into so many parts that linked sets hold the same of some; of the parts that a set has the
    same as others it leaves out as many as a link can spare, those that most sets have: what a common passage alone fills is mostly among them.
    """

    def make():
        hashes, known = WordHashes(), {}

        def step(part: pa.RecordBatch) -> list:
            nodes, lows, spares, names = [], [], [], []
            for node, key, root, t in zip(part.column("node").to_pylist(), part.column("k").to_pylist(), part.column("root").to_pylist(), raw(part.column("text"))):
                own = shingles(words_of(t), hashes, width)
                if _key(own) != key:
                    continue
                if len(own) not in known:
                    known[len(own)] = classes(len(own), least)
                for low, parts, spare in known[len(own)]:
                    nodes.append(np.full(parts, node))
                    lows.append(np.full(parts, low))
                    spares.append(np.full(parts, spare))
                    names.append(signed(mix(part_keys(own, low, parts) + np.uint64(root & (1 << 64) - 1))))
            return [np.concatenate(c) if c else [] for c in (nodes, lows, spares, names)]

        return step

    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "low", "spare", "part")])
    parts = written(map_slices(large, make, shape))
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
    commonest = Window.partitionBy("node", "low").orderBy(F.desc("n"), "part")
    held = written(parts.join(counts, "part").withColumn("place", F.row_number().over(commonest)).where("place > spare").select("node", "part"))
    pivots = held.groupBy("part").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("part", "pivot")
    edges = held.join(pivots, "part").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    return components(edges)


class Index:
    """Inverted lists of a block of sets: sorted places of sets by shingle, as one sorted array of list * n + set.

    skipped, again: how often a search moved a list on without counting what it passed, and put one back after a range.
    """

    def __init__(self, sets: list[np.ndarray], least: int):
        self.sets, self.least, self.n = sets, least, len(sets)
        self.skipped = self.again = 0
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.names, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        self.postings = np.sort(ranks * self.n + np.repeat(np.arange(self.n), self.sizes))
        self.starts = np.searchsorted(self.postings, np.arange(len(self.names) + 1) * self.n)
        self.ranks = np.split(ranks, np.cumsum(self.sizes)[:-1])

    def members(self, rank: int) -> np.ndarray:
        return self.postings[self.starts[rank] : self.starts[rank + 1]] - rank * self.n

    def search(self, q: int, unwanted: np.ndarray) -> np.ndarray:
        """Places of the sets, but for the unwanted ones, that share enough with set q.

        The L longest lists of q are put aside. The others are merged from a heap; sets found in T - L of them at least are candidates, and
        each is looked up in the long lists by binary search.
        """
        return self._found(self.ranks[q], int(self.sizes[q]), unwanted)

    def search_for(self, other: np.ndarray, unwanted: np.ndarray) -> np.ndarray:
        """The same for a set that need not be one of these."""
        at = np.minimum(np.searchsorted(self.names, other), len(self.names) - 1)
        return self._found(at[self.names[at] == other], len(other), unwanted)

    def _found(self, own: np.ndarray, size: int, unwanted: np.ndarray) -> np.ndarray:
        t = needed(size, self.least)
        if len(own) < t:
            return np.empty(0, np.int64)
        lengths = self.starts[own + 1] - self.starts[own]
        order = np.argsort(lengths, kind="stable")
        longest = int(lengths[order[-1]])
        aside = min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))
        short, long = own[order[: len(own) - aside]], own[order[len(own) - aside :]]
        sets, counts = self._merged(short, t - aside)
        ok = (counts >= t - aside) & ~unwanted[sets] & (100 * self.sizes[sets] >= self.least * size) & (100 * size >= self.least * self.sizes[sets])
        sets, counts = sets[ok], counts[ok]
        if len(sets) and len(long):
            for k in range(0, len(sets), 2048):
                keys = (long * self.n)[:, None] + sets[None, k : k + 2048]
                at = np.minimum(np.searchsorted(self.postings, keys), len(self.postings) - 1)
                counts[k : k + 2048] += (self.postings[at] == keys).sum(axis=0)
        return sets[100 * counts >= self.least * (size + self.sizes[sets] - counts)]

    def _merged(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that are in `least` of some lists, and maybe others, and how many of the lists each is in.

        The lists' heads wait in a heap. A set before the head that is `least`-th in order is in too few lists, so the lists before that one are moved
        on to it by binary search and put back. The least head then opens a range of MERGED sets; every list whose head is in it gives all that it has
        there and goes back with its next set, and the range is counted at once. Once fewer than `least` lists are left nothing more is found.
        """
        parts = [self.members(int(r)) for r in lists]
        heads = [(int(p[0]), k, 0) for k, p in enumerate(parts)]
        heapq.heapify(heads)
        sets, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(heads) >= least:
            behind = [heapq.heappop(heads) for _ in range(least - 1)]
            low = heads[0][0]
            for head, k, at in behind:
                if head < low:
                    self.skipped += 1
                    at = int(np.searchsorted(parts[k], low))
                if at < len(parts[k]):
                    heapq.heappush(heads, (int(parts[k][at]), k, at))
            if len(heads) < least:
                break
            high, taken = low + MERGED, []
            while heads and heads[0][0] < high:
                _, k, at = heads[0]
                own = parts[k]
                stop = len(own) if own[-1] < high else int(np.searchsorted(own, high))
                taken.append(own[at:stop])
                if stop < len(own):
                    self.again += 1
                    heapq.heapreplace(heads, (int(own[stop]), k, stop))
                else:
                    heapq.heappop(heads)
            found = np.bincount(np.concatenate(taken) - low)
            some = np.flatnonzero(found)
            sets.append(some + low)
            counts.append(found[some])
        return np.concatenate(sets), np.concatenate(counts)


def linked(sets: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """For each set the least place of those it is linked with by a chain of overlaps.

    A set is searched for unless it is in the largest component by then; any overlap across components has an end outside the largest,
    so no component is missed. Empty sets stay alone.
    """
    parent = np.arange(len(sets))
    full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if len(full) < 2:
        return parent
    index = Index([sets[k] for k in full], least)
    label = np.arange(len(full))
    count = np.ones(len(full), np.int64)
    waiting = list(range(len(full)))
    while waiting:
        later = []
        for q in waiting:
            own = label[q]
            if count[own] > 1 and own == count.argmax():
                later.append(q)
                continue
            found = np.unique(label[index.search(q, label == own)])
            if len(found):
                both = np.append(found, own)
                total, least_label = count[both].sum(), both.min()
                label[np.isin(label, both)] = least_label
                count[both] = 0
                count[least_label] = total
        waiting = [q for q in later if label[q] != count.argmax()]
    parent[full] = full[label]
    return parent


def linked_across(left: list[np.ndarray], right: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """Places of linked sets, one of either list and none of them empty: as many links as make one component of what links across the lists tie."""
    index, out = Index(right, least), []
    label = np.arange(len(left) + len(right))
    for q, own in enumerate(left):
        for r in index.search_for(own, label[len(left) :] == label[q]).tolist():
            if label[len(left) + r] != label[q]:
                out.append((q, r))
                label[label == label[len(left) + r]] = label[q]
    return out


def _verify(rows: pa.Table, width: int, least: int) -> pa.Table:
    """a, b: sets of a group tied to the first of their component, or, in a group of two blocks, those tied across them. A text that is not of the set it was fetched for is left out."""
    hashes, own = WordHashes(), {}
    block = dict(zip(rows.column("k").to_pylist(), rows.column("block").to_pylist()))
    for key, text in zip(rows.column("k").to_pylist(), raw(rows.column("text").combine_chunks())):
        if key not in own:
            found = shingles(words_of(text), hashes, width)
            if _key(found) == key:
                own[key] = found
    keys = sorted(own)
    if len(set(block.values())) == 2:
        left, right = ([k for k in keys if block[k] == b] for b in sorted(set(block.values())))
        tied = linked_across([own[k] for k in left], [own[k] for k in right], least) if left and right else []
        return pa.table({"a": pa.array([left[i] for i, _ in tied], pa.binary()), "b": pa.array([right[j] for _, j in tied], pa.binary())})
    label = linked([own[k] for k in keys], least)
    tied = [i for i in range(len(keys)) if label[i] != i]
    return pa.table({"a": pa.array([keys[i] for i in tied], pa.binary()), "b": pa.array([keys[label[i]] for i in tied], pa.binary())})


def _grouped(members: DataFrame) -> DataFrame:
    """k, text, root, block and part: the groups to be searched. A neighbourhood of more than BLOCK_SHINGLES is dealt into blocks; each block is a group, and every two."""
    weights = members.groupBy("root").agg(F.sum(F.col("n_shingles") + DOC_WEIGHT).alias("weight"))
    sized = members.join(weights.where(F.col("weight") > BLOCK_SHINGLES).withColumn("blocks", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")).select("root", "blocks"), "root", "left")
    own = F.pmod(_k1(), F.col("blocks").cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(own, b) * F.col("blocks") + F.greatest(own, b))
    return sized.select("k", "text", "root", F.coalesce(own, F.lit(0)).alias("block"), F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)).alias("part"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the documents that a filter of the ids in wanted lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h")), "h"))

    def make():
        held = np.frombuffer(sent.value, np.uint8)

        def step(part: pa.RecordBatch) -> list:
            names = [b"" if i is None else str(i).encode() for i in part.column("doc_id").to_pylist()]
            kept = part.filter(pa.array(passes(held, np.array([xxhash.xxh64_intdigest(n, 42) for n in names], np.uint64))))
            return [kept.column("doc_id"), kept.column("text")]

        return step

    return map_slices(docs, make, struct(docs, ("text", T.StringType())))


def join(df: DataFrame, width: int = WIDTH, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable over links, a link being a Jaccard similarity of least / 100 or more.

    Equal sets are one from the start. Sets that share one of their rarest shingles, as many as a link can't do without, fall into one
    neighbourhood; within it each asks, by T-occurrence search, which others share enough. Nothing is capped: large neighbourhoods
    are narrowed first, and what is still large is searched block by block. Sets are held as 64-bit hashes of shingles. Texts without words, and null, have an empty set and their own
    doc_id as component; rows that share a doc_id are rows of one document each with its own set; rows with a null id link with nothing
    and have a null component; an empty table gives no rows.
    """
    docs = spread(documents(df, text=text, key=key))
    rows = written(_profiles(docs, width, least))
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    near = _neighbourhoods(full, least)
    sets = full.groupBy("k").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"))
    members = written(sets.withColumn("node", _k1()).join(near, "node").select("node", "k", F.col("first").alias("doc_id"), "n_shingles", "root"))
    heavy = members.groupBy("root").agg(F.sum(F.col("n_shingles") + DOC_WEIGHT).alias("weight")).where(F.col("weight") > BLOCK_SHINGLES).select("root")
    large = written(members.join(heavy, "root"))
    if not large.isEmpty():
        narrowed = written(_narrowed(large.join(_texts(docs, large), "doc_id"), width, least))
        members = written(members.join(heavy, "root", "left_anti").unionByName(large.drop("root").join(narrowed, "node")))
    shape = "a binary, b binary"
    links = _grouped(members.join(_texts(docs, members), "doc_id")).groupBy("root", "part").applyInArrow(lambda t: _verify(t, width, least), shape)
    tied = components(links)
    named = sets.select("k", "first").join(tied.select(F.col("node").alias("k"), F.col("root").alias("tie")), "k")
    together = named.join(named.groupBy("tie").agg(F.min("first").alias("component_id")), "tie").select("k", "component_id")
    singles = sets.select("k", "first").join(together, "k", "left").select("k", F.coalesce("component_id", "first").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "k").join(singles, "k", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
