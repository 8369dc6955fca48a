"""Removal of long word sequences that an earlier document has, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import WordHashes, arrow_schema, documents, dropped, key_filter, map_slices, mix, passes, raw, saved, signed, spread, struct, written

#: Words of a window.
WINDOW = 50
#: Rounds after which Spark names the symbols of all texts, and drops windows whose symbol only one text has. Each round names runs, then pairs.
NAMED = (2, 3)
#: Spans of words are rounded up to multiples of this where symbols are looked up by span.
GRAIN = 8
#: Windows of an earlier text whose words one task is asked for at once.
ASKED = 5000


@dataclass
class Symbols:
    """A text in symbols: their names, and the first and past-last word that have a say in what each is and where it ends."""

    names: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    words: int


def _runs(s: Symbols) -> Symbols:
    """Names each run of equal symbols by the symbol and its length, whatever that is. A symbol's neighbours show where its run ends."""
    n = len(s.names)
    first = np.flatnonzero(np.append(True, s.names[1:] != s.names[:-1]))
    count = np.diff(np.append(first, n))
    names = s.names[first]
    many = count > 1
    names[many] = mix(names[many] * np.uint64(0x9FB21C651E98DF25) + count[many].astype(np.uint64))
    lo, hi = np.append(-1, s.lo), np.append(s.hi, s.words + 1)
    return Symbols(names, lo[first], hi[first + count], s.words)


def _pairs(s: Symbols, step: int) -> Symbols:
    """Names each pair of a left and a right symbol; a symbol's own bits say which it is, so pairs never overlap and are the same everywhere.

    A symbol without a partner depends on the neighbour that it might have had.
    """
    side = mix(s.names + np.uint64(step)) & np.uint64(1)
    first = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
    alone = np.ones(len(s.names), bool)
    alone[first] = alone[first + 1] = False
    after, before = np.append(s.hi[1:], s.words + 1), np.append(-1, s.lo[:-1])
    lo, hi = np.where(alone & (side == 1), before, s.lo), np.where(alone & (side == 0), after, s.hi)
    names = s.names.copy()
    names[first] = mix(mix(names[first]) + names[first + 1] * np.uint64(0xD1342543DE82EF95))
    hi[first] = s.hi[first + 1]
    keep = np.ones(len(names), bool)
    keep[first + 1] = False
    return Symbols(names[keep], lo[keep], hi[keep], s.words)


def parse(words: np.ndarray, rounds: int) -> Iterator[Symbols]:
    """The symbols after each round. Names are hashes of what they stand for, so all tasks give the same one to the same run or pair."""
    at = np.arange(len(words))
    symbols = Symbols(words, at, at + 1, len(words))
    for k in range(rounds):
        symbols = _pairs(_runs(symbols), k)
        yield symbols


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values; of fewer at the end."""
    blocks = -(-len(values) // width) + 1
    table = np.full(blocks * width, LAST, np.uint64).reshape(blocks, width)
    table.ravel()[: len(values)] = values
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(values)], left[width - 1 : width - 1 + len(values)])


LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15
_cache: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of an odd number modulo 2**64, or of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if (size, inverse) not in _cache:
        if len(_cache) > 3:
            _cache.clear()
        out = np.full(size, pow(BASE, -1, 1 << 64) if inverse else BASE, np.uint64)
        out[0] = 1
        _cache[size, inverse] = np.multiply.accumulate(out)
    return _cache[size, inverse][:n]


def anchors(words: np.ndarray, window: int = WINDOW, rounds: tuple[int, ...] = NAMED) -> tuple[list[np.ndarray], np.ndarray]:
    """For the window that starts at each word its symbol after each of the given rounds, and a hash of its words; equal windows have equal ones.

    `words` may hold many texts one after the other; only windows inside one text mean anything. A window's symbol is the least name among the
    symbols of which all that has a say lies inside the window, so that nothing before or after it does; the name is taken with the words that have
    a say, which makes it as rare as they are together. A window without any, as inside a long run of
    a word or of some words, is named by its least word.
    """
    n = len(words)
    if n < window:
        return [np.full(n, LAST) for _ in rounds], np.zeros(n, np.uint64)
    sums, back = np.zeros(n + 1, np.uint64), _powers(n, True)
    np.cumsum(words * _powers(n), out=sums[1:])
    hashes = np.zeros(n, np.uint64)
    hashes[: n - window + 1] = mix((sums[window:] - sums[: n - window + 1]) * back[: n - window + 1])
    out = []
    for k, s in enumerate(parse(words, max(rounds)), 1):
        if k not in rounds:
            continue
        inside = (s.lo >= 0) & (s.hi <= n)
        names, lo, hi = s.names[inside], s.lo[inside], s.hi[inside]
        names = mix((sums[hi] - sums[lo]) * back[lo] + names)
        span = -(-(hi - lo) // GRAIN) * GRAIN
        best = np.full(n, LAST)
        for length in range(GRAIN, window + 1, GRAIN):
            own = span == length
            if own.any():
                at = np.full(n, LAST)
                at[lo[own]] = names[own]
                best = np.minimum(best, _sliding_least(at, window - length + 1))
        none = best == LAST
        if none[: n - window + 1].any():
            best[none] = mix(_sliding_least(words, window)[none] + np.uint64(0x452821E638D01377))
        out.append(best)
    return out, hashes


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class _Slice:
    """The texts of a slice as one array of word values; the places of windows that lie inside a text, and each one's text."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes, window: int, rounds: tuple[int, ...]):
        self.words = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first = np.cumsum(sizes) - sizes
        values = np.concatenate([hashes.array(w) for w in self.words]) if len(texts) else np.empty(0, np.uint64)
        self.names, self.hashes = anchors(values, window, rounds)
        owner = np.repeat(np.arange(len(texts)), sizes)
        self.at = np.flatnonzero(np.arange(len(values)) + window <= np.repeat(self.first + sizes, sizes))
        self.owner = owner[self.at]

    def groups(self, chosen: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen windows' places, and where among them a new text, name or gap begins."""
        at, owner = self.at[chosen], self.owner[chosen]
        if not len(at):
            return at, np.empty(0, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (names[at[1:]] != names[at[:-1]]) | (at[1:] != at[:-1] + 1)
        return at, np.flatnonzero(new)


def _profiles(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, content (16 bytes that stand for the words), c (8 of them), whole (digest of the words joined by spaces), names (its windows' symbols after the first named round)."""

    def make():
        hashes = WordHashes()

        def step(part: pa.RecordBatch) -> list:
            own = _Slice(raw(part.column("text")), hashes, window, NAMED[:1])
            at, new = own.groups(np.ones(len(own.at), bool), own.names[0])
            owners = np.searchsorted(own.first, at[new], side="right") - 1 if len(new) else new
            cuts = np.searchsorted(owners, np.arange(part.num_rows + 1)) if len(new) else np.zeros(part.num_rows + 1, int)
            names = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(signed(own.names[0][at[new]]) if len(new) else [], pa.int64()))
            joined = [b" ".join(w) for w in own.words]
            contents = [xxhash.xxh3_128_digest(j) for j in joined]
            return [part.column("doc_id"), [len(w) for w in own.words], contents, [_hash(c) for c in contents], [hashlib.sha256(j).hexdigest() for j in joined], names]

        return step

    return map_slices(docs, make, struct(docs, ("n_words", T.LongType()), ("content", T.BinaryType()), ("c", T.LongType()), ("whole", T.StringType()), ("names", T.ArrayType(T.LongType()))))


def _mark(content: bytes) -> int:
    """The upper half of a spot: parts rows of one doc_id with different words."""
    return int.from_bytes(content[:4], "little") >> 1 << 32


def _hash(content: bytes) -> int:
    return int.from_bytes(content[:8], "little", signed=True)


def _windows(docs: DataFrame, sent, window: int) -> DataFrame:
    """doc_id, c (hash of the words), name, spot, hashes: the runs of windows whose symbol of the first named round more than one text may have, by their
    symbol of the last. spot: mark of the text and place of the first window."""

    def make():
        held, hashes = np.frombuffer(sent.value, np.uint8), WordHashes()

        def step(part: pa.RecordBatch) -> list:
            known = part.filter(part.column("doc_id").is_valid())
            own = _Slice(raw(known.column("text")), hashes, window, NAMED)
            names = own.names[-1]
            at, new = own.groups(passes(held, own.names[0][own.at]), names) if len(own.at) else (own.at, own.at)
            owners = np.searchsorted(own.first, at[new], side="right") - 1 if len(new) else np.empty(0, np.int64)
            contents = {o: xxhash.xxh3_128_digest(b" ".join(own.words[o])) for o in np.unique(owners).tolist()}
            marks = {o: _mark(c) for o, c in contents.items()}
            whole = {o: _hash(c) for o, c in contents.items()}
            spots = np.array([marks[o] for o in owners.tolist()], np.int64) + at[new] - own.first[owners] if len(new) else []
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(signed(own.hashes[at]), pa.int64()))
            return [known.column("doc_id").take(pa.array(owners)), [whole[o] for o in owners.tolist()], pa.array(signed(names[at[new]]) if len(new) else [], pa.int64()), spots, lists]

        return step

    return map_slices(docs, make, struct(docs, ("c", T.LongType()), ("name", T.LongType()), ("spot", T.LongType()), ("hashes", T.ArrayType(T.LongType()))))


def _shared(named: DataFrame) -> DataFrame:
    """name: of a name, c table the names that texts of different words have. Each task passes on two numbers a name at most."""
    return named.groupBy("name").agg(F.min("c").alias("c"), F.max("c").alias("d")).where("c <> d").select("name")


def _ranges(hits: DataFrame, window: int) -> DataFrame:
    """doc_id, mark, ranges (first word, number of words, and the earlier text's id, mark and first word) of doc_id, spot, owner, found rows: neighbouring windows that
    neighbouring windows of one earlier text are equal to, as one range."""
    source = hits.schema["owner"].dataType
    shape = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("owner", source), T.StructField("own_mark", T.LongType()), T.StructField("own_first", T.IntegerType())]))
    listed = hits.groupBy("doc_id", F.shiftright("spot", 32).alias("mark")).agg(F.sort_array(F.collect_list(F.struct(F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"), "owner", "found"))).alias("places"))
    schema = T.StructType([listed.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("ranges", shape)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column("places").to_pylist():
                found: list[dict] = []
                for p in places:
                    mark, place = p["found"] >> 32, p["found"] & 0xFFFFFFFF
                    last = found[-1] if found else None
                    n = last["words"] - window + 1 if last else 0
                    if last and last["owner"] == p["owner"] and last["own_mark"] == mark and last["first"] + n == p["place"] and last["own_first"] + n == place:
                        last["words"] += 1
                    else:
                        found.append({"first": p["place"], "words": window, "owner": p["owner"], "own_mark": mark, "own_first": place})
                out.append(found)
            plain = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(out, plain.field("ranges").type)], schema=plain)

    return listed.mapInArrow(run, schema)


def _digest(words: list[bytes], first: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[first : first + n])).digest()


def _asked(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """owner, own_mark, own_first, words, digest (SHA-256 of the words) of the earlier texts' ranges, each once, about ASKED of a text at a time."""
    each = ranges.select(F.explode("ranges").alias("r")).select("r.owner", "r.own_mark", "r.own_first", "r.words").distinct()
    each = written(each)
    parts = each.groupBy("owner", "own_mark").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
    part = F.pmod(F.xxhash64("own_first", "words"), F.col("parts"))
    wanted = each.join(parts, ["owner", "own_mark"]).groupBy("owner", "own_mark", part.alias("part")).agg(F.collect_list(F.struct("own_first", "words")).alias("asked"))
    rows = wanted.join(texts.select(F.col("doc_id").alias("owner"), F.col("mark").alias("own_mark"), "text").dropDuplicates(["owner", "own_mark"]), ["owner", "own_mark"])
    schema = T.StructType([rows.schema["owner"], T.StructField("own_mark", T.LongType()), T.StructField("told", T.ArrayType(T.StructType([T.StructField("own_first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("digest", T.BinaryType())])))])

    def make():
        def step(part: pa.RecordBatch) -> list:
            out = []
            for t, asked in zip(raw(part.column("text")), part.column("asked").to_pylist()):
                words = words_of(t)
                out.append([{**a, "digest": _digest(words, a["own_first"], a["words"])} for a in asked])
            return [part.column("owner"), part.column("own_mark"), out]

        return step

    return map_slices(rows.select("owner", "own_mark", "text", "asked"), make, schema).select("owner", "own_mark", F.explode("told").alias("t")).select("owner", "own_mark", "t.*")


class _Table:
    """Rows written to the shared folder until they are dropped."""

    def __init__(self, df: DataFrame):
        self.spark, self.where = df.sparkSession, saved(df)
        self.rows = self.spark.read.schema(df.schema).parquet(self.where)

    def drop(self) -> None:
        dropped(self.spark, self.where)


def deduplicate(df: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, ranges (first and past-last word of what goes) for each row.

    A word goes if a window of `window` words over it also starts in a row with a smaller doc_id. Rounds of recompression name runs of any length, then
    pairs, alike in all texts, so that equal windows have equal symbols inside them. After the second round, and again after the third, Spark
    gathers the names of all texts in a table, and windows whose name only one text has drop out. Of the others a hash of the words finds the
    least doc_id that has each window; neighbouring windows become ranges, and a range goes only if the SHA-256 digests of its words and of
    the earlier text's are equal. Texts whose words are all equal are settled as such, before windows meet: all but those of the least doc_id go
    whole if they have a window at all. Null and empty texts have no words. Rows that share a doc_id don't remove each other's words; a row with a null id
    removes and loses nothing; an empty table gives no rows.
    """
    docs = spread(documents(df, text=text, key=key))
    sc = df.sparkSession.sparkContext
    rows = written(_profiles(docs, window))
    names = rows.where("doc_id IS NOT NULL").select(F.explode("names").alias("name"), "c")
    first = rows.groupBy("content").agg(F.min("doc_id").alias("first"))
    copies = written(rows.where(F.col("n_words") >= window).join(first, "content").where("doc_id > first").select("doc_id", "content", "c").distinct().withColumn("copy", F.lit(True)))
    found = _Table(_windows(docs, sc.broadcast(key_filter(written(_shared(names)), "name")), window))
    live = _Table(found.rows.join(copies.select("doc_id", "c"), ["doc_id", "c"], "left_anti").join(_shared(found.rows), "name", "left_semi").select("doc_id", "name", "spot", "hashes"))
    found.drop()
    single = live.rows.select("doc_id", "name", "spot", F.posexplode("hashes").alias("i", "h")).select("doc_id", "name", "h", (F.col("spot") + F.col("i")).alias("spot"))
    least = _Table(single.groupBy("name", "h").agg(F.min("doc_id").alias("owner"), F.min_by("spot", "doc_id").alias("found"), F.max("doc_id").alias("most")).where("owner <> most").drop("most"))
    hits = _Table(single.join(least.rows, ["name", "h"]).where("doc_id > owner").select("doc_id", "spot", "owner", "found"))
    live.drop()
    least.drop()
    ranges = written(_ranges(hits.rows, window))
    hits.drop()
    ids = ranges.select("doc_id").unionByName(ranges.select(F.explode("ranges.owner").alias("doc_id"))).distinct()
    wanted = sc.broadcast(key_filter(written(ids.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"))), "h"))

    def make():
        held = np.frombuffer(wanted.value, np.uint8)

        def step(part: pa.RecordBatch) -> list:
            names = [str(i).encode() for i in part.column("doc_id").to_pylist()]
            ok = pa.array(passes(held, np.array([xxhash.xxh64_intdigest(n, 42) for n in names], np.uint64)))
            kept = part.filter(ok)
            digests = [xxhash.xxh3_128_digest(b" ".join(words_of(t))) for t in raw(kept.column("text"))]
            return [kept.column("doc_id"), kept.column("text"), digests, [_mark(d) >> 32 for d in digests]]

        return step

    texts = written(map_slices(docs, make, struct(docs, ("text", T.StringType()), ("content", T.BinaryType()), ("mark", T.LongType()))))
    each = ranges.select("doc_id", "mark", F.explode("ranges").alias("r")).select("doc_id", "mark", "r.*")
    told = each.join(_asked(texts, ranges), ["owner", "own_mark", "own_first", "words"]).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "words", "digest")).alias("told"))

    def cut():
        def step(part: pa.RecordBatch) -> list:
            removed, digests, spans = [], [], []
            for t, told in zip(raw(part.column("text")), part.column("told").to_pylist()):
                words = words_of(t)
                gone = np.zeros(len(words), bool)
                for r in told:
                    if _digest(words, r["first"], r["words"]) == r["digest"]:
                        gone[r["first"] : r["first"] + r["words"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
                spans.append([{"first": int(a), "end": int(b)} for a, b in edges])
            return [part.column("doc_id"), part.column("content"), removed, digests, spans]

        return step

    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    pieces = texts.join(told, ["doc_id", "mark"]).select("doc_id", "text", "content", "told")
    partly = map_slices(pieces, cut, struct(docs, ("content", T.BinaryType()), ("removed", T.LongType()), ("digest", T.StringType()), ("ranges", spans))).dropDuplicates(["doc_id", "content"])
    out = rows.drop("names", "c").join(copies.drop("c"), ["doc_id", "content"], "left").join(partly, ["doc_id", "content"], "left")
    whole = F.col("copy").isNotNull()
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))).otherwise(F.coalesce("ranges", F.array().cast(spans))).alias("ranges"),
    )
