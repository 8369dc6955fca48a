"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import documents, map_slices, raw, runs_of, slices, spread, written

#: Words of a window, and of the shingles by which windows are found.
WINDOW = 13
SHINGLE = 5
#: Windows sent to the tasks at once, and bytes of their words and items; a larger benchmark is taken in several blocks.
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 64 << 20

#: Bytes below 0x80 that are not a digit or a lower-case letter part words.
PARTS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and takes the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text."""
    return text.lower().translate(PARTS).split() if text else []


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """win (its words joined by spaces), items (ids as sorted strings): the distinct windows; an item of fewer words is one window."""
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, wins = [], []
                for name, t in zip(part.column("item").to_pylist(), raw(part.column("text"))):
                    words = words_of(t)
                    found = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                    ids += [name] * len(found)
                    wins += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], names=["item", "win"])

    return rows.mapInArrow(run, "item string, win binary").groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass
class Block:
    """A bounded set of windows: their words, the items that have them, numbers for their words."""

    windows: list[list[bytes]]
    items: list[list[str]]
    numbers: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        for words in self.windows:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.widths = sorted({min(SHINGLE, len(words)) for words in self.windows})

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """0 for words that no window has."""
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint64, len(words))

    def shingles(self, numbers: np.ndarray, width: int) -> np.ndarray:
        return runs_of(numbers, width, width)

    def all_shingles(self) -> np.ndarray:
        found = [self.shingles(self.numbered(w), min(SHINGLE, len(w))) for w in self.windows]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)

    def prefixes(self, shingles: np.ndarray, frequency: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """shingle -> (window, place in it): of each window the shingles that a document containing it can't lack in the order of rarity.

        A set of n shingles contained whole has a prefix of n - n + 1 = 1: its rarest. A window whose rarest shingle no document has is left out.
        """
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.windows):
            own = self.shingles(self.numbered(words), min(SHINGLE, len(words)))
            seen = frequency[np.searchsorted(shingles, own)]
            at = int(np.lexsort((own, seen))[0])
            if seen[at]:
                out[int(own[at])].append((k, at))
        return dict(out)


def among(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that are among the keys, and the keys' places."""
    if not len(sorted_keys) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == values)
    return hit, at[hit]


def _frequencies(docs: DataFrame, block: Block, shingles: np.ndarray) -> np.ndarray:
    """In how many documents each shingle of the block occurs, over all documents."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((block, shingles))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys = sent.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in slices(batch):
                for t in raw(part.column("text")):
                    numbers = block.numbered(words_of(t))
                    if not numbers.any():
                        continue
                    for width in block.widths:
                        total[np.unique(among(keys, block.shingles(numbers, width))[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    out = np.zeros(len(shingles), np.int64)
    for row in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


@dataclass
class _Finder:
    block: Block
    prefixes: dict[int, list[tuple[int, int]]]

    def __post_init__(self):
        self.keys = np.array(sorted(self.prefixes), np.uint64)

    def search(self, words: list[bytes], mask: np.ndarray, items: set[str]) -> None:
        """Marks the words of all occurrences and adds the items that have them: prefix, then place and length, then the words themselves."""
        if not len(self.keys):
            return
        numbers = self.block.numbered(words)
        if not numbers.any():
            return
        for width in self.block.widths:
            where, which = among(self.keys, self.block.shingles(numbers, width))
            for p, k in zip(where.tolist(), which.tolist()):
                for w, offset in self.prefixes[int(self.keys[k])]:
                    own = self.block.windows[w]
                    start = p - offset
                    if start >= 0 and start + len(own) <= len(words) and min(SHINGLE, len(own)) == width and words[start : start + len(own)] == own:
                        mask[start : start + len(own)] = True
                        items.update(self.block.items[w])


RESULT = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("contaminated", T.BooleanType()))
STATE = (("text", T.StringType()), ("mask", T.BinaryType()), ("items", T.ArrayType(T.StringType())))


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_words, n_hit, items (sorted ids as strings), contaminated for each document.

    Shingles of SHINGLE words are ordered by the number of documents that have them; a window is looked up by its rarest one alone,
    which any document containing it must have. Bounds on place and length follow, then the window's words are compared.
    The distinct windows are written once and go to the tasks in blocks of block_windows windows and BLOCK_BYTES bytes at most on average, whatever the
    benchmark's size, and documents are never shuffled; each block reads the documents twice. The items of one window go with it, however many.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and are clean; items without words match nothing;
    an item with a null id still hits words but is not listed; repeated rows give a row each; an empty benchmark hits nothing.
    """
    docs = spread(documents(df, *keep, text=text, key=key))
    windows = written(item_windows(benchmark, item, item_text, window))
    weight = F.length("win") + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x) + 8)
    n_windows, size = windows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    blocks = max(1, -(-n_windows // block_windows), -(-size // BLOCK_BYTES))
    parts = windows.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(blocks)))
    kept = [docs.schema[n] for n in keep]
    state, schema = docs, T.StructType([docs.schema["doc_id"], *kept, *(T.StructField(n, t) for n, t in STATE if n not in keep)])
    last = T.StructType([docs.schema["doc_id"], *kept, *(T.StructField(n, t) for n, t in RESULT)])
    for b in range(blocks):
        rows = parts.where(F.col("block") == b).select("win", "items").collect() if n_windows else []
        rows.sort(key=lambda r: bytes(r.win))
        block = Block([bytes(r.win).split() for r in rows], [list(r["items"]) for r in rows])
        shingles = block.all_shingles()
        sent = df.sparkSession.sparkContext.broadcast(_Finder(block, block.prefixes(shingles, _frequencies(docs, block, shingles)) if rows else {}))
        state = map_slices(state, _searching(sent, keep, b == 0, b == blocks - 1), last if b == blocks - 1 else schema)
    return state


def _searching(sent, keep: tuple[str, ...], first: bool, last: bool):
    def make():
        finder = sent.value

        def step(part: pa.RecordBatch) -> list:
            texts, kept = raw(part.column("text")), [part.column(k) for k in keep]
            masks, found, sizes, hits = [], [], [], []
            before = zip(repeat(None), repeat(None)) if first else zip(part.column("mask").to_pylist(), part.column("items").to_pylist())
            for t, (bits, items) in zip(texts, before):
                words = words_of(t)
                n = len(words)
                mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else np.zeros(n, bool)
                names = set(items or ())
                finder.search(words, mask, names)
                sizes.append(n)
                hits.append(int(mask.sum()))
                found.append(sorted(names))
                if not last:
                    masks.append(np.packbits(mask).tobytes())
            if last:
                return [part.column("doc_id"), *kept, sizes, hits, found, [h > 0 and 20 * h >= n for h, n in zip(hits, sizes)]]
            return [part.column("doc_id"), *kept, *(() if "text" in keep else (part.column("text"),)), masks, found]

        return step

    return make


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
