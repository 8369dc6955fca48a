"""Encoding to identifiers and back by a table of distinct words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import documents, dropped, map_slices, release, saved, slices, spread, struct
from pergola.llm._bpe import Merges, merges, spaced_words

#: A block is closed when its texts have so many bytes or it has so many distinct words; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 500_000
#: Rows of the word table, one for each word and block that has it, that a part of the table holds about: the number of parts follows.
PART_WORDS = 250_000
#: Words of a block that are turned into identifiers at once.
RUN_WORDS = 1 << 20
#: Bytes of identifiers and texts that leave a block at once; a longer document leaves by itself.
OUT_BYTES = 4 << 20


def words_of(text: str | None, table: Merges) -> list[str]:
    """The words that merges don't cross, in order; special strings are words of their own, and no other word is equal to one."""
    if not text:
        return []
    found = []
    for k, part in enumerate(table.segments(text)):
        if k % 2:
            found.append(part)
        else:
            found += spaced_words(part)
    return found


def word_ids(word: str, table: Merges) -> list[int]:
    special = table.special.get(word)
    return table.encode(word.encode()) if special is None else [special]


class _Numbers(dict):
    """word -> number in order of first sight."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _shorter(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _longer(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**28 in seven bits a byte, the lowest first, with the eighth bit where more follow; then compressed."""
    numbers = numbers.astype(np.uint32)
    sizes = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        own = sizes > k
        out[(ends - sizes)[own] + k] = (numbers[own] >> np.uint32(7 * k)) & 127 | (sizes[own] > k + 1).astype(np.uint32) << 7
    return _shorter(out.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    found = np.frombuffer(_longer(data), np.uint8)
    ends = np.flatnonzero(found < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out = np.zeros(len(ends), np.uint32)
    for k in range(4):
        own = starts + k <= ends
        out[own] |= (found[starts[own] + k] & np.uint32(127)).astype(np.uint32) << np.uint32(7 * k)
    return out


def _batch(data: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(data)
    return sink.getvalue().to_pybytes()


def _unbatch(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as found:
        return found.read_next_batch()


class _Block:
    """Documents of one task whose words are numbered together."""

    def __init__(self):
        self.numbers, self.names, self.lengths, self.texts, self.size = _Numbers(), [], [], [], 0

    def add(self, name, text: str | None, table: Merges) -> None:
        words = words_of(text, table)
        self.names.append(name)
        self.lengths.append(len(words))
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(text or "")

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.numbers) >= BLOCK_WORDS

    def rows(self, schema: pa.Schema, block: int) -> pa.RecordBatch:
        """The block's words by falling frequency, so that most places are small numbers; and its documents as such numbers."""
        places = np.concatenate(self.texts)
        order = np.argsort(-np.bincount(places, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = np.array(list(self.numbers), object)[order] if len(order) else np.empty(0, object)
        values = [[block, block], [self.names, []], [self.lengths, []], [packed(rank[places]), _batch(pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"]))], [0, len(words)], ["texts", "words"]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


def _blocks(docs: DataFrame, path: str) -> DataFrame:
    """Two rows a block: kind 'words', its distinct words in the order of their numbers; kind 'texts', its documents as numbers of words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    name = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("names", T.ArrayType(name)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("kind", T.StringType())])
    plain = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table, first, k, block = merges(path), TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            for part in slices(batch):
                for n, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    block.add(n, t, table)
                    if block.full:
                        yield block.rows(plain, first + k)
                        k, block = k + 1, _Block()
        if block.names:
            yield block.rows(plain, first + k)
        del block
        release()

    return docs.mapInArrow(run, schema)


def word_table(blocks: DataFrame, parts: int) -> DataFrame:
    """part, block, words, numbers: each block's words with their numbers, dealt out by a hash of the word, so that a word's rows of all blocks meet in one part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                words = _unbatch(data).column("word")
                own = np.array([xxhash.xxh32_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint32) % np.uint32(parts)
                order = np.argsort(own, kind="stable")
                cuts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(order) else order
                for at in np.split(order, cuts[1:]) if len(order) else []:
                    found = _batch(pa.RecordBatch.from_arrays([words.take(pa.array(at))], ["word"]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(own[at[0]])], pa.int64()), pa.array([block], pa.int64()), pa.array([found], pa.binary()), pa.array([packed(np.diff(at, prepend=0))], pa.binary())], ["part", "block", "words", "numbers"])

    return blocks.select("block", "data").mapInArrow(run, "part long, block long, words binary, numbers binary")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """block, numbers, sizes, ids: the identifiers of word_table()'s rows in their order, and how many each word has. All rows of a word are in one part, which encodes it once."""

    def part(rows: pa.Table) -> pa.Table:
        table, known, sizes, ids = merges(path), {}, [], []
        for data in rows.column("words").to_pylist():
            own = _unbatch(data).column("word").to_pylist()
            for w in own:
                if w not in known:
                    known[w] = word_ids(w, table)
            found = [known[w] for w in own]
            sizes.append(packed(np.fromiter(map(len, found), np.uint32, len(found))))
            ids.append(packed(np.fromiter(chain.from_iterable(found), np.uint32)))
        return pa.table({"block": rows.column("block").cast(pa.int64()), "numbers": rows.column("numbers").cast(pa.binary()), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return words.groupBy("part").applyInArrow(part, "block long, numbers binary, sizes binary, ids binary")


IDS = (T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()))
DECODED = T.StructField("decoded", T.StringType())


class Pieces:
    """The id-to-piece table: as many rows as the vocabulary has; the key is a row's place, so that a join is a take of places."""

    def __init__(self, table: Merges):
        self.sizes = np.array([len(p) for p in table.pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(table.pieces), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        """The pieces of identifiers one after the other; bytes that are not UTF-8 become U+FFFD."""
        return self.data[_ranges(self.starts[ids], self.sizes[ids])].tobytes().decode("utf-8", "replace")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def _assembled(texts: pa.Table, coded: pa.Table, pieces: Pieces | None) -> Iterator[tuple[object, np.ndarray, str | None]]:
    """The documents of a block: the identifiers of each word of the block, joined back to every place that has its number."""
    joined = lambda found: np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    numbers = joined(np.cumsum(unpacked(d), dtype=np.int64) for d in coded.column("numbers").to_pylist())
    own = joined(unpacked(d) for d in coded.column("sizes").to_pylist())
    flat = np.concatenate([*(unpacked(d) for d in coded.column("ids").to_pylist()), np.empty(0, np.uint32)])
    sizes, starts = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    sizes[numbers], starts[numbers] = own, np.cumsum(own) - own
    for names, lengths, data in zip(texts.column("names").to_pylist(), texts.column("lengths").to_pylist(), texts.column("data").to_pylist()):
        places, at = unpacked(data), 0
        for name, n in zip(names, lengths):
            cut = places[at : at + n]
            at += n
            ids = np.concatenate([flat[_ranges(starts[c], sizes[c])] for c in np.split(cut, range(RUN_WORDS, n, RUN_WORDS))])
            yield name, ids.astype("<u4"), pieces.text(ids) if pieces else None


def assembled(block: pa.Table, pieces: Pieces | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents of a block in batches of about OUT_BYTES. block: its row of documents, which has data, and its rows of coded words, which have none."""
    coded = pc.is_null(block.column("data"))
    out, size = [], 0
    for name, ids, text in _assembled(block.filter(pc.invert(coded)), block.filter(coded), pieces):
        out.append((name, ids.tobytes(), len(ids), text))
        size += ids.nbytes + len(text or "")
        if size >= OUT_BYTES:
            yield _columns(out, schema)
            out, size = [], 0
    if out:
        yield _columns(out, schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens for each row; with decoded also the text that decode() makes of the ids.

    Spark splits the texts into words, block by block of documents. The words of all blocks meet by their hash, where each distinct word is
    encoded once, whatever its length or frequency; its identifiers go back to the blocks that have it and are joined to the places of the
    texts by the word's number. A word has one row a block, so frequent words weigh no more than others. Special strings become their own ids.
    Null and empty texts have no ids; repeated rows give a row each; a null key stays null; an empty table gives no rows.
    """
    where = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = spread(documents(df, text=text, key=key))
    spark = df.sparkSession
    blocks = _blocks(docs, where)
    held = saved(blocks, "kind")
    both = spark.read.schema(blocks.schema).parquet(held)
    words = both.where("kind = 'words'")
    total, count = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_WORDS))
    coded = encode_words(word_table(words, parts), where)
    found = spark.read.schema(coded.schema).parquet(saved(coded))
    dropped(spark, f"{held}/kind=words")
    schema = struct(docs, *((f.name, f.dataType) for f in (*IDS, *((DECODED,) if decoded else ()))))
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = to_arrow_schema(schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from assembled(pa.Table.from_batches(batches), Pieces(merges(where)) if decoded else None, plain)
        release()

    texts = both.where("kind = 'texts'").select("block", "names", "lengths", "data")
    rows = texts.unionByName(found, allowMissingColumns=True).repartition(max(1, count), "block")
    return rows.groupBy("block").applyInArrow(assemble, schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens of encode()'s rows, or of any with those columns, with decoded, their text by the id-to-piece table.

    Bytes that are not UTF-8 become U+FFFD, as identifiers that were not made from a text may give them. Null ids give ''.
    """
    where = path or public_tokenizers.path("byte_bpe_50k.json")

    def make():
        pieces = Pieces(merges(where))
        return lambda part: [part.column("doc_id"), part.column("ids"), part.column("n_tokens"), [pieces.text(np.frombuffer(i or b"", "<u4")) for i in part.column("ids").to_pylist()]]

    return map_slices(coded.select("doc_id", "ids", "n_tokens"), make, T.StructType([coded.schema["doc_id"], *IDS, DECODED]), column="ids")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decode()'s rows."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
