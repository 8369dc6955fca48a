"""Fill-in-the-middle training texts: token boundaries as packed bit vectors, cut by rank and select."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import documents, map_slices, spread, struct

SEED = 42
#: Of 100 documents so many are cut; of 100 that are cut so many have their suffix first.
CUT_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: 64-bit words of a block; the directory has the number of ones before each block.
BLOCK_WORDS = 8

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Bits:
    """A packed bit vector with a directory of the ones before each block, for rank and select of many places at once."""

    def __init__(self, bits: np.ndarray):
        words = -(-len(bits) // (64 * BLOCK_WORDS)) * BLOCK_WORDS or BLOCK_WORDS
        packed = np.zeros(words * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.blocks = packed.view("<u8").reshape(-1, BLOCK_WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        block, inside = np.divmod(places, 64 * BLOCK_WORDS)
        last = block == len(self.blocks)
        rows = self.blocks[np.where(last, 0, block)]
        low = np.clip(inside[:, None] - 64 * np.arange(BLOCK_WORDS), 0, 64)
        masks = np.where(low == 64, np.uint64(2**64 - 1), (np.uint64(1) << (low % 64).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.where(last, 0, np.bitwise_count(rows & masks).sum(axis=1, dtype=np.int64))

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the one that has `rank` ones before it."""
        block = np.searchsorted(self.before, ranks, side="right") - 1
        rows = self.blocks[block]
        upto = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        left = ranks - self.before[block]
        word = (upto <= left[:, None]).sum(axis=1)
        each = np.arange(len(ranks))
        left = left - np.where(word > 0, upto[each, word - 1], 0)
        ones = np.unpackbits(np.ascontiguousarray(rows[each, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 64 * BLOCK_WORDS + word * 64 + (np.cumsum(ones, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)


def token_ends(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True at the last byte of each token of texts that lie one after the other; stops: where each text ends.

    A token is a run of other characters with the white space before it, or the white space at a text's end; white space is ASCII, so
    bytes tell all.
    """
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[stops[stops > 0] - 1] = True
    return ends


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """The first four groups of eight hexadecimal digits of a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and where each starts and stops; a null text is empty."""
    plain = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    held = plain.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def transform(
    df: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the columns in keep, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output for each row.

    A digest of seed and id decides all, so a row gets the same form wherever and whenever it is run. The texts of a slice lie one after the
    other; one bit vector has a one at each token's last byte, another at each character's first. The ones inside a text are its n, select finds
    the bytes where prefix and middle end, and rank on the characters' vector tells their lengths.

    Null and empty texts are plain, with no tokens and an empty output, as are texts that hold a mark. Repeated rows and equal ids
    are cut alike; a null id is cut as an empty one and stays null; an empty table gives no rows; no other column is read.
    """
    docs = spread(documents(df, *keep, text=text, key=key))
    whole = struct(docs, *((c, docs.schema[c].dataType) for c in keep), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def make():
        def step(part: pa.RecordBatch) -> list:
            data, starts, stops = _bytes_of(part.column("text"))
            ends = Bits(token_ends(data, stops))
            characters = Bits((data & 0xC0) != 0x80)
            first = ends.rank(starts)
            n = ends.rank(stops) - first
            h = np.array([draws(seed, i) for i in part.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
            units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            cuts = [starts.copy(), starts.copy()]
            for cut, rank in zip(cuts, units.T):
                some = rank > 0
                cut[some] = ends.select(first[some] + rank[some] - 1) + 1
            chars = [characters.rank(at) for at in (starts, *cuts)]
            forms, outputs, texts = [], [], data.tobytes()
            for k, (start, one, two, stop) in enumerate(zip(starts.tolist(), cuts[0].tolist(), cuts[1].tolist(), stops.tolist())):
                own = texts[start:stop]
                if not own or h[k, 2] % 100 >= cut_percent or any(m in own for m in marks):
                    forms.append("plain")
                    outputs.append(own)
                    continue
                prefix, middle, suffix = texts[start:one], texts[one:two], texts[two:stop]
                if h[k, 3] % 100 < suffix_first_percent:
                    forms.append("spm")
                    outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            counts = [pa.array(b - a, pa.int64(), mask=plain) for a, b in zip(chars, chars[1:])]
            return [part.column("doc_id"), *(part.column(c) for c in keep), n, forms, *counts, pa.array(outputs, pa.binary()).cast(pa.string())]

        return step

    return map_slices(docs, make, whole)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, in native expressions: the marks stand once in it, so they alone tell the parts."""
    tail = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substr(F.substring_index(head, SUFFIX, 1), F.lit(len(PREFIX) + 1)), tail, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), tail, F.substr(F.substring_index(head, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(found: DataFrame) -> DataFrame:
    """The digests of each output and of the text rebuilt from it."""
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
