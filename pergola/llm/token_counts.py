"""Token counts of whole texts without emitting a token."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pergola.llm._arrow import documents, map_slices, spread, struct
from pergola.llm._bpe import ended_words, merges

#: Words whose count a task keeps; then it starts anew.
MEMO_WORDS = 300_000


def normal(text: str) -> str:
    """NFC, then lower case by character: a sigma at a word's end gets no form of its own."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


class _Counts(dict):
    def __init__(self, path: str):
        super().__init__()
        self.table = merges(path)

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        n = self[word] = self.table.count(word.encode())
        return n

    def text(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.table.segments(text)):
            if k % 2:
                total += 1
            else:
                total += sum(map(self.__getitem__, ended_words(normal(part))))
        return total


def count_tokens(df: DataFrame, path: str | None = None, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    Adjacent symbols of a word are merged from a heap of pairs over a linked list, lowest rank first and leftmost among equals;
    a word's count is its initial symbols less its merges. A task keeps the counts of MEMO_WORDS words at most.
    Null and empty texts have no bytes and no tokens; repeated rows give a row each; a null key stays null; an empty table gives no rows.
    """
    where = path or public_tokenizers.path("word_bpe_49k.json")
    docs = spread(documents(df, text=text, key=key))

    def make():
        counts = _Counts(where)

        def step(part: pa.RecordBatch) -> list:
            texts = part.column("text").to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            tokens = [counts.text(t) if t else 0 for t in texts]
            return [part.column("doc_id"), sizes, tokens, [n > limit for n in tokens]]

        return step

    return map_slices(docs, make, struct(docs, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())))
