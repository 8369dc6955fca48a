"""Language identification: words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import documents, map_slices, sampled, slices, spread, written
from pergola.llm._bpe import LETTERS, narrow

#: The learning sample: so many documents of each language at most, by a hash of their id. All their words and n-grams are kept.
DOCS_PER_LANG = 2500
LONGEST = 4
MEMO_WORDS = 250_000

_NARROW = re.compile(f"[{LETTERS}]+")
_WIDE = regex.compile(r"\p{L}+")


def letter_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return (_NARROW if narrow(text) else _WIDE).findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """A word's character n-grams with its ends marked; of one character without them."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Table:
    """Keys' places, and a row of log frequencies for each, one column a language."""

    places: dict[str, int]
    logs: np.ndarray

    def get(self, key: str) -> np.ndarray | None:
        at = self.places.get(key)
        return None if at is None else self.logs[at]


@dataclass
class LanguageModel:
    """langs: the languages in order. words, and grams by their length."""

    langs: list[str]
    words: Table
    grams: dict[int, Table]


def _logs(counts: pa.Table, langs: list[str]) -> Table:
    """Additively smoothed log frequencies of the keys of a lang, key, n table."""
    keys = sorted(set(counts.column("key").to_pylist()))
    places = {k: i for i, k in enumerate(keys)}
    column = {name: i for i, name in enumerate(langs)}
    table = np.zeros((len(keys), len(langs)))
    at = [places[k] for k in counts.column("key").to_pylist()], [column[x] for x in counts.column("lang").to_pylist()]
    table[at] = counts.column("n").to_numpy()
    return Table(places, np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * (len(keys) + 1))).astype(np.float32))


def gram_counts(words: DataFrame, n: int) -> DataFrame:
    """lang, key, n: the n-grams of the words of a lang, word, n table, as grams() cuts them."""
    padded = F.concat(F.lit(" "), "word", F.lit(" ")) if n > 1 else F.col("word")
    cut = words.select("lang", "n", padded.alias("w")).where(F.length("w") >= n)
    found = F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring("w", i, F.lit(n)))
    return cut.select("lang", "n", F.explode(found).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(df: DataFrame, docs_per_lang: int = DOCS_PER_LANG, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learns from at most docs_per_lang documents of each non-null language; rows without a text or key teach nothing.

    Words and n-grams are counted in Spark; their tables, as large as the sample makes them, are collected. An empty table gives no languages.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    chosen = sampled(known.select("doc_id", "lang").distinct(), "lang", docs_per_lang).select("doc_id").distinct()
    sample = known.join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch):
                for t, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    seen[name].update(letter_words(t))
        for name, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])

    counted = spread(sample.select("text", "lang")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(counted)
    langs = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    own = _logs(words.withColumnRenamed("word", "key").toArrow(), langs)
    return LanguageModel(langs, own, {n: _logs(gram_counts(words, n).toArrow(), langs) for n in range(1, LONGEST + 1)})


class Scorer(dict):
    """word -> place of its row of log frequencies; keeps MEMO_WORDS words at most."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, max(1, len(model.langs))), np.float32)
        self.none = np.zeros(self.rows.shape[1], np.float32)

    def row(self, word: str) -> np.ndarray:
        """The word's own log frequencies; else the mean over its known n-grams of the greatest n that has any; else zeros."""
        own = self.model.words.get(word)
        if own is not None:
            return own
        for n in range(LONGEST, 0, -1):
            table = self.model.grams[n]
            known = [r for g in grams(word, n) if (r := table.get(g)) is not None]
            if known:
                return np.mean(known, axis=0)
        return self.none

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.row(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self) > MEMO_WORDS:
            self.clear()
            self.rows = np.zeros((1024, self.rows.shape[1]), np.float32)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(axis=0, dtype=np.float64) / np.sqrt(len(words))
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(df: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, lang_pred, score for each row.

    score is the share of the best language among all after the log frequencies' sum is divided by the root of the number of words.
    Null texts and those without a letter are 'und' with score 0; ties go to the language first by name; repeated rows give a row each.
    """
    docs = spread(documents(df, *keep, text=text, key=key))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[n] for n in ("doc_id", *keep)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        scorer = Scorer(sent.value)

        def step(part: pa.RecordBatch) -> list:
            found = [scorer.predict(t) for t in part.column("text").to_pylist()]
            return [part.column("doc_id"), *(part.column(k) for k in keep), [f[0] for f in found], [f[1] for f in found]]

        return step

    return map_slices(docs, make, schema)


def remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
