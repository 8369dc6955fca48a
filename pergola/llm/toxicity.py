"""Toxicity by two interpolated Kneser-Ney models of words, one for each label, over shared backoff counts of words and of their characters."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import documents, map_slices, raw, runs_of, sampled, slices, spread
from pergola.llm.decontaminate import words_of

#: Labelled rows of each class the models learn from at most, by a hash of their id; every third of them sets the scale instead.
DOCS_PER_CLASS = 2500
#: Characters of the longest sequence counted.
ORDER = 6
#: A word's counts stand, less DISCOUNT, if one of them is over what the shared probability lets expect in that class by DISCOUNT and so many standard
#: deviations (roots of that); others are discounted whole. All that is discounted goes to the shared counts, so a word whose excess may be chance is as
#: likely in both classes, and the topics and languages of the labelled rows, which make such chances, don't outweigh a few insults.
DEVIATIONS = 3.0
DISCOUNT = 1.0
#: The weight that shared counts have in either class besides.
BACKOFF = 50.0
#: Longer words are modelled in parts of so many bytes, each in the context that the part before it leaves.
WORD_BYTES = 512
#: Begins a part that is not a word's first, and ends one that is not its last; no word has these bytes.
AFTER, OPEN = b"\x01", b"\x02"
MEMO_WORDS = 300_000


def _layout(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words padded by ORDER - 1 starts and an end, in one array; the places predicted; the word of each such place.

    A later part of a word has the ORDER - 1 bytes before it in place of starts; a part that goes on has no end.
    """
    bare = [w.strip(AFTER + OPEN) for w in words]
    later = np.array([w.startswith(AFTER) for w in words], bool)
    ended = np.array([not w.endswith(OPEN) for w in words], bool)
    lengths = np.fromiter(map(len, bare), np.int64, len(words))
    span = lengths + np.where(later, 0, ORDER - 1) + ended
    starts = np.cumsum(span) - span
    codes = np.full(int(span.sum()), 256, np.uint64)
    body = np.ones(len(codes), bool)
    inner = body.copy()
    for k in range(ORDER - 1):
        body[starts + k] = False
        inner[(starts + k)[~later]] = False
    ends = (starts + span - 1)[ended]
    inner[ends] = False
    codes[inner] = np.frombuffer(b"".join(bare), np.uint8)
    codes[ends] = 257
    places = np.flatnonzero(body)
    return codes, places, np.repeat(np.arange(len(words)), span - (ORDER - 1))


def _keys(codes: np.ndarray, width: int) -> np.ndarray:
    """At each place the hash of the `width` values that end there; places with fewer before them get 0."""
    out = np.zeros(len(codes), np.uint64)
    if len(codes) >= width:
        out[width - 1 :] = runs_of(codes, width, width)
    return out


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among sorted keys; one past the last for those that are not there."""
    if not len(keys):
        return np.zeros(len(values), np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, len(keys))


@dataclass
class Order:
    """Sequences of one length over both classes: counts, and of their contexts totals and numbers of successors; the last row is for the unknown."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    types: np.ndarray
    discount: float


@dataclass
class ToxicityModel:
    """shared: orders 2 to ORDER of characters, and first the order below them; keys: sorted hashes of the words; seen: their discounted shares in both
    classes together, unseen: what these leave to characters; kept: their discounted shares in each class, free: what these leave to the shared
    probability; the last rows of seen and kept are for unknown words. weights: of the comparison and a constant."""

    shared: list[Order]
    first: np.ndarray
    keys: np.ndarray
    seen: np.ndarray
    unseen: float
    kept: np.ndarray
    free: np.ndarray
    weights: np.ndarray


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _discount(table: np.ndarray) -> float:
    ones, twos = int((table == 1).sum()), int((table == 2).sum())
    return min(max(ones / max(ones + 2 * twos, 1), 0.3), 0.95)


def _pad(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, np.zeros((1, *a.shape[1:]))]).astype(np.float32)


def fit(words: list[bytes], counts: np.ndarray) -> ToxicityModel:
    """counts: documents with each word, by class. The longest sequences of characters have those of both, shorter ones the numbers of values seen before them."""
    codes, places, owner = _layout(words)
    shared: list[Order] = []
    both = counts.sum(axis=1).astype(np.float64)
    for width in range(ORDER, 1, -1):
        context = _keys(codes, width - 1)[places - 1]
        keys, first, inverse = np.unique(_keys(codes, width)[places], return_index=True, return_inverse=True)
        contexts, which = np.unique(context[first], return_inverse=True)
        sums = lambda values: np.bincount(which, values, len(contexts))
        if width == ORDER:
            table = np.bincount(inverse, both[owner], len(keys))
        else:
            at = np.unique(_keys(codes, width + 1)[places], return_index=True)[1]
            table = np.bincount(inverse[at], minlength=len(keys)).astype(float)
        shared.append(Order(keys, _pad(table), contexts, _pad(sums(table)), _pad(sums(table > 0)), _discount(table)))
    pairs = np.unique(codes[places - 1] * np.uint64(258) + codes[places])
    values, n = np.unique(pairs % np.uint64(258), return_counts=True)
    base = np.ones(258)
    base[values.astype(np.int64)] += n
    shared, base = shared[::-1], base / base.sum()
    total, less = max(both.sum(), 1.0), _discount(both)
    seen = np.maximum(both - less, 0) / total
    unseen = 1 - float(seen.sum())
    expected = (seen + unseen * np.exp(character_likelihoods(shared, base, words)[0]))[:, None] * counts.sum(axis=0)
    told = (counts > expected + DEVIATIONS * np.sqrt(expected) + DISCOUNT).any(axis=1)
    gone = np.where(told[:, None], np.minimum(counts, DISCOUNT), counts)
    sizes = counts.sum(axis=0) + BACKOFF
    hashes = _hashes(words)
    order = np.argsort(hashes)
    last = lambda a: np.concatenate([a[order], np.zeros((1, *a.shape[1:]))])
    return ToxicityModel(shared, base, hashes[order], last(seen), unseen, last((counts - gone) / sizes), (gone.sum(axis=0) + BACKOFF) / sizes, np.array([6.0, -3.0]))


def character_likelihoods(shared: list[Order], first: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word its log-likelihood by characters, over both classes, and its number of predicted values: interpolated Kneser-Ney, whose lower orders
    count the values that a sequence was seen after."""
    codes, places, owner = _layout(words)
    p = first[codes[places].astype(np.int64)]
    for width, o in enumerate(shared, 2):
        at = _find(o.keys, _keys(codes, width)[places])
        where = _find(o.contexts, _keys(codes, width - 1)[places - 1])
        total = o.totals[where]
        seen = np.maximum(total, 1e-9)
        p = np.where(total > 0, np.maximum(o.counts[at] - o.discount, 0) / seen + o.discount * o.types[where] / seen * p, p)
    return np.bincount(owner, np.log(p), len(words)), np.bincount(owner, minlength=len(words)).astype(float)


def word_likelihoods(model: ToxicityModel, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word its log-likelihood under the ordinary and under the toxic model, and its number of characters with its end.

    Interpolated Kneser-Ney: the word's discounted share in the class, and what the discounts leave times its shared probability, which is its
    discounted share in both classes, and what that leaves times its probability by characters.
    """
    logs, size = character_likelihoods(model.shared, model.first, words)
    at = _find(model.keys, _hashes(words))
    return np.log(model.kept[at] + model.free * (model.seen[at] + model.unseen * np.maximum(np.exp(logs), 1e-300))[:, None]), size


def parts_of(text: bytes | None) -> list[bytes]:
    words = words_of(text)
    return [p for w in words for p in cut(w)] if words and max(map(len, words)) > WORD_BYTES else words


def cut(word: bytes) -> list[bytes]:
    """A long word as parts whose characters together are as likely as the whole's."""
    if len(word) <= WORD_BYTES:
        return [word]
    at = range(0, len(word), WORD_BYTES)
    parts = [word[max(0, i - ORDER + 1) : i + WORD_BYTES] for i in at]
    return [(AFTER if i else b"") + p + (OPEN if i + WORD_BYTES < len(word) else b"") for i, p in zip(at, parts)]


class Ratios(dict):
    """word -> place of its ratio and size; words that are new to a slice are scored together."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.ratio = np.zeros(0)
        self.size = np.zeros(0)

    def meet(self, texts: list[list[bytes]]) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.ratio, self.size = np.zeros(0), np.zeros(0)
        new = sorted({w for words in texts for w in words if w not in self})
        if new:
            logs, size = word_likelihoods(self.model, new)
            ratio = logs[:, 1] - logs[:, 0]
            self.update(zip(new, range(len(self.ratio), len(self.ratio) + len(new))))
            self.ratio, self.size = np.concatenate([self.ratio, ratio]), np.concatenate([self.size, size])

    def comparison(self, words: list[bytes]) -> float:
        """The log-likelihood under the toxic model less that under the ordinary one, normalised by the root of the length, by which chance differences
        grow, as a signed square root."""
        if not words:
            return 0.0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = float(self.ratio[at].sum() / np.sqrt(self.size[at].sum()))
        return float(np.copysign(np.sqrt(abs(found)), found))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns and a constant, by Newton steps with a small penalty."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.array([0.01] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(df: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, toxic: str = "toxic", text: str = "text", key: str = "doc_id") -> ToxicityModel:
    """Learns from at most docs_per_class rows of either label, chosen by a hash of the id; null ids, labels and texts teach nothing.

    Of several labels of a document the highest counts. Two thirds of the sample give the counts, the rest the scale of the scores.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col(toxic).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = sampled(known, "label", docs_per_class).withColumn("scale", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0)
    rows = documents(df, text=text, key=key).where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "label", "scale")), "doc_id").dropDuplicates(["doc_id", "text"]).persist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch):
                for t, label in zip(raw(part.column("text")), part.column("label").to_pylist()):
                    seen[label].update(set(parts_of(t)))
        for label, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.array([label] * len(words), pa.int32()), pa.array(words.values(), pa.int64())], names=["word", "label", "n"])

    found = rows.where("NOT scale").select("text", "label").mapInArrow(run, "word binary, label int, n long").groupBy("word", "label").agg(F.sum("n").alias("n")).toArrow()
    own = found.column("word").to_pylist()
    words = sorted(set(own))
    place = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(words), 2))
    counts[[place[w] for w in own], found.column("label").to_numpy()] = found.column("n").to_numpy()
    del found, own, place
    model = fit(words, counts)
    tuned = _compared(rows.where("scale").select("doc_id", "text", "label"), model, ("label",)).select("label", "comparison").collect()
    rows.unpersist()
    y = np.array([r.label for r in tuned], float)
    if len(y) and 0 < y.mean() < 1:
        tuned = sorted(tuned, key=lambda r: (r.label, r.comparison))
        model.weights = _logistic(np.array([[r.comparison] for r in tuned]), np.array([r.label for r in tuned], float))
    return model


def _compared(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[n] for n in ("doc_id", *keep)] + [T.StructField("comparison", T.DoubleType())])

    def make():
        ratios = Ratios(sent.value)

        def step(part: pa.RecordBatch) -> list:
            texts = [parts_of(t) for t in raw(part.column("text"))]
            ratios.meet(texts)
            return [part.column("doc_id"), *(part.column(k) for k in keep), [ratios.comparison(words) for words in texts]]

        return step

    return map_slices(docs, make, schema)


def score(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, keep: tuple[str, ...] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the columns in keep, score (0 to 1), predicted (score >= threshold) for each row.

    score is a logistic function of the comparison of the text's log-likelihoods under the toxic and the ordinary model, normalised by the root of its
    length. Null, empty and wordless texts compare as equal, hence the score of no evidence; a score of exactly the threshold is predicted. Repeated rows give a row each; a null id
    stays null; without labels of both kinds the weights are fixed ones; an empty table gives no rows.
    """
    scale, constant = model.weights.tolist()
    found = _compared(spread(documents(df, *keep, text=text, key=key)), model, keep)
    found = found.withColumn("score", 1 / (1 + F.exp(-(F.col("comparison") * scale + constant))))
    return found.select("doc_id", *keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
