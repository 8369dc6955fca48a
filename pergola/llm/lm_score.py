"""Language-model scores of whole texts: a log-bilinear model trained by noise-contrastive estimation, normalised exactly."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import arrow_schema, documents, dropped, map_slices, most_frequent, raw, saved, slices, spread, vector_sum, written

#: The most frequent words, each an outcome of the neural model of its own. All other words are outcomes by their last ENDING bytes: the
#: ENDINGS most frequent endings, and one outcome for the rest; a word divides its ending's outcome by the base probabilities.
VOCABULARY = 2047
ENDING = 3
ENDINGS = 1023
DIMENSIONS = 24
#: Words whose counts every task holds; the others' counts are joined.
HOT_WORDS = 200_000
#: Training tokens of a shard, about; the number of shards follows from the table alone, and so does what each holds.
SHARD_TOKENS = 2_000_000
#: Rounds of training: the shards of a round set out from the averages of the one before.
ROUNDS = 4
RATE = 0.7
BATCH = 2048
NOISE = 48
#: Distinct words a task counts before it hands them on.
COUNTED_WORDS = 400_000
#: Stands for a text's end; no word is white space.
END = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def token_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts, counted in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for part in slices(batch):
                for text in raw(part.column("text")):
                    seen.update(tokens(text))
                if len(seen) > COUNTED_WORDS:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Parameters:
    """score(w | v, u) = (R[v] C1 + R[u] C2) . Q[w] + b[w] for a word w after u, v."""

    R: np.ndarray
    C1: np.ndarray
    C2: np.ndarray
    Q: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(outcomes: np.ndarray, dimensions: int = DIMENSIONS) -> Parameters:
        """outcomes: the share of each. The biases start as its logarithm, the rest small and alike everywhere."""
        rng = np.random.default_rng(7)
        n = len(outcomes)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Parameters(small(n + 1, dimensions), np.eye(dimensions, dtype=np.float32), np.eye(dimensions, dtype=np.float32), small(n, dimensions), np.log(outcomes).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.R, self.C1, self.C2, self.Q, self.b)])

    def like(self, values: np.ndarray) -> Parameters:
        out, at = [], 0
        for a in (self.R, self.C1, self.C2, self.Q, self.b):
            out.append(values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Parameters(*out)


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at.astype(np.uint16) if len(total) <= 1 << 16 else at, kind="stable")
    ids = at[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    total[ids[first]] += np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) by a hyperbolic tangent: no overflow, and far less time than a division each."""
    y = np.tanh(x * np.float32(0.5))
    y += 1
    y *= np.float32(0.5)
    return y


class Trainer:
    """Noise-contrastive steps with Adagrad: a batch shares its noise words, so scores and gradients are matrix products."""

    def __init__(self, start: Parameters, squares: Parameters, noise: np.ndarray, rate: float, seed: int):
        self.p = start.like(start.flat())
        self.noise = np.log(noise * NOISE).astype(np.float32)
        self.cumulative = np.cumsum(noise / noise.sum())
        self.rate = rate
        self.squares = squares.like(squares.flat())
        self.rng = np.random.default_rng(seed)

    def _update(self, name: str, gradient: np.ndarray) -> None:
        squares, value = getattr(self.squares, name), getattr(self.p, name)
        squares += gradient * gradient
        value += self.rate * gradient / np.sqrt(squares)

    def step(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        n = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.cumulative) - 1)
        rv, ru = p.R[v], p.R[u]
        h = rv @ p.C1 + ru @ p.C2
        qw, qn = p.Q[w], p.Q[n]
        data = _sigmoid(self.noise[w] - (h * qw).sum(axis=1) - p.b[w])
        fake = -_sigmoid(h @ qn.T + (p.b[n] - self.noise[n]))
        scale = np.float32(1 / len(w))
        gh = (data[:, None] * qw + fake @ qn) * scale
        gq, gr = np.zeros((len(p.b), h.shape[1] + 1), np.float32), np.zeros_like(p.R)
        outcomes = np.empty((len(w) + len(n), h.shape[1] + 1), np.float32)
        np.multiply(data[:, None], h, out=outcomes[: len(w), :-1])
        np.matmul(fake.T, h, out=outcomes[len(w) :, :-1])
        outcomes[: len(w), -1], outcomes[len(w) :, -1] = data, fake.sum(axis=0)
        outcomes *= scale
        _add_rows(gq, np.concatenate([w, n]), outcomes)
        _add_rows(gr, np.concatenate([v, u]), np.concatenate([gh @ p.C1.T, gh @ p.C2.T]))
        self._update("C1", rv.T @ gh)
        self._update("C2", ru.T @ gh)
        self._update("Q", gq[:, :-1])
        self._update("b", gq[:, -1])
        self._update("R", gr)


def contexts(ids: np.ndarray, start: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one before it and the one before that; `start` stands before the first of each text. starts: where texts begin."""
    starts = np.zeros(1, np.int64) if starts is None else starts
    v = np.empty_like(ids)
    u = np.empty_like(ids)
    v[1:], u[2:] = ids[:-1], ids[:-2]
    v[starts] = u[starts] = start
    second = starts + 1
    u[second[second < len(ids)]] = start
    return v, u


@dataclass
class Lexicon:
    """Hot words by falling count with their counts. The outcomes of the neural model: the first `size` hot words or fewer, then a class for each
    of `endings` and one for words with any other, which the words share by their base probabilities; last the word never seen."""

    places: dict[bytes, int]
    counts: np.ndarray
    size: int
    endings: dict[bytes, int]
    masses: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.own = np.array([*(self.ending(w) if i >= self.size else i for w, i in self.places.items()), 0], np.int64)

    @property
    def floor(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    @property
    def unknown(self) -> int:
        return self.size + len(self.masses)

    @property
    def start(self) -> int:
        """The context before a text."""
        return self.unknown + 1

    def ending(self, word: bytes) -> int:
        """The outcome of a word that isn't one of its own."""
        return self.size + self.endings.get(word[-ENDING:], len(self.masses) - 1)

    def outcome_shares(self) -> np.ndarray:
        """Base probabilities of the outcomes; a class without words has next to none."""
        own = (self.counts[: self.size] + 0.1) / self.floor
        return np.concatenate([own, np.maximum(self.masses, 1e-15), [0.1 / self.floor]])

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of words; one past the last for those that are not hot."""
        get, none = self.places.get, len(self.places)
        return np.fromiter((get(w, none) for w in words), np.int64, len(words))

    def outcomes(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        """The words' outcomes, taking all of them as seen."""
        out = self.own[places]
        for i in np.flatnonzero(places == len(self.places)).tolist():
            out[i] = self.ending(words[i])
        return out


def lexicon_of(counts: DataFrame, vocabulary: int = VOCABULARY, hot_words: int = HOT_WORDS) -> Lexicon:
    """The hot words of a word, n table, and the shares of word endings over all its words that have no outcome of their own."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot = most_frequent(counts, hot_words).toArrow()
    order = sorted(zip(hot.column("word").to_pylist(), hot.column("n").to_pylist()), key=lambda r: (r[0] != END, -r[1], r[0]))
    size = min(vocabulary, len(order))
    floor = total.n + 0.1 * (total.v + 1)
    ending = F.expr(f"IF(length(word) > {ENDING}, substring(word, -{ENDING}), word)").alias("ending")
    kinds = counts.groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    own: dict[bytes, list[float]] = {}
    for w, n in order[:size]:
        at = own.setdefault(w[-ENDING:], [0, 0])
        at[0], at[1] = at[0] + n, at[1] + 1
    best = kinds.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()
    left = [(bytes(r.ending), r.n - own.get(bytes(r.ending), (0, 0))[0], r.v - own.get(bytes(r.ending), (0, 0))[1]) for r in best]
    known = [x for x in left if x[2] > 0]
    masses = [(n + 0.1 * v) / floor for _, n, v in known]
    rest_n = total.n - sum(n for _, n in order[:size]) - sum(x[1] for x in known)
    rest_v = total.v - size - sum(x[2] for x in known)
    masses.append((rest_n + 0.1 * rest_v) / floor)
    return Lexicon({w: i for i, (w, _) in enumerate(order)}, np.array([n for _, n in order], float), size, {x[0]: k for k, x in enumerate(known)}, np.array(masses), total.n, total.v)


def learn(start: Parameters, squares: Parameters, noise: np.ndarray, texts: list[np.ndarray], first: int, seed: int, rate: float = RATE, batch: int = BATCH) -> np.ndarray:
    """Parameters and squares after one pass over every token of the texts, as a vector times the number of tokens, and that number."""
    trainer = Trainer(start, squares, noise, rate, seed)
    pairs = [contexts(t, first) for t in texts]
    w, v, u = np.concatenate(texts), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = trainer.rng.permutation(len(w))
    for k in range(0, len(w), batch):
        at = order[k : k + batch]
        trainer.step(v[at], u[at], w[at])
    return np.append(np.concatenate([trainer.p.flat(), trainer.squares.flat()]).astype(np.float64) * len(w), len(w))


def _shards(docs: DataFrame, lexicon_sent) -> DataFrame:
    """h (hash of a row's id and text), ids: the outcomes of the words of every text."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("ids", T.BinaryType())])

    def make():
        own = lexicon_sent.value

        def step(part: pa.RecordBatch) -> list:
            each = [tokens(t) for t in raw(part.column("text"))]
            words = list(chain.from_iterable(each))
            ids = own.outcomes(words, own.find(words)).astype("<u2").tobytes()
            ends = (2 * np.cumsum([len(w) for w in each])).tolist()
            return [part.column("h"), [ids[a:b] for a, b in zip([0, *ends], ends)]]

        return step

    return map_slices(docs.select(F.xxhash64("doc_id", "text").alias("h"), "text"), make, schema)


@dataclass
class LanguageModel:
    counts: DataFrame
    lexicon: Lexicon
    parameters: Parameters


def train(docs: DataFrame, vocabulary: int = VOCABULARY, hot_words: int = HOT_WORDS, shard_tokens: int = SHARD_TOKENS) -> LanguageModel:
    """Learns from every token of all rows of a doc_id, text frame; the model is the same however the rows are dealt to tasks.

    Counts, N and V are taken over every token. For the neural model a hash of id and text deals the rows into shards, as many as the number of
    tokens asks for. Rounds take a part of the shards each: a shard's rows are put in the order of that hash and learnt from in one pass, and what
    the shards of a round have reached is averaged by their tokens, added up in a fixed order, before the next round sets out from it.
    """
    spark = docs.sparkSession
    docs = spread(docs)
    counts = written(token_counts(docs))
    lexicon = lexicon_of(counts, vocabulary, hot_words)
    shares = lexicon.outcome_shares()
    noise = shares**0.75 / (shares**0.75).sum()
    now = Parameters.start(shares)
    squares = now.like(np.full(now.flat().size, 0.05))
    each = max(1, -(-lexicon.total // (ROUNDS * shard_tokens)))
    rows = _shards(docs, spark.sparkContext.broadcast(lexicon)).withColumn("shard", F.pmod("h", F.lit(each * ROUNDS))).withColumn("round", F.pmod("shard", F.lit(ROUNDS)).cast("int"))
    where = saved(rows, "round")
    table = spark.read.schema(rows.schema).parquet(where)
    first, rate, batch = lexicon.start, RATE, BATCH
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast((now, squares))

        def one(number: int, own: pa.Table) -> np.ndarray:
            own = own.sort_by([("h", "ascending"), ("ids", "ascending")])
            return learn(*sent.value, noise, [np.frombuffer(b, "<u2").astype(np.int64) for b in own.column("ids").to_pylist()], first, number, rate, batch)

        values = vector_sum(table.where(F.col("round") == k).select("shard", "h", "ids").repartition(each, "shard"), "shard", one)
        if values is not None:
            half = (len(values) - 1) // 2
            now, squares = now.like(values[:half] / values[-1]), now.like(values[half:-1] / values[-1])
    dropped(spark, where)
    return LanguageModel(counts, lexicon, now)


class Tables:
    """log p(w | v, u) for all words and contexts: two score tables and the logarithm of the normaliser of every pair of context words.

    The score is a sum of a part for v and a part for u, so the normalisers of all pairs are one product of two matrices of exponentials.
    """

    def __init__(self, p: Parameters):
        self.one = p.R @ p.C1 @ p.Q.T + p.b
        self.two = p.R @ p.C2 @ p.Q.T
        m1, m2 = self.one.max(axis=1, keepdims=True), self.two.max(axis=1, keepdims=True)
        z = np.exp(self.one - m1) @ np.exp(self.two - m2).T
        self.normaliser = np.log(np.maximum(z, 1e-37)) + m1 + m2.T

    def log10(self, ids: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        return (self.one[v, ids] + self.two[u, ids] - self.normaliser[v, u]).astype(np.float64) / np.log(10)


_held: dict[str, object] = {}


def _scorer(sent, name: str):
    """One set of tables a process."""
    if name not in _held:
        _held.clear()
        lexicon, parameters = sent.value
        base = np.append(np.log10((lexicon.counts + 0.1) / lexicon.floor), 0.0)
        shares = np.log10(lexicon.outcome_shares())
        _held[name] = lexicon, Tables(parameters), base, base - np.append(shares[lexicon.own[:-1]], 0.0), shares
    return _held[name]


COLD = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("times", T.IntegerType()), T.StructField("seen", T.DoubleType()), T.StructField("unseen", T.DoubleType())]))


def score(df: DataFrame, model: LanguageModel, keep: tuple[str, ...] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the columns in keep, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text) for each row.

    A word of the neural vocabulary has the model's normalised probability; any other word seen in training has that of its ending's outcome
    times its part of the base probability of all such words; a word never seen is the outcome of its own that all such words share.
    Counts of words that are not hot are joined by word, for the rows that have any. Null texts count as empty: their end alone is scored.
    Repeated rows give a row each; without training text all words are unknown. Scores don't depend on how rows are dealt to tasks.
    """
    docs = spread(documents(df, *keep, text=text, key=key))
    name = uuid.uuid4().hex
    lexicon = model.lexicon
    sent = df.sparkSession.sparkContext.broadcast((lexicon, model.parameters))
    own = [docs.schema[n] for n in ("doc_id", *keep)]
    fields = (("n_tokens", T.LongType()), ("hot_known", T.LongType()), ("hot_base", T.DoubleType()), ("hot_score", T.DoubleType()), ("cold", COLD))
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t in fields)])

    def make():
        lexicon, tables, base, rest, shares = _scorer(sent, name)
        none = len(lexicon.places)
        kind = arrow_schema(schema).field("cold").type

        def step(part: pa.RecordBatch) -> list:
            """All texts of a slice at once."""
            each = [tokens(t) for t in raw(part.column("text"))]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            starts = np.cumsum(sizes) - sizes
            words = list(chain.from_iterable(each))
            at = lexicon.find(words)
            ids = lexicon.outcomes(words, at)
            v, u = contexts(ids, lexicon.start, starts)
            logs = tables.log10(ids, v, u)
            strange = np.flatnonzero(at == none)
            seen = logs[strange] - shares[ids[strange]]
            unseen = tables.log10(np.full(len(strange), lexicon.unknown), v[strange], u[strange])
            owners = np.searchsorted(starts, strange, side="right") - 1
            index: dict[tuple[int, bytes], int] = {}
            which = np.fromiter((index.setdefault((k, words[i]), len(index)) for i, k in zip(strange.tolist(), owners.tolist())), np.int64, len(strange))
            n = len(index)
            times = np.bincount(which, minlength=n).astype(np.int32)
            cold = pa.StructArray.from_arrays([pa.array([w for _, w in index], pa.binary()), times, np.bincount(which, seen, n), np.bincount(which, unseen, n)], fields=list(kind.value_type))
            cuts = np.searchsorted(np.fromiter((k for k, _ in index), np.int64, n), np.arange(len(each) + 1))
            logs[strange] = 0
            total = lambda values: np.add.reduceat(values, starts)
            known = sizes - np.bincount(owners, minlength=len(each))
            return [part.column("doc_id"), *(part.column(k) for k in keep), sizes.tolist(), known.tolist(), total(base[at]).tolist(), total(logs + rest[at]).tolist(), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), cold, type=kind)]

        return step

    rows = written(map_slices(docs, make, schema).withColumn("row", F.monotonically_increasing_id()))
    cold = rows.select("row", F.explode("cold").alias("c")).select("row", "c.*")
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(lexicon.floor))
    sums = cold.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * base).alias("cold_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("seen") + F.col("times") * base).otherwise(F.col("unseen"))).alias("cold_score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("cold_known"),
    )
    some = rows.where(F.size("cold") > 0).drop("cold").join(sums, "row")
    others = rows.where(F.size("cold") == 0).drop("cold").select("*", F.lit(0.0).alias("cold_base"), F.lit(0.0).alias("cold_score"), F.lit(0).cast("long").alias("cold_known"))
    return some.unionByName(others).select(
        "doc_id",
        *keep,
        "n_tokens",
        (F.col("hot_known") + F.col("cold_known")).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.col("cold_base")).alias("base_score"),
        (F.col("hot_score") + F.col("cold_score")).alias("score"),
    )
