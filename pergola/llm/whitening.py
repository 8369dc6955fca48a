"""Whitening of embeddings: covariances as sums of centred products of all pairs of dimensions in one aggregation, eigenvectors by LAPACK."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.llm._arrow import arrow_schema, release, spread, written

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Pairs of dimensions in a group of the covariance's sums.
WIDTH = 16
#: An eigenvalue of so small a share of the largest, for each dimension, is rounding and no variance.
LEAST_SHARE = 1e-14
#: Rows that a step projects at once.
STEP_ROWS = 4096


@dataclass
class Whitening:
    """n, sums: of the vectors the fit is over; vectors: a unit eigenvector a column, by falling value; explained: shares of all variance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scales: np.ndarray


def usable(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, embedding of the rows whose vector is not null, not empty and holds no null and no entry that is not finite."""
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def dimensions(rows: DataFrame) -> int:
    """The length that most vectors have, the greater of two as frequent; 0 without rows."""
    found = rows.groupBy(F.size("embedding").alias("d")).count().collect()
    return max(found, key=lambda r: (r["count"], r.d)).d if found else 0


def _numbers(rows: DataFrame, d: int) -> DataFrame:
    """v: the entries as whole numbers."""
    return rows.select(F.array(*(F.floor(F.get("embedding", F.lit(i)).cast("double") * SCALE) + SHIFT for i in range(d))).alias("v"))


def moments(vectors: DataFrame, d: int) -> dict[str, list]:
    """n, sum, least and most of each dimension of v. Sums of a dimension are added up by a task of their own."""
    each = vectors.select(F.posexplode("v").alias("i", "x"))
    found = {r.i: r for r in each.groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most")).collect()}
    return {k: [found[i][k] for i in range(d)] for k in ("n", "total", "least", "most")}


def products(vectors: DataFrame, d: int, centres: list) -> np.ndarray:
    """The upper triangle of sums of centred products of v, mirrored, in one aggregation whose columns are expressions generated for WIDTH pairs each.

    Row i of the triangle is cut into parts of WIDTH columns, each a group: column k of part b sums v[i] * v[i + b + k]. So few expressions are
    compiled as one, where one for each pair would be too large to be; doubles are exact as long as whole numbers stay below 2 ** 53.
    """
    centred = vectors.select(F.array(*((F.get("v", F.lit(i)) - F.lit(m)).cast("double") for i, m in enumerate(centres))).alias("v"))
    each = centred.select("v", F.posexplode("v").alias("i", "x")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(d - 1) - F.col("i"), F.lit(WIDTH))))
    sums = each.groupBy("i", "b").agg(*(F.sum(F.expr(f"x * get(v, i + b + {k})")).alias(f"p{k}") for k in range(WIDTH)))
    out = np.zeros((d, d))
    for row in sums.collect():
        for k in range(min(WIDTH, d - row.i - row.b)):
            j = row.i + row.b + k
            out[row.i, j] = out[j, row.i] = row[f"p{k}"]
    return out


def fit(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> Whitening | None:
    """Learns from every usable vector of the usual length; None if there is none.

    The first aggregation sums each dimension; the second sums the products of all pairs, each dimension centred on its mean's nearest whole
    number; what is left of the means, less than one half, is taken out of the sums exactly, so the covariance is that of vectors centred on
    their mean, rounded once, however rows were dealt. Where doubles might not hold the sums as whole numbers, dimensions are centred on the mean itself.
    """
    rows = usable(df, vector, key)
    d = dimensions(rows)
    if not d:
        return None
    numbers = _numbers(rows.where(F.size("embedding") == d), d)
    first = moments(numbers, d)
    n, sums = first["n"][0], first["total"]
    centres = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(abs(a - m), abs(b - m)) for a, b, m in zip(first["least"], first["most"], centres))
    covariance = np.zeros((d, d))
    if n * reach * reach < 1 << 53:
        rest = [s - n * m for s, m in zip(sums, centres)]
        whole = products(numbers, d, centres)
        for i in range(d):
            for j in range(d):
                covariance[i, j] = (n * int(whole[i, j]) - rest[i] * rest[j]) / (n * n)
    else:
        covariance = products(numbers, d, [s / n for s in sums]) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    varied = values > LEAST_SHARE * d * max(values[0], 0)
    scales = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1)), np.nan)
    trace = np.trace(covariance)
    return Whitening(n, sums, covariance, values, vectors, values / trace if trace > 0 else np.zeros(len(values)), scales)


def projected(df: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, deviation, whitened (array of doubles) of each usable vector of the fit's length.

    deviation: the sum over dimensions of (n * x - S) ** 2, exact; null where a long can't hold it. A component without variance is null.
    """
    d = len(model.sums)
    rows = spread(usable(df, vector, key)).where(F.size("embedding") == d)
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    plain = arrow_schema(schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        sums, basis = np.array(own.sums, np.int64), own.vectors * np.nan_to_num(own.scales)
        width = basis.shape[1]
        missing = np.isnan(own.scales)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(k, STEP_ROWS)
                entries = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                off = (np.floor(entries * SCALE).astype(np.int64) + SHIFT) * own.n - sums
                most = np.abs(off).max(axis=1).astype(float)
                fits = most * most * d < 2.0**62
                deviation = (np.where(fits[:, None], off, 0) ** 2).sum(axis=1)
                exact = deviation.tolist()
                for at in np.flatnonzero(~fits):
                    value = sum(int(v) ** 2 for v in off[at])
                    exact[at] = value if value < 1 << 63 else None
                white = (off / own.n) @ basis
                flat = pa.array(white.ravel(), pa.float64(), mask=np.tile(missing, len(white)) if missing.any() else None)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(exact, pa.int64()), lists.cast(plain.field("whitened").type)], schema=plain)
        release()

    return rows.mapInArrow(run, schema)


def identity_error(white: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of whitened vectors less the identity, over components that have variance; 0 without any."""
    some = np.flatnonzero(~np.isnan(model.scales)).tolist()
    if not some:
        return 0.0
    own = white.select(F.array(*(F.get("whitened", F.lit(i)) for i in some)).alias("v"))
    means = [total / model.n for total in moments(own, len(some))["total"]]
    found = products(own, len(some), means) / model.n
    return float(np.abs(found - np.eye(len(some))).max())


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Fit and projection are over all rows. Vectors that are null or empty, hold a null or an entry that is not finite, or have not the usual
    length (that of most; of two as frequent the greater) are left out of both. Repeated rows count each; a null id stays null; components of equal variance
    may come in any order and turned within their space; a component without variance has a null whitened value and stays out of
    identity_error; a table without usable vectors gives no rows. Other columns are not read. The whitened vectors are written once and read for the
    check of their covariance and for the result.
    """
    model = fit(df, components, vector, key)
    session = df.sparkSession
    if model is None:
        kind = df.schema[key].dataType.simpleString()
        return session.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = written(projected(df, model, vector, key))
    error = identity_error(white, model)
    explained = F.array(*(F.lit(float(v)) for v in model.explained))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
