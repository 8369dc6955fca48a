"""Whitening against numpy in whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pergola.llm import whitening


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 2, d)) @ rng.normal(size=(d, d)) / d + rng.normal(size=d)).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "?", 1) for i, v in rows], "vec_id long, embedding array<float>, whitened string, n long").repartition(3)


def exact(rows):
    """The contract by Fractions: x, sums, covariance."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * c - s for c, s in zip(row, sums)] for row in x]
    d = len(sums)
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    return n, off, v


def test_whitening_equals_exact_numbers(spark):
    held = vectors(300, 12)
    rows = list(enumerate(held)) + [(7, held[7]), (None, held[8])]
    bad = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    found = whitening.whiten(frame(spark, rows + bad), components=7).orderBy("vec_id", "component").collect()
    n, off, v = exact(rows)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:7], u[:, ::-1][:, :7]
    want = {}
    for (i, _), o in zip(rows, off):
        want.setdefault(i, []).append((sum(c * c for c in o), np.array([c / n for c in o]) @ u / np.sqrt(e)))
    assert len(found) == 7 * len(rows) and {r.n for r in found} == {n}
    signs = [np.sign(want[0][0][1][k] * next(r.whitened for r in found if r.vec_id == 0 and r.component == k + 1)) for k in range(7)]
    for r in found:
        deviation, white = want[r.vec_id][0]
        assert r.deviation == deviation
        assert r.whitened * signs[r.component - 1] == pytest.approx(white[r.component - 1], rel=1e-8, abs=1e-8)
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        assert r.identity_error < 1e-9


def test_covariance_does_not_depend_on_partitions(spark):
    rows = list(enumerate(vectors(400, 9, 3)))
    one, other = (whitening.fit(frame(spark, rows).repartition(p)).covariance for p in (1, 7))
    assert (one == other).all() and (one == exact(rows)[2]).all()


def test_awkward_tables(spark):
    empty = whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])]))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert whitening.whiten(frame(spark, [(1, None)]).limit(0)).schema == empty.schema
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whitening.whiten(frame(spark, [(i, [i / 4, 2.0, i / 2]) for i in range(20)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert flat[0].identity_error < 1e-9


def test_large_entries_are_summed_as_doubles(spark):
    rows = [(i, v) for i, v in enumerate(vectors(200, 4, 1) * np.float32(1e9))]
    found = whitening.whiten(frame(spark, rows)).collect()
    _, off, _ = exact(rows)
    want = {i: sum(c * c for c in o) for (i, _), o in zip(rows, off)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in found)
    assert found[0].identity_error < 1e-9


def test_whole_table(spark, smallest):
    found = whitening.whiten(spark.read.parquet(f"{smallest}/embeddings.parquet"))
    row = found.agg(F.count("*").alias("n"), F.max("identity_error").alias("e"), F.countDistinct("component").alias("c")).first()
    assert row.n == 500 * 32 and row.c == 32 and row.e < 1e-9
