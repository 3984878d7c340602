from __future__ import annotations

import math

import numpy as np
import pytest

from lorekeep.llm import whitening
from lorekeep.llm.queries import whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def brute(vectors):
    """Kept places, whole vectors, fit list and covariance by plain definitions."""
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors[i]] for i in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in fit])
    return kept, x, n, sums, centred.T @ centred / n


def random_vectors(rng, rows, d):
    return (rng.normal(size=(rows, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)).astype(np.float32).tolist()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = random_vectors(rng, 400, 20)
    vectors += [vectors[0]] * 150 + [None, [math.nan] + [0.0] * 19, [math.inf] * 20, [None] + [1.0] * 19]
    kept, x, n, sums, v = brute(vectors)
    df = table(spark, vectors).repartition(7)
    got = whitened_components(df).collect()
    assert whitened_components(df).dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n}
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    mean = np.array(sums) / n
    y = (np.array([x[kept.index(i)] for i in kept]) - mean) @ vectors_[:, :16] / np.sqrt(values[:16])
    mine = np.array([[by[i, c].whitened for c in range(1, 17)] for i in kept])
    sign = np.sign((y * mine).sum(axis=0))
    assert np.abs(mine - y * sign).max() < 1e-6
    for i, own in zip(kept, x, strict=True):
        assert by[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
    assert np.allclose([by[0, c].explained for c in range(1, 17)], values[:16] / values.sum(), rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_rank_ties_dimensions_and_odd_rows(spark):
    flat = [[float(i % 5), float(i % 5), 1.0] for i in range(50)]  # one direction
    got = whitened_components(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and {r.n for r in got} == {5} and abs(got[0].explained - 1) < 1e-12
    assert whitened_components(table(spark, [[1.0, 2.0]] * 9)).collect() == []
    assert whitened_components(table(spark, [[]] * 3 + [None])).collect() == []
    assert whitened_components(table(spark, flat).limit(0)).collect() == []
    mixed = table(spark, [[0.0, 1.0], [1.0, 0.0], [3.0, 3.0], [0.0], [1.0]], ids=[None, 7, 7, 8, 9])
    mixed = mixed.selectExpr("vec_id", "embedding", "label", "1 AS n", "2 AS component", "3 AS whitened", "4 AS _x")
    n = sorted(((r.vec_id or 0), r.component, r.n) for r in whitened_components(mixed).collect())
    assert n == [(0, 1, 3), (0, 2, 3), (7, 1, 3), (7, 1, 3), (7, 2, 3), (7, 2, 3), (8, 1, 2), (9, 1, 2)]


def test_exact_beyond_64_bits(spark):
    vectors = [[float(2**50), -float(2**50)], [float(2**40), 0.0], [0.5, 0.25], [float(2**60), 0.0]]  # the last is too large
    kept, x, n, sums, _ = brute(vectors[:3])
    got = {r.vec_id: r for r in whitening.whiten(table(spark, vectors)).collect()}
    assert set(got) == {0, 1, 2} and got[0].n == n
    for i in kept:
        want = sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert (got[i].deviation, got[i].deviation_text) == ((want, None) if want < 2**63 else (None, str(want)))


@pytest.mark.parametrize("d", [1, 64])
def test_identity_over_whole_table(spark, d):
    rng = np.random.default_rng(4)
    got = whitening.whiten(table(spark, random_vectors(rng, 300, d))).toPandas()
    y = np.unique(np.array(got["whitened"].tolist()), axis=0)  # distinct vectors
    assert y.shape == (got["n"][0], min(d, 16)) and np.abs(np.atleast_2d(np.cov(y.T, bias=True)) - np.eye(min(d, 16))).max() < 1e-9
    assert got["identity_error"].max() < 1e-9
