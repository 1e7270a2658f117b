"""Whitening against plain whole-number arithmetic and numpy's double-precision solver."""

import math
import random

import numpy as np
import pytest

from almanac.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, `a.b` int"


def naive(rows):
    """(n, x rows by position, covariance, deviations) from the definition."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(dims)) for r in x]
    d = np.array([[(n * r[j] - s[j]) / n for j in range(dims)] for r in x])
    return kept, d, d.T @ d / n, deviation


def some_rows(seed, count, dims=7):
    rnd = random.Random(seed)
    rows = [(k, [rnd.gauss(0.1 * j, 0.3 + 0.2 * j) for j in range(dims)]) for k in range(count)]
    return [*rows, rows[3], (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * (dims - 1) + [None]), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1))]


def test_matches_the_definition(spark):
    rows = some_rows(3, 60)
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    kept, d, v, deviation = naive(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = d @ vectors / np.sqrt(values)
    assert len(got) == len(kept) * 7 and {r["n"] for r in got} == {len(kept)}
    for j in range(7):
        own = [r for r in got if r["component"] == j + 1]
        assert {r["explained"] for r in own} == {own[0]["explained"]}
        assert own[0]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-10)
        want = sorted((i if i is not None else -1, dev, w) for (i, _), dev, w in zip(kept, deviation, white[:, j], strict=True))
        have = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in own)
        assert [w[:2] for w in want] == [h[:2] for h in have]
        a, b = np.array([w[2] for w in want]), np.array([h[2] for h in have])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert 0 <= got[0]["identity_error"] < 1e-10 and len({r["identity_error"] for r in got}) == 1


def test_top_and_components_without_variance(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.random() * 3, 0.5, 0.25 * k, 0.25 * k]) for k in range(30)]  # one constant, one repeated dimension
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert {r["component"] for r in whitening.whiten(df, top=1).collect()} == {1}
    assert got[0]["identity_error"] < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_other_lengths_and_far_entries(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.random(), rnd.random()]) for k in range(20)] + [(50, [1.0]), (51, [1e300, -1e18]), (52, [3e5, 70.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == {*range(20), 51, 52}
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 51) and all(math.isfinite(r["whitened"]) for r in got)
    rows = rows[:21] + rows[22:]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    kept, d, v, deviation = naive([(i, x) for i, x in rows if len(x) == 2 and i != 51])
    x = {i: [math.floor(64 * c) for c in w] for i, w in kept}
    s = [sum(r[j] for r in x.values()) for j in range(2)]
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: sum((len(x) * c - s[j]) ** 2 for j, c in enumerate(r)) for i, r in x.items()}
    assert got[0]["identity_error"] < 1e-4


def exact_spectrum(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal to extended precision
        q = q @ (3 * np.eye(len(values), dtype=q.dtype) - q.T @ q) / 2
    return q, q @ np.diag(np.array(values, np.longdouble)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [9, 7, 5, 3, 1, 0.5],
        [2, 1 + 3e-8, 1 + 2e-8, 1 + 1e-8, 1, 0.1],  # closer than float32 can tell
        [5, 1 + 1e-12, 1, 0.5, 0.5 - 1e-11, 1e-6],
        [4, 4, 4, 1, 1, 0],  # equal ones: any basis
        [1e-9, 1e-10, 1e-11, 1e-12, 1e-13, 1e-14],
    ],
)
def test_refined_vectors(values, seed=1):
    q, a = exact_spectrum(values, seed)
    found, x = whitening.eigenvectors(a)
    assert np.abs(found - np.array(values, np.longdouble)).max() <= 1e-17 * max(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-17 * max(values)
    for j, own in enumerate(values):
        gap = min([abs(own - v) for v in values if v != own] or [1])
        if values.count(own) == 1:
            turned = abs(float(np.abs(q[:, j] @ x[:, j]) - 1))
            assert turned < 1e-17 + (2e-18 * max(values) / gap) ** 2
            assert min(np.abs(q[:, j] - x[:, j]).max(), np.abs(q[:, j] + x[:, j]).max()) < 1e-17 + 1e-17 * max(values) / gap
