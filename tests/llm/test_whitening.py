"""Whitening against exact sums and numpy's eigenvectors."""

import math
import random

import numpy as np
import pytest

from tidewater.llm import whitening


def table(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], f"vec_id int, embedding array<{kind}>, _x string").repartition(3)


def kept_of(vectors):
    return {i: [math.floor(1024 * float(c)) + 100_000 for c in v] for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}


def check(spark, vectors, components=8, least_gap=1e-6, kind="float"):
    x = kept_of(vectors)
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(d)]
    centred = {i: [n * a - s for a, s in zip(v, sums, strict=True)] for i, v in x.items()}
    z = np.array(list(centred.values()), np.float64) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(table(spark, vectors, kind), components).collect()
    assert len(got) == n * min(d, components)
    white = {(r.vec_id, r.component): r.whitened for r in got}
    for r in got:
        assert r.n == n and r.deviation == sum(a * a for a in centred[r.vec_id]) and 0 <= r.identity_error < 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-15)
    for c in range(min(d, components)):
        gap = min(abs(values[c] - v) for j, v in enumerate([*values, math.inf]) if j != c) / values[0]
        if values[c] > 1e-9 * values[0] and gap > least_gap:
            mine = np.array([white[i, c + 1] for i in x])
            plain = z @ axes[:, c] / math.sqrt(values[c])
            assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-6
    return got


@pytest.mark.parametrize("seed,n,d", [(1, 200, 5), (2, 60, 20), (3, 500, 12), (4, 30, 1)])
def test_components_are_those_of_numpy(spark, seed, n, d):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.2 + 3).astype(np.float32).tolist()
    vectors[1][0], vectors[2][0], vectors[3][0] = None, math.nan, math.inf
    check(spark, [*vectors, None, vectors[5], vectors[5]])


def test_offsets_do_not_cost_digits(spark):
    rng = np.random.default_rng(5)
    check(spark, (1e7 + rng.standard_normal((100, 4))).tolist(), kind="double")


def test_other_lengths_and_numbers_too_large_are_left_out(spark):
    rng = np.random.default_rng(6)
    good = rng.standard_normal((40, 3)).tolist()
    odd = [[1.0], [], [1.0, 2.0, 3.0, 4.0], [1e300, 1.0, 1.0], [-1e19, 0.0, 0.0]]
    got = whitening.whiten(table(spark, good + odd, "double")).collect()
    assert {r.vec_id for r in got} == set(range(40)) and {r.n for r in got} == {40} and {r.component for r in got} == {1, 2, 3}


def test_large_entries_are_summed_exactly(spark):
    rng = random.Random(7)
    check(spark, [[rng.uniform(-1, 1) * 2.0 ** rng.choice([5, 20, 36]) for _ in range(3)] for _ in range(50)], kind="double")


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 5, [[1.0, 2.0, 3.0]], [[0.0]]])
def test_without_variance_nothing_is_whitened(spark, vectors):
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == len(vectors) * len(vectors[0])
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_dependent_dimensions(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((50, 2)) * 10
    got = whitening.whiten(table(spark, (np.round(np.column_stack([a, a]) * 1024) / 1024).tolist(), "double")).collect()
    assert {r.component for r in got if r.whitened is not None} == {1, 2} and {r.component for r in got} == {1, 2, 3, 4}
    assert all(r.identity_error < 1e-9 for r in got)


def test_empty_tables(spark):
    assert whitening.whiten(table(spark, [[1.0]]).limit(0)).count() == 0
    got = whitening.whiten(table(spark, [None, [None, 1.0]]))
    assert got.count() == 0 and "identity_error" in got.columns


@pytest.mark.parametrize("seed", range(6))
def test_inertia_and_solutions(seed):
    rng = np.random.default_rng(seed)
    for d in (1, 2, 3, 8, 25):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        values = rng.standard_normal(d) * 10.0 ** rng.integers(-3, 3, d)
        m = q * values @ q.T
        m = (m + m.T) / 2
        for shift in [0.0, *rng.standard_normal(4)]:
            f = whitening.Factors(m - shift * np.eye(d))
            assert f.positive() == int((np.linalg.eigvalsh(m) > shift).sum())
            b = rng.standard_normal(d)
            assert np.allclose((m - shift * np.eye(d)) @ f.solve(b), b, atol=1e-6 * np.abs(f.solve(b)).max())
    hollow = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert whitening.Factors(hollow).positive() == 1 and np.allclose(whitening.Factors(hollow).solve([1, 2]), [2, 1])


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0.5], [1, 1 + 1e-15, 1, 1], [3, 3 - 1e-9, 3 - 2e-9, 1], [0, 0, 0], [2, 0, 0, 0], [1e8, 1e-8, 1e-9], list(range(30, 0, -1)), [1 + 1e-7 * i for i in range(20)]])
def test_spectra_with_ties_and_narrow_gaps(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    m = q * np.array(values, float) @ q.T
    m = (m + m.T) / 2
    found, vectors = whitening.Spectrum(m).leading(8)
    k, size = min(8, d), max(values) or 1
    assert np.allclose(found, sorted(values, reverse=True)[:k], atol=1e-13 * size * d)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-7) and np.abs(m @ vectors - vectors * found).max() < 1e-12 * size * d


def test_counts_are_few():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 64)) * rng.uniform(0.2, 2, 64)
    s = whitening.Spectrum(np.cov(a.T, bias=True))
    values, vectors = s.leading(8)
    assert np.allclose(values, np.linalg.eigvalsh(np.cov(a.T, bias=True))[::-1][:8], rtol=1e-13) and s.factorisations < 200
