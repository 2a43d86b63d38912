import math
import random

import numpy as np
import pytest

from tagloom.llm import whitening

VECTOR = "vec_id bigint, embedding array<float>, label int, x string, id string, n int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "clash", "y", 2) for r in rows], VECTOR.replace("float", kind))


def expected(rows):
    """{vec_id: (deviation, whitened of each component)}, n, explained; by numpy's own eigenvectors."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(a) - s / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    k = min(4, len(sums))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        away = np.array([float(a) - s / n for a, s in zip(v, sums, strict=True)])
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), away @ vectors / np.sqrt(values))
    return out, n, values / np.trace(y.T @ y / n)


def vectors(rng, n, d):
    scale = np.linspace(3, 0.2, d)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(d) * scale]) for i in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(n // 3)]  # one vector is a quarter of all


def test_whitened_rows_are_those_of_plain_numpy(spark):
    rows = vectors(np.random.default_rng(1), 300, 12)
    want, n, explained = expected(rows)
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 4 * len(rows) and len({r.identity_error for r in got}) == 1
    sign = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        w = white[r.component - 1]
        sign.setdefault(r.component, 1 if (w > 0) == (r.whitened > 0) else -1)
        assert r.whitened * sign[r.component] == pytest.approx(w, abs=1e-10)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-12)
        assert r.identity_error < 1e-10
    first = {(r.vec_id, r.component): r.whitened for r in got}
    fit = {tuple(v): i for i, v in rows}
    matrix = np.array([[first[i, c] for c in range(1, 5)] for i in fit.values()])
    assert np.allclose(np.cov(matrix.T, bias=True), np.eye(4), atol=1e-10)


@pytest.mark.parametrize("seed", range(60))
def test_eigenvectors_of_all_kinds_of_matrices(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    turned = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spread = [
        rng.random(d), np.ones(d), np.r_[1e8, np.zeros(d - 1)], rng.integers(0, 3, d).astype(float),
        np.r_[[5, 5, 5 - 1e-9, 4.9999][:d], np.ones(max(0, d - 4))], np.zeros(d),
    ][seed % 6]
    matrix = (turned * spread) @ turned.T if seed % 12 < 6 else np.diag(spread)
    matrix = (matrix + matrix.T) / 2
    k, size = min(4, d), max(abs(spread).max(), 1e-300)
    values, found = whitening.principal(matrix, k)
    assert np.abs(values - np.sort(spread)[::-1][:k]).max() <= 1e-13 * size * d
    assert np.abs(found @ found.T - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ found.T - found.T * values).max() <= 1e-12 * size


def test_counts_of_eigenvalues_below():
    rng = np.random.default_rng(2)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.uniform(-4, 4, 100)
    assert (whitening.below(d, e, at) == (true[None] < at[:, None]).sum(axis=1)).all()


def test_dropped_rows(spark):
    good = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0, float("inf"), 1.0]), (105, [1.0]), (None, [0.0, 0.0, 1.0])]
    got = whitening.whitened(frame(spark, good + bad)).collect()
    assert {r.vec_id for r in got} == {*range(30), None}
    # The third dimension has no variance, so the third component has none.
    assert {r.whitened is None for r in got if r.component == 3} == {True}
    assert {r.whitened is None for r in got if r.component < 3} == {False}
    assert {r.explained for r in got if r.component == 3} == {0.0} and {r.n for r in got} == {15}
    assert max(r.component for r in got) == 3 and all(r.identity_error < 1e-9 for r in got)


def test_one_vector_repeated_rows_and_an_empty_table(spark):
    got = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    for rows in ([], [(1, None)]):
        done = whitening.whitened(frame(spark, rows))
        assert done.collect() == [] and done.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Sums and deviations are exact beyond what doubles and longs hold."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**40, rng.uniform(-1, 1)]) for i in range(50)] + [(99, [1e300, 0.5])]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(frame(spark, rows[:50], "double")).collect()}
    want, n, _ = expected(rows[:50])
    for i, _ in rows[:50]:
        exact = want[i][0]
        assert got[i, 1].deviation == (exact if exact < 1 << 63 else None)
    assert all(r.n == 51 for r in whitening.whitened(frame(spark, rows, "double")).collect())
    near = np.array([[1 << 30, 3], [-(1 << 31), 5]])
    sums = tuple(int(s) for s in near.sum(axis=0))
    assert whitening.deviations(near, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) if sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) < 1 << 63 else None for row in near]


def test_a_vector_of_many_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(700)]) for i in range(40)]
    got = whitening.whitened(frame(spark, rows, "double")).collect()
    assert len(got) == 160 and all(r.identity_error < 1e-8 for r in got)
