import math

import numpy as np
import pytest

from promptgauge.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, x string, component int, i int"


def table(spark, vectors, ids=None):
    rows = [(i, v, "x", 9, 9) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors, components=4, scale=256):
    """Grid, fit list, exact sums and numpy's eigenvalues."""
    grid = [[math.floor(scale * float(np.float32(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, grid))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    matrix = centred.T @ centred / n
    values, directions = np.linalg.eigh(matrix)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    white = np.array([[(x * n - s) / n for x, s in zip(row, sums)] for row in grid]) @ directions / np.sqrt(values)
    deviation = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in grid]
    return n, deviation, white, values / np.trace(matrix)


def held_to(rows, vectors, components=4):
    n, deviation, white, explained = expected(vectors, components)
    assert len(rows) == white.size
    signs = {}
    for r in rows:
        i, k = r["vec_id"], r["component"] - 1
        assert r["n"] == n and int(r["deviation"]) == deviation[i]
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9) and 0 <= r["identity_error"] < 1e-8
        if abs(white[i, k]) > 1e-6:
            signs.setdefault(k, np.sign(r["whitened"] * white[i, k]))
        assert r["whitened"] == pytest.approx(signs.get(k, 1) * white[i, k], abs=1e-6)


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) + 3).tolist()
    vectors += vectors[:40]  # copies count once
    held_to(op.whitened(table(spark, vectors).repartition(5)).collect(), vectors)


def test_same_bits_for_any_partitioning(spark):
    rng = np.random.default_rng(2)
    frame = table(spark, rng.standard_normal((200, 6)).tolist())
    keep = ("vec_id", "component", "deviation", "whitened", "explained")
    found = [sorted(tuple(r[c] for c in keep) for r in op.whitened(frame.repartition(k)).collect()) for k in (1, 7)]
    assert found[0] == found[1]


def test_large_offset_does_not_swallow_the_spread(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((200, 5)) * [1, 0.5, 2, 0.1, 3] + 30_000).astype("float32").tolist()
    held_to(op.whitened(table(spark, vectors)).collect(), vectors)


def test_unusable_vectors_drop_out(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((60, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf")] * 4, [-float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [1e38, 0.0, 0.0, 0.0]]
    frame = table(spark, good + bad)
    held_to(op.whitened(frame).collect(), good)


def test_few_vectors_and_equal_rows(spark):
    assert op.whitened(table(spark, [])).collect() == []
    assert op.whitened(table(spark, [None, None])).collect() == []
    assert op.whitened(table(spark, [[1.0, 2.0]] * 3)).collect() == []
    two = op.whitened(table(spark, [[0.0, 0.0], [-0.0, 0.0], [1.0, 1.0]], [5, None, 5])).collect()
    assert sorted((str(r["vec_id"]), r["component"], round(r["whitened"], 9)) for r in two) == [("5", 1, -1.0), ("5", 1, 1.0), ("None", 1, -1.0)]
    held_to(op.whitened(table(spark, [[1.0, 2.0], [3.0, 1.0], [0.0, 5.0]])).collect(), [[1.0, 2.0], [3.0, 1.0], [0.0, 5.0]], 2)


def test_exact_beyond_doubles(spark):
    vectors = [[2.0**44, 1.0], [-(2.0**44), 3.0], [2.0**43, -7.0], [5.0, 11.0]]
    held = {r["vec_id"]: int(r["deviation"]) for r in op.whitened(table(spark, vectors)).collect()}
    assert held == dict(enumerate(expected(vectors)[1]))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 40])
def test_inertia_and_solutions(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = rng.integers(-3, 4, (size, size)).astype(float)
        a = a + a.T
        if rng.random() < 0.5:
            np.fill_diagonal(a, 0)
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() < 1e-9:
            continue
        f = op.Factored(a)
        assert f.positive() == (values > 0).sum()
        b = rng.standard_normal(size)
        assert np.allclose(f.solve(b), np.linalg.solve(a, b), atol=1e-6 * np.linalg.cond(a))


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [5, 5, 5, 1, 1], [1, 1, 1, 1, 1], [9, 9 - 1e-9, 1, 0, 0], [1e12, 1e6, 1, 1e-3, 0], [3, 0, 0, 0, 0], [0, 0, 0, 0, 0], [1 + 4e-16, 1, 1 - 4e-16, 0.5, 0.2]])
def test_spectrum_with_close_and_equal_eigenvalues(values):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.standard_normal((5, 5)))
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = op.spectrum(matrix, 4)
    known = [v for v in np.linalg.eigvalsh(matrix)[::-1][:4] if v > 1e-13 * max(values)]
    assert len(found) in (len(known), len([v for v in values[:4] if v > 1e-14 * values[0]])) and np.allclose(found, known[: len(found)], rtol=1e-9, atol=1e-13 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-9)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-12 * max(values + [1]))


def test_many_random_spectra():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        size = int(rng.integers(4, 65))
        a = rng.standard_normal((3 * size, size)) * rng.random(size)
        matrix = a.T @ a
        found, vectors = op.spectrum(matrix, 4)
        values = np.linalg.eigvalsh(matrix)[::-1][:4]
        assert np.allclose(found, values, rtol=1e-11)
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * values[0]
