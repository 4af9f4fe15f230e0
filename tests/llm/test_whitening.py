"""The bidiagonal qd solver against numpy, and whitening against the covariance matrix itself."""

from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import whitening

ROWS = "vec_id long, embedding array<float>, component string, x string, whitened string"


def rows_of(spark, vectors):
    given = [(i, v, "a", "b", "c") for i, v in vectors]
    return spark.createDataFrame(given, ROWS).repartition(3)


def matrices():
    rng = np.random.default_rng(1)
    yield rng.normal(size=(40, 12))
    yield rng.normal(size=(30, 12)) * 10.0 ** -np.arange(12)  # graded
    yield (rng.normal(size=(30, 12)) * 10.0 ** -np.arange(12))[:, ::-1]
    yield rng.normal(size=(40, 4)) @ rng.normal(size=(4, 12))  # of rank four
    yield np.vstack([np.eye(8), -np.eye(8)])  # all eigenvalues equal
    yield np.vstack([np.diag([5.0, 5, 5, 2, 2, 1])] * 3)
    yield np.zeros((5, 3))
    yield np.ones((6, 5))
    yield rng.normal(size=(3, 9))  # fewer rows than dimensions
    yield rng.normal(size=(7, 1))
    yield rng.normal(size=(200, 90))
    yield rng.normal(size=(50, 6)) * [1, 0, 1, 0, 1e-9, 1]


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: "x".join(map(str, a.shape)))
def test_solver_equals_numpy(a):
    d = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    diagonal, above, _ = whitening.bidiagonal(r)
    squares = whitening.singular_squares(diagonal, above)
    exact = np.linalg.svd(a, compute_uv=False)
    exact = np.concatenate([exact, np.zeros(d - len(exact))])
    assert np.allclose(np.sqrt(squares), exact, rtol=1e-12, atol=1e-13 * max(exact[0], 1e-300))
    values, directions = whitening.leading_directions(r, min(4, d))
    gram = a.T @ a
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-12)
    assert np.allclose(gram @ directions, directions * values, atol=1e-11 * max(exact[0] ** 2, 1e-300))


def test_small_singular_values_are_accurate():
    # all of a bidiagonal matrix's singular values are determined to full relative accuracy by its entries
    diagonal, above = 10.0 ** -np.arange(0, 24, 2), 0.5 * 10.0 ** -np.arange(0, 22, 2)
    got = np.sqrt(whitening.singular_squares(diagonal, above))
    assert np.prod(got / diagonal) == pytest.approx(1.0, rel=1e-12)  # the determinant


def brute(vectors, count=4):
    whole = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in whole]
    fit = np.array(sorted({tuple(x) for _, x in xs}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    out = []
    for i, x in xs:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        for k in range(len(values)):
            out.append((i, k + 1, n, deviation, ((x - sums / n) @ axes[:, k]) / values[k] ** 0.5, values[k] / np.trace(centred.T @ centred / n)))
    return out


def test_whitened_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 7)) * [3, 2.5, 2, 1, 0.5, 0.4, 0.3])]
    vectors += [(100 + i, vectors[3][1]) for i in range(30)]  # one vector holds a third of all rows
    vectors += [(None, vectors[5][1]), (3, vectors[3][1]), (200, None), (201, [1.0] * 6 + [None]), (202, []),
                (203, [float("nan")] * 7), (204, [1.0] * 6 + [float("-inf")]), (205, [-0.0] * 7)]
    expected = brute(vectors)
    monkeypatch.setattr(whitening, "FAN", 2)  # several levels of factors
    got = whitening.whitened(rows_of(spark, vectors)).collect()
    assert len(got) == len(expected)

    def key(r):
        return (r[0] is None, r[0] or 0, r[1])

    signs: dict = {}
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert g[:4] == e[:4]
        sign = signs.setdefault(g[1], 1 if g[4] * e[4] > 0 else -1)
        assert g[4] == pytest.approx(sign * e[4], abs=1e-9)
        assert g[5] == pytest.approx(e[5], rel=1e-9)
        assert g[6] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_defined_cases(spark):
    assert whitening.whitened(rows_of(spark, [])).count() == 0
    assert whitening.whitened(rows_of(spark, [(1, None), (2, []), (3, [None])])).count() == 0
    alone = whitening.whitened(rows_of(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)] * 4
    line = whitening.whitened(rows_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1}
    assert {r["component"] for r in line} == {1, 2, 3}
    assert max(r["identity_error"] for r in line) < 1e-9
    with pytest.raises(ValueError, match="length"):
        whitening.whitened(rows_of(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviations_beyond_64_bits():
    fitted = whitening.Whitening(1 << 30, np.zeros(2, np.int64), np.eye(2), np.ones(2), 2.0)
    assert whitening._deviations(np.array([[1 << 5, 0], [3, 4]]), fitted) == [1 << 70, 25 << 60]
