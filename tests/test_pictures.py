import numpy as np
import pytest

from framequarry.operators import masks
from framequarry.operators import pictures as P


@pytest.fixture
def stack():
    return np.random.default_rng(4).normal(size=(5, 12, 15))


def test_masks_agree_with_the_single_picture_kernels(stack):
    for a in stack:
        m = P.dilate((a > 0.8)[None], P.disc(1))[0]
        lab, n = masks.labels(m)
        got = P.labelled(m[None])[0]
        assert len(np.unique(got)) == n + (not m.all()) and all(len(np.unique(got[lab == k])) == 1 for k in range(1, n + 1))
        assert (P.thinned(m[None])[0] == masks.thinned(m)).all()
        assert np.allclose(P.distance(m[None])[0], masks.distance(m))
        assert (P.grown((a > 1.2)[None], m[None])[0] == masks.hysteresis(m * 1.0 + (a > 1.2), 0.5, 1.5)).all()
    assert np.isnan(P.distance(np.ones((1, 3, 3), bool))).all()


def test_blur_keeps_means_and_skips_gaps(stack):
    flat = np.full((1, 9, 9), 2.5)
    assert np.allclose(P.blur(flat, 1.0, 3), 2.5)
    gaps = stack.copy()
    gaps[:, 3:5, 4] = np.nan
    assert np.isfinite(P.blur_valid(gaps, 1.0, 2)).all() and np.allclose(P.blur_valid(np.where(np.isnan(gaps), np.nan, 1.0), 1.0, 2), 1)
    assert np.isnan(P.blur_valid(np.full((1, 5, 5), np.nan), 1.0, 2)).all()


def test_ridges_find_dark_lines_only():
    y, x = np.mgrid[:40, :40]
    line = 1 - 0.5 * np.exp(-0.5 * ((y - x) / 2.0) ** 2)
    r = P.ridges(np.stack([line, 2 - line]), ((2.0, 8),), np.array([0.05, 0.05]))
    assert r[0, 20, 20] > 0.9 and r[0, 5, 30] < 0.1 and r[1, 20, 20] < 0.1
    strength, which = P.oriented(-line[None], P.line_kernels(1.5, 2.0, 4, 8))
    assert abs(int(which[0, 20, 20]) - 6) <= 4 and strength[0, 20, 20] != 0


def test_warps(stack):
    assert np.allclose(P.warped(stack, np.eye(3)), stack)
    by = np.array([[1.0, 0, 2], [0, 1, -1], [0, 0, 1]])
    w = P.warped(stack, by)
    assert np.allclose(w[:, 1:, :-2], stack[:, :-1, 2:]) and np.isnan(w[:, 0]).all()
    assert np.array_equal(P.moved(stack, 1, -2)[:, 1:, :-2], stack[:, :-1, 2:]) and np.isnan(P.moved(stack, 1, 0)[:, 0]).all()
    yy, xx = np.mgrid[2:9, 2:9] * 1.0
    assert np.allclose(P.cubic(stack, yy, xx), stack[:, 2:9, 2:9])


def test_smooth_surface_is_the_exact_minimum():
    rng = np.random.default_rng(2)
    a, w = rng.normal(size=(1, 7, 8)), (rng.random((1, 7, 8)) < 0.6) * 1.0
    n = a.size
    rows = []
    eye = np.eye(n).reshape(n, 7, 8)
    for d in (np.diff(eye, 2, axis=1), np.diff(eye, 2, axis=2), np.sqrt(2) * np.diff(np.diff(eye, axis=1), axis=2)):
        rows.append(d.reshape(n, -1).T)
    k = np.vstack(rows)
    want = np.linalg.solve(np.diag(w.ravel()) + 0.3 * k.T @ k, (w * a).ravel())
    assert np.allclose(P.smooth_surface(a, w, 0.3, rounds=2000).ravel(), want, atol=1e-6)


def test_background_passes_over_dark_vessels():
    y, x = np.mgrid[:32, :32]
    true = 2 + 0.01 * x + 0.005 * y
    vessel = 0.6 * np.exp(-0.5 * ((y - 16) / 1.5) ** 2)
    b = P.background((true - vessel + np.random.default_rng(1).normal(0, 0.005, true.shape))[None], 8, 50.0)[0]
    assert np.abs(b - true)[4:-4, 4:-4].max() < 0.1


def test_pictures_that_do_not_fit_are_null(spark):
    rows = [(1, 2, 2, [1.0, 2.0, None, 4.0]), (2, 2, 3, [1.0]), (3, None, 2, [1.0, 2.0]), (4, 0, 0, []), (None, 1, 2, [5.0, 7.0]), (5, 2, 2, None)]
    df = spark.createDataFrame(rows, "id long, height int, width int, v array<double>")
    got = {r.id: (r.out, r.n) for r in P.run(df, lambda a: {"out": a * 2, "n": np.isfinite(a).sum(axis=(1, 2))}, "out array<double>, n long").collect()}
    assert got == {1: ([2.0, 4.0, None, 8.0], 3), 2: (None, None), 3: (None, None), 4: (None, None), None: ([10.0, 14.0], 2), 5: (None, None)}
    assert P.run(df.limit(0), lambda a: {"out": a}, "out array<double>").collect() == []
