import numpy as np
import pytest

from framequarry.operators import pictures, tiles


def pixels(a):
    return [None if np.isnan(v) else float(v) for v in a.ravel()]


@pytest.mark.parametrize("side", [1, 3, 4, 100])
def test_tiles_cover_frames(spark, side):
    a = np.arange(35.0).reshape(5, 7)
    rows = tiles.tiled(spark.createDataFrame([(1, 5, 7, pixels(a)), (2, 0, 0, [])], "id long, height int, width int, v array<double>"), side).collect()
    seen = np.zeros((5, 7), int)
    for r in rows:
        assert np.array_equal(np.array(r.tile).reshape(r.th, r.tw), a[r.y0 : r.y0 + r.th, r.x0 : r.x0 + r.tw])
        seen[r.y0 : r.y0 + side, r.x0 : r.x0 + side] += 1
    assert (seen == 1).all() and {r.id for r in rows} == {1}


@pytest.mark.parametrize("side", [1, 4, 8, 64])
def test_components_do_not_depend_on_tiles(spark, side):
    """Random noise near the threshold where components are long, a spiral, a full picture, an empty one, missing pixels."""
    rng = np.random.default_rng(6)
    noise = (rng.random((24, 30)) < 0.42).astype(float)
    noise[rng.random(noise.shape) < 0.05] = np.nan
    spiral = np.zeros((19, 19))
    for k in range(0, 9, 2):
        spiral[k, k : 19 - k] = spiral[18 - k, k : 19 - k] = spiral[k : 19 - k, 18 - k] = spiral[k + 2 : 19 - k, k] = 1
        spiral[k + 2, k : k + 3] = 1
    frames = {"noise": noise, "spiral": spiral, "full": np.ones((9, 5)), "none": np.zeros((6, 6))}
    df = spark.createDataFrame([(k, *a.shape, pixels(a)) for k, a in frames.items()], "id string, height int, width int, v array<double>")
    want = set()
    for name, a in frames.items():
        spot = pictures.labelled((np.nan_to_num(a) > 0.5)[None])[0]
        for k in np.unique(spot[spot > 0]):
            y, x = np.nonzero(spot == k)
            want.add((name, int((y * a.shape[1] + x).min()), len(y), round(float(y.mean()), 9), round(float(x.mean()), 9)))
    got = {(r.id, r.spot, r.area, round(r.cy, 9), round(r.cx, 9)) for r in tiles.spots_across(df, 0.5, side).collect()}
    assert got == want


@pytest.mark.parametrize("side", [1, 5, 64])
def test_kymographs_against_sampling_whole_frames(spark, side):
    rng = np.random.default_rng(1)
    frames, want = [], {}
    points = [("a", v, s, w, float(2 + v + 0.7 * w + np.sin(s)), 1.3 * s) for v in range(3) for s in range(9) for w in (-1, 0, 1)] + [("b", 0, 0, 0, 7.0, 9.0), ("b", 0, 1, 0, 0.0, 0.0), ("b", 0, 2, 0, 99.0, 0.0)]
    for i in range(6):
        burst, a = "ab"[i % 2], rng.random((8, 10)) + 0.5
        m = [1.0, 0.05 * i, 0.3 * i, -0.05 * i, 1.0, -0.2] if burst == "a" else [1.0, 0, 0, 0, 1.0, 0]
        frames.append((burst, i, 8, 10, pixels(a), [float(x) for x in m]))
        for b, v, s, w, y, x in points:
            if b != burst:
                continue
            fx, fy = m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
            got = want.setdefault((b, v, i, s), [])
            if 0 <= fx <= 9 and 0 <= fy <= 7:
                iy, ix = int(fy), int(fx)
                jy, jx, py, px = min(iy + 1, 7), min(ix + 1, 9), fy - iy, fx - ix
                near = a[jy if py >= 0.5 else iy, jx if px >= 0.5 else ix]
                if near <= 1.4:
                    got.append(((a[iy, ix] * (1 - px) + a[iy, jx] * px) * (1 - py) + (a[jy, ix] * (1 - px) + a[jy, jx] * px) * py) / np.median(a))
    f = spark.createDataFrame(frames, "burst string, id long, height int, width int, v array<double>, map array<double>")
    p = spark.createDataFrame(points, "burst string, vessel int, s int, w int, y double, x double")
    rows = {(r.burst, r.vessel, r.id, r.s): r for r in tiles.kymographs(f, p, side, bright=1.4).collect()}
    assert set(rows) == set(want)
    for k, v in want.items():
        assert rows[k].n == len(v) and (rows[k].value is None if not v else abs(rows[k].value - np.mean(v)) < 1e-9)
    assert any(not v for v in want.values())
