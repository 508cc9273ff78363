import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators.neighbours import k_nearest
from framequarry.operators.spatial import nearest_in_reach


def plain(targets, k, queries=None):
    out = []
    for q, x, y in set(targets if queries is None else queries):
        if x is None or y is None or not math.isfinite(x) or not math.isfinite(y):
            continue
        near = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), b) for b, u, v in targets if u is not None and v is not None and math.isfinite(u) and math.isfinite(v) and (queries is not None or b != q))
        out += [(q, b, n + 1) for n, (_, b) in enumerate(near[:k])]
    return sorted(out)


def found(spark, targets, k, queries=None):
    df = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    got = k_nearest(df(targets), "id", "x", "y", k, None if queries is None else df(queries))
    return sorted((r.a, r.b, r.rank) for r in got.collect())


def test_neighbours_against_brute_force(spark):
    """A dense cluster, a tiny one, a sparse field, a line of equal distances, points at one place and points nowhere."""
    rng = np.random.default_rng(4)
    places = [*rng.normal(0, 1, (150, 2)), *(5 + rng.normal(0, 1e-4, (150, 2))), *rng.uniform(-100, 100, (40, 2)), *[(50.0 + k, 3.0) for k in range(20)], *[(7.0, 7.0)] * 60, (1e5, -1e5), (-0.0, 0.0), (0.0, -0.0)]
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(places)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 0.0)]
    assert found(spark, rows, 4) == plain(rows, 4)
    queries = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-20, 20, (60, 2)))] + [(70, 7.0, 7.0), (71, 7.0, 7.0), (72, None, 0.0)]
    assert found(spark, rows, 2, queries) == plain(rows, 2, queries)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_points(spark, n):
    rows = [(k, float(k), 1.0) for k in range(n)]
    assert found(spark, rows, 4) == plain(rows, 4)


def test_sparse_points_beside_a_dense_cell(spark):
    """20,000 points within a millionth of what a few others span: every query looks at few of them."""
    rng = np.random.default_rng(9)
    dense = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1e-3, (20_000, 2)))]
    sparse = [(100_000 + k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-500, 500, (30, 2)))]
    got = {}
    for a, b, _ in sorted(found(spark, dense + sparse, 3, sparse), key=lambda r: r[2]):
        got.setdefault(a, []).append(b)
    xy = np.array([p[1:] for p in dense + sparse])
    ids = np.array([p[0] for p in dense + sparse])
    for q, x, y in sparse:
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        assert got[q] == ids[np.lexsort((ids, d))[:3]].tolist()


def _in_reach(rows, k, apart):
    out = {}
    for a, x, y, g, v in rows:
        near = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(v, w, strict=True))), b) for b, u, z, h, w in rows if b != a and (not apart or g != h) and math.hypot(x - u, y - z) <= 0.5)
        if near:
            out[a] = [b for _, b in near[:k]]
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_in_reach_against_brute_force(spark, block):
    """Crowded cells are dealt to blocks of both sides; ties of distance go to the smaller identifier."""
    rng = np.random.default_rng(5)
    rows = [(k, float(x), float(y), int(k % 3), [float(n) for n in rng.integers(0, 3, 4)]) for k, (x, y) in enumerate(rng.normal(0, 0.6, (150, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, g int, e array<double>")
    for k, vector, other in ((2, "e", None), (1, "e", "g"), (3, "e", "g")):
        got = nearest_in_reach(df, "id", "x", "y", 0.5, k, vector, other, block=block)
        assert {r.a: [n.b for n in r.near] for r in got.collect()} == _in_reach(rows, k, other is not None)
    asked = nearest_in_reach(df, "id", "x", "y", 0.5, 1, other="g", asked=F.col("id") < 20, block=block)
    assert {r.a: r.near[0].b for r in asked.collect()} == {a: n[0] for a, n in _in_reach([(a, x, y, g, [x, y]) for a, x, y, g, _ in rows], 1, True).items() if a < 20}


@pytest.mark.parametrize("name", ["ratio_test_matches", "footprint_share", "faint_bridges", "end_links"])
def test_pairs_in_reach_are_not_joined_again(spark, sf, name):
    """Pairs grow with the square of the points: above the join that makes them there is no join with the points' columns."""
    from framequarry import plans

    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    at = [len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "Join Inner" in line and ("cx" in line or "double" in line)]
    above = [line for line in plan.splitlines() if "Join Inner" in line and "cx" not in line and at and len(line) - len(line.lstrip(" :+-")) < min(at)]
    assert not any(f" {k}#" in line or f"({k}#" in line for line in above for k in "ab")


def test_shared_pixels_in_lists_and_ranges(spark, monkeypatch):
    """A pixel with many owners is cut into lists; every pair is counted once for each pixel, whatever the ranges."""
    from collections import Counter
    from itertools import combinations

    from framequarry.operators import spatial

    monkeypatch.setattr(spatial, "LIST", 3)
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 10)
    rng = np.random.default_rng(6)
    rows = [(int(o), int(p)) for o, p in zip(rng.integers(0, 30, 400), rng.integers(0, 20, 400), strict=True)] + [(1, 99), (None, 99), (2, None)]
    owners: dict = {}
    for o, p in rows:
        if o is not None and p is not None:
            owners.setdefault(p, set()).add(o)
    want = Counter(pair for own in owners.values() for pair in combinations(sorted(own), 2))
    got = spatial.shared_pixels(spark.createDataFrame(rows, "o long, p long"), "o", "p", 2).collect()
    assert {(r.a, r.b): r.n for r in got} == {k: n for k, n in want.items() if n >= 2}


def test_shared_runs_over_stretches_and_parts(spark):
    """Runs go on over the ends of stretches, a pixel of many owners is divided, and pairs are never rows."""
    import random

    from framequarry.operators.spatial import shared_runs

    rnd = random.Random(6)
    rows = [(rnd.randrange(12), rnd.randrange(-40, 160), 0) for _ in range(700)] + [(k, 300, 0) for k in range(40)] + [(None, 5, 0), (3, None, 0)]
    rows = [(o, p, None if o == 7 else (o or 0) % 4) for o, p, _ in rows]
    df = spark.createDataFrame(rows, "o long, p long, node int")
    at: dict = {}
    own = {(o, p, n) for o, p, n in rows if None not in (o, p, n)}
    for o, p, n in own:
        for q, r, m in own:
            if p == r and o < q and n != m:
                at.setdefault((o, q), []).append(p)
    want = []
    for (a, b), ps in at.items():
        runs: list[list[int]] = []
        for p in sorted(ps):
            if runs and p - runs[-1][-1] <= 6:
                runs[-1].append(p)
            else:
                runs.append([p])
        want += [(a, b, r[0], len(r)) for r in runs]
    for most in (3, 40, 10**6):
        got = sorted(tuple(r) for r in shared_runs(df, "o", "p", "node", 6, most=most).collect())
        assert got == sorted(want)
    assert shared_runs(df.limit(0), "o", "p", "node", 6).collect() == []
