import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry import plans
from framequarry.operators import profiles, velocity
from framequarry.operators.synthetic import kymograph, smooth_path, vessel_phantom, vessel_tree
from framequarry.plans.rows import erf


def test_smooth_curve_of_a_circle():
    a = np.linspace(0, 1.5 * np.pi, 150)
    xy = 30 * np.column_stack([np.cos(a), np.sin(a)]) + np.random.default_rng(1).normal(0, 0.05, (150, 2))
    s, bend = profiles.smooth_curve(xy, stiffness=1e-2)
    step = np.hypot(*np.diff(s, axis=0).T)
    assert abs(step.sum() - 30 * 1.5 * np.pi) < 1 and step.std() < 0.05 * step.mean()
    assert np.median(np.abs(bend[10:-10] - 1 / 30)) < 0.01


def test_natural_spline():
    x, y = np.array([0.0, 1, 2.5, 3, 5]), np.array([1.0, -1, 0, 4, 2])
    assert np.allclose(profiles.natural_spline(x, y, x), y)
    h = 1e-4
    second = lambda t: (profiles.natural_spline(x, y, np.array([t - h, t, t + h])) @ [1, -2, 1]) / h**2
    for k in x[1:-1]:
        assert abs(second(k - 2 * h) - second(k + 2 * h)) < 0.05
    assert abs(second(x[0] + 2 * h)) < 0.05 and abs(second(x[-1] - 2 * h)) < 0.05
    assert np.allclose(profiles.natural_spline(x, 3 * x + 1, np.array([0.3, 4.2])), [1.9, 13.6])


@pytest.mark.parametrize("width,blur", [(4, 1.0), (8, 1.5), (16, 2.5)])
def test_fitted_box(width, blur):
    t = np.arange(-30, 30.1, 0.5)
    q = np.array([1.0, 0.002, 0.4, 1.3, width, blur])
    p = profiles.blurred_box(t, q)[0]
    got, r2 = profiles.fit_box(p, t, width * 1.3)
    assert np.allclose(got, q, atol=1e-3) and r2 > 0.9999
    f, j = profiles.blurred_box(t, q)
    for k in range(6):
        d = np.zeros(6)
        d[k] = 1e-6
        assert np.allclose((profiles.blurred_box(t, q + d)[0] - f) / 1e-6, j[:, k], atol=1e-4)
    w, c, _ = profiles.half_width(p, t)
    assert abs(w - width) < 0.5 and abs(c - 1.3) < 0.5
    assert math.isnan(profiles.half_width(np.linspace(0, 1, 40), np.arange(40.0))[0])


def test_diameters_along_a_vessel(spark, sf):
    image, xy = vessel_phantom(10, seed=3)
    d = profiles.diameters(image, xy, 10, without=np.array([xy[60]]))
    assert abs(np.median(d["width"][d["valid"]]) - 10) < 0.6 and not d["valid"][55:65].any() and d["valid"].mean() > 0.6
    rows = plans.queries()["diameter_phantoms"](spark, sf).collect()
    assert len(rows) == len({r.vec_id // 32 for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()})
    for r in rows:
        if r.width >= 6:
            assert abs(r.half_width - r.width) < 0.12 * r.width + 0.2 and abs(r.fitted - r.width) < 0.12 * r.width + 0.2


def test_despiked_and_tracked():
    way = np.array([[0, 0], [1, 0], [2, 0], [1.2, 0.1], [3, 0], [4, 0]], float)
    assert len(profiles.despiked(way)) < len(way) and len(profiles.despiked(way[:2])) == 2
    y, x = np.mgrid[:60, :80]
    strength = np.exp(-0.5 * ((y - 30 - 8 * np.sin(x / 20)) / 2) ** 2)
    path = profiles.tracked(strength, (30.0, 0.0), 0.3)
    assert path[-1, 1] > 75 and np.abs(path[:, 0] - 30 - 8 * np.sin(path[:, 1] / 20)).max() < 2.5


def test_fitted_line_recovers_its_vessel():
    for q in ([0.4, 2.0, math.log(1.5), 1.0], [2.0, -3.0, math.log(2.0), 0.7]):
        image, _ = profiles.render_line((24, 24), np.array(q))
        got, error = profiles.fit_line(image + np.random.default_rng(1).normal(0, 0.01, image.shape))
        model, _ = profiles.render_line((24, 24), got)
        assert error < 3e-4 and np.abs(model - image).max() < 0.1
    f, j = profiles.render_line((9, 9), np.array([0.3, 0.5, 0.2, 0.8]))
    for k in range(4):
        d = np.zeros(4)
        d[k] = 1e-6
        assert np.allclose((profiles.render_line((9, 9), np.array([0.3, 0.5, 0.2, 0.8]) + d)[0] - f) / 1e-6, j[..., k], atol=1e-5)


def test_error_function(spark):
    x = [-6.0, -3.9, -1.0, -0.1, 0.0, 0.3, 2.0, 3.99, 4.5]
    got = [r.e for r in spark.createDataFrame([(v,) for v in x], "x double").select(erf(F.col("x")).alias("e")).collect()]
    assert np.allclose(got, [math.erf(v) for v in x], atol=2e-8)


@pytest.mark.parametrize("speed", [-2.5, 0.8, 1.5])
def test_speeds_of_drawn_flow(speed):
    k = kymograph(120, 100, speed, 5)
    v, explained, height = velocity.ridge_speed(velocity.correlation_map(k, 12, 40))
    assert abs(v - speed) < 0.1 and explained > 0.95 and height > 0.3
    assert abs(velocity.flight_speed(k) - speed) < 0.15 * abs(speed)
    ratio, across, within = velocity.transit_ratio(k, 50, speed)
    assert 0.7 < ratio < 1.3 and across > 0.3
    static = np.random.default_rng(1).normal(size=100)
    assert np.corrcoef(np.nanmean(velocity.without_static(k + 5 * static), axis=0), static)[0, 1] < 0.2
    assert math.isnan(velocity.transit_ratio(k, 5, speed)[0])


def test_fast_flow_against_chance():
    v, score, chance = velocity.fast_speed(kymograph(120, 100, 6.0, 9), shuffles=5)
    assert abs(v - 6) < 0.5 and score > 1.3 * chance
    _, score, chance = velocity.fast_speed(np.random.default_rng(3).normal(size=(120, 100)), shuffles=5)
    assert score < 2 * chance


def test_drawn_scenes():
    path = smooth_path(np.random.default_rng(1), (5.0, 5.0), 0.3, 50)
    assert len(path) == 51 and np.allclose(np.hypot(*np.diff(path, axis=0).T), 1)
    image, paths = vessel_tree(2)
    assert len(paths) == 12 and 0 <= image.min() < 0.6 and image.max() <= 1


def test_phantom_queries(spark, sf):
    q = plans.queries()
    rows = q["kymograph_phantoms"](spark, sf).collect()
    assert all(abs(r.ridge - r.speed) < 0.1 * abs(r.speed) + 0.05 and r.beats_chance for r in rows)
    control = q["negative_control"](spark, sf).collect()
    assert all(r.reliable == r.flowing for r in control)
    assert all(r.found > 0.8 for r in q["vessel_scenes"](spark, sf).collect())
