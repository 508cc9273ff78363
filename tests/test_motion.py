import numpy as np
import pytest

from framequarry.operators import synthetic
from framequarry.operators.gate import gate
from framequarry.operators.kernels import frame_scores, phase_shift_1d, phase_shift_2d
from framequarry.operators.registration import register
from framequarry.operators.velocity import by_lag, centred, estimate, velocities

FRAMES = "burst string, index int, height int, width int, bit_depth int, pixels binary"


def test_sub_pixel_shifts():
    rng = np.random.default_rng(1)
    row = np.convolve(rng.normal(size=200), np.hanning(9), "same")
    assert abs(phase_shift_1d(row, np.roll(row, 7))[0] - 7) < 0.05
    a = synthetic.scene(96, 128, 2)
    dy, dx, _ = phase_shift_2d(a, synthetic.shifted(a, 3.4, -5.7))
    assert abs(dy - 3.4) < 0.2 and abs(dx + 5.7) < 0.2


@pytest.mark.parametrize("seed,step,blinks", [(1, 0.0, ()), (2, 0.8, ()), (3, 2.0, (7, 8, 20))])
def test_registration_error_is_small(spark, seed, step, blinks):
    """RMS error of 0.2 pixels at most, blinks caught, no good frame rejected."""
    frames, path = synthetic.burst(30, 160, 224, seed, step, blinks)
    df = spark.createDataFrame([("b", k, 160, 224, 12, f) for k, f in enumerate(frames)], FRAMES)
    kept = {r["index"] for r in gate(frame_scores(df), "burst", "log_sharpness", "brightness").filter("keep").collect()}
    assert kept == set(range(30)) - set(blinks)
    good = df.filter(df["index"].isin(sorted(kept)))
    got = {r["index"]: (r.dy, r.dx) for r in register(good, write=lambda x: spark.createDataFrame(x.toPandas())).collect()}
    order = sorted(kept)
    error = np.array([got[k] for k in order]) - path[order]
    error -= np.median(error, axis=0)
    assert np.sqrt((error**2).sum(1).mean()) < 0.2


@pytest.mark.parametrize("speed", [-3.0, -0.7, 0.4, 1.5, 4.0])
def test_velocity_of_a_moving_pattern(speed):
    v, _, agree, reliable = estimate(synthetic.kymograph(120, 160, speed, 4))
    assert abs(v - speed) < 0.3 and agree >= 2 and reliable


def test_velocity_sign_and_noise(spark):
    a = synthetic.kymograph(80, 100, 2.0, 6)
    assert abs(by_lag(centred(a), 2) + by_lag(centred(a[::-1]), 2)) < 0.1
    noise = np.random.default_rng(0).normal(size=(80, 100))
    rows = [(name, t, s, float(k[t, s]) if (t + s) % 11 else None) for name, k in (("moving", a), ("noise", noise)) for t in range(80) for s in range(100)]
    rows += [("short", 0, 0, 1.0), ("empty", 0, 0, None)]
    got = {r.vessel: r for r in velocities(spark.createDataFrame(rows, "vessel string, t int, s int, k double")).collect()}
    assert abs(got["moving"].velocity - 2) < 0.3 and got["moving"].reliable and not got["noise"].reliable
    assert got["short"].velocity is None and got["empty"].velocity is None


def test_velocity_series_and_scales():
    from framequarry.operators import velocity

    k = synthetic.kymograph(200, 160, 1.5, 8)
    at, v = velocity.series(k, 40, 20)
    assert len(at) == 9 and np.all(np.abs(v - 1.5) < 0.3)
    assert abs(velocity.time_of_flight(k, 10, 30) - 1.5) < 0.3 and velocity.best_lag(k, 4) >= 2
    slow, scale = velocity.multi_scale(synthetic.kymograph(270, 160, 0.2, 9))
    assert scale > 1 and abs(slow - 0.2) < 0.05
    assert velocity.beats_chance(k, 1.5) and not velocity.beats_chance(np.random.default_rng(1).normal(size=(60, 80)), 1.5)


def test_pulsatility():
    from framequarry.operators.velocity import pulsatility

    t = np.arange(300) / 30
    f, index = pulsatility(2 + 0.5 * np.sin(2 * np.pi * 1.2 * t), 30, 0.5, 3)
    assert abs(f - 1.2) < 0.1 and abs(index - 0.5) < 0.02
    assert np.isnan(pulsatility(np.ones(3), 30, 0.5, 3)[0])


def test_widths_and_curves():
    from framequarry.operators.kernels import curvature, fwhm, resampled, strip

    x = np.arange(-20, 21)
    width, centre = fwhm(1 - 0.4 * np.exp(-(((x - 1) / 4) ** 2)))
    assert abs(width - 2 * 4 * np.sqrt(np.log(2))) < 0.1 and abs(centre - 21) < 0.05
    a = np.linspace(0, np.pi, 60)
    ring = np.column_stack([50 + 20 * np.cos(a), 50 + 20 * np.sin(a)])
    assert np.allclose(curvature(ring)[3:-3], 1 / 20, atol=2e-3)
    yy, xx = np.mgrid[:100, :100]
    s = strip(np.hypot(yy - 50, xx - 50), resampled(ring, 40), 5)
    assert s.shape == (40, 11) and np.allclose(np.abs(s[5:-5, 0] - s[5:-5, 10]), 10, atol=0.3)
