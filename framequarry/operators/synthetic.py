"""Seeded recordings with known truth, for tests and examples."""

from __future__ import annotations

import numpy as np

from .kernels import gaussian


def scene(height: int, width: int, seed: int) -> np.ndarray:
    """A smooth picture with dark curved lines, 0 to 1."""
    rng = np.random.default_rng(seed)
    a = gaussian(rng.normal(size=(height, width)), 6)
    a = 0.6 + 0.08 * a / a.std()
    yy, xx = np.mgrid[:height, :width]
    for _ in range(9):
        t, off, bend = rng.uniform(0, np.pi), rng.uniform(-0.5, 0.5), rng.uniform(-40, 40)
        u = (xx - width / 2) * np.cos(t) + (yy - height / 2) * np.sin(t)
        v = -(xx - width / 2) * np.sin(t) + (yy - height / 2) * np.cos(t)
        d = v - off * height - bend * np.sin(u / 60)
        a -= rng.uniform(0.15, 0.3) * np.exp(-((d / rng.uniform(1.5, 4)) ** 2))
    return np.clip(a, 0, 1)


def shifted(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """a moved by (dy, dx), by its spectrum; the border wraps."""
    fy, fx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.rfftfreq(a.shape[1])[None]
    return np.fft.irfft2(np.fft.rfft2(a) * np.exp(-2j * np.pi * (fy * dy + fx * dx)), a.shape)


def burst(n: int, height: int, width: int, seed: int, step: float, blinks: tuple[int, ...] = (), bits: int = 12):
    """(frames as bytes, true shifts (n, 2)): a random walk over the scene; blinks are dark and blurred."""
    rng = np.random.default_rng(seed + 1)
    a, path = scene(height, width, seed), np.cumsum(rng.normal(0, step, (n, 2)), axis=0) * (step > 0)
    full, frames = (1 << bits) - 1, []
    for k in range(n):
        f = shifted(a, *path[k]) + rng.normal(0, 0.01, a.shape)
        if k in blinks:
            f = gaussian(f, 8) * 0.4
        frames.append((np.clip(f, 0, 1) * full).astype("<u2").tobytes())
    return frames, path


def kymograph(rows: int, places: int, speed: float, seed: int, noise: float = 0.3, pattern: np.ndarray | None = None) -> np.ndarray:
    """rows x places: a pattern (random where none is given; repeated where it is short) that moves by ``speed`` places a row."""
    rng = np.random.default_rng(seed)
    size = places + int(abs(speed) * rows) + 20
    long = gaussian(rng.normal(size=size) if pattern is None else np.resize(pattern, size), 1.5)
    long /= long.std()
    at = np.arange(places)[None] - speed * np.arange(rows)[:, None]
    at -= at.min()
    return np.interp(at.ravel(), np.arange(len(long)), long).reshape(rows, places) + rng.normal(0, noise, (rows, places))


def vessel_phantom(width: float, seed: int | list[int], blur: float = 1.2, noise: float = 0.01, length: int = 120):
    """(picture with one gently curved dark vessel of constant width, its centre line): a box across it, blurred."""
    rng = np.random.default_rng(seed)
    h = int(4 * max(width, 8) + 40)
    x = np.arange(10.0, length + 10)
    y = h / 2 + 4 * np.sin(x / 40 + rng.uniform(0, 6))
    yy, xx = np.mgrid[: 4 * h, : 4 * (length + 20)] / 4.0
    mid = np.interp(xx[0], x, y)
    slope = np.gradient(mid, xx[0])
    far = np.abs(yy - mid[None]) / np.sqrt(1 + slope[None] ** 2)
    a = np.where(far <= width / 2, 0.6, 1.0).reshape(h, 4, length + 20, 4).mean(axis=(1, 3))
    return gaussian(a, blur) + rng.normal(0, noise, a.shape), np.column_stack([x, y])


#: Recordings with known motion: pixels a step, frames that blink.
CASES = {"still": (0.0, ()), "gentle": (0.4, ()), "rough": (2.0, ()), "blinks": (2.0, (7, 8, 9, 31, 32))}


def case_frames(spark, cases: dict | None = None, n: int = 60, height: int = 120, width: int = 200, slices: int | None = None):
    """burst, index, height, width, bit_depth, pixels, true_dy, true_dx, blink of the recordings ``cases``, drawn where they are used."""
    import pyarrow as pa

    cases = CASES if cases is None else cases
    names = sorted(cases)

    def draw(batches):
        kept: dict[int, tuple] = {}
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                c, k = i // n, i % n
                step, blinks = cases[names[c]]
                if c not in kept:
                    path = np.cumsum(np.random.default_rng(900 + c).normal(0, step, (n, 2)), axis=0) * (step > 0)
                    kept = {c: (scene(height, width, 40 + c), path)}
                a, path = kept[c]
                f = shifted(a, *path[k]) + np.random.default_rng(7000 + i).normal(0, 0.01, a.shape)
                if k in blinks:
                    f = gaussian(f, 8) * 0.4
                rows.append((f"burst_{names[c]}", k, height, width, 12, (np.clip(f, 0, 1) * 4095).astype("<u2").tobytes(), float(path[k, 0]), float(path[k, 1]), k in blinks))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.bool_())
            cols = ("burst", "index", "height", "width", "bit_depth", "pixels", "true_dy", "true_dx", "blink")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=cols)

    spark_slices = slices or max(1, min(len(names) * n, spark.sparkContext.defaultParallelism))
    schema = "burst string, `index` int, height int, width int, bit_depth int, pixels binary, true_dy double, true_dx double, blink boolean"
    return spark.range(0, len(names) * n, 1, spark_slices).mapInArrow(draw, schema)


def smooth_path(rng: np.random.Generator, start: tuple[float, float], heading: float, length: int, wiggle: float = 0.08, memory: float = 0.9) -> np.ndarray:
    """Points (y, x) one pixel apart whose heading drifts with a memory."""
    drift, out = 0.0, [start]
    for _ in range(length):
        drift = memory * drift + (1 - memory) * rng.normal(0, wiggle * 4)
        heading += drift
        out.append((out[-1][0] + np.sin(heading), out[-1][1] + np.cos(heading)))
    return np.array(out)


def vessel_tree(seed: int | list[int], height: int = 128, width: int = 192, trees: int = 3, branches: int = 3) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """(picture, [(path, radius)]) of branching vessels: each branch leaves its parent at a point on it and is thinner."""
    rng = np.random.default_rng(seed)
    paths: list[tuple[np.ndarray, float]] = []
    for _ in range(trees):
        root = smooth_path(rng, (float(rng.uniform(0, height)), 0.0), float(rng.uniform(-0.5, 0.5)), width)
        paths.append((root, 3.0))
        for _ in range(branches):
            k = int(rng.integers(20, len(root) - 20))
            d = root[k + 1] - root[k]
            turn = float(np.arctan2(d[0], d[1]) + rng.choice([-1, 1]) * rng.uniform(0.5, 1.0))
            paths.append((smooth_path(rng, tuple(root[k]), turn, int(rng.integers(30, 90))), float(rng.uniform(1.0, 2.0))))
    a = np.full((height, width), 0.8)
    yy, xx = np.mgrid[:height, :width]
    for path, r in paths:
        best = np.full(a.shape, np.inf)
        for y, x in path[::2]:
            best = np.minimum(best, (yy - y) ** 2 + (xx - x) ** 2)
        a -= 0.25 * np.exp(-best / (2 * r * r))
    return np.clip(a, 0, 1), paths
