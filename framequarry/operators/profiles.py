"""numpy kernels on curves and the profiles across them: smoothing splines, widths, despiking, tracking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x.ravel().tolist()]).reshape(x.shape)


def per_curve(df: DataFrame, key: str, order: str, values: list[str], work, schema: str) -> DataFrame:
    """key and ``schema`` of each curve of df (key, order, values): ``work`` gets arrays in order and gives rows.

    A curve is one group: its points must fit a task. Points with a null value are left out.
    """
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]
    types = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_o")
        rows = work(*[table.column(v).to_numpy().astype(float) for v in values])
        kinds = [pa.int64() if c.strip().split()[-1] == "long" else pa.bool_() if c.strip().split()[-1] == "boolean" else pa.float64() for c in schema.split(",")]
        clean = lambda x: None if x is None or x != x else x
        first = table.column(key)[0].as_py()
        return pa.Table.from_arrays([pa.array([first] * len(rows), table.schema.field(key).type), *[pa.array([clean(r[k]) for r in rows], t) for k, t in enumerate(kinds)]], names=[key, *names])

    rows = df.select(key, F.col(order).alias("_o"), *[F.col(v).cast("double").alias(v) for v in values]).dropna(subset=values)
    return rows.groupBy(key).applyInArrow(run, f"`{key}` {types[key]}, {schema}")


def bspline_basis(t: np.ndarray, pieces: int) -> np.ndarray:
    """Cubic B-splines on ``pieces`` equal intervals of 0..1: one row a place, pieces + 3 columns."""
    x = np.clip(t, 0, 1) * pieces
    k = np.minimum(x.astype(int), pieces - 1)
    u = x - k
    parts = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], axis=1) / 6
    out = np.zeros((len(t), pieces + 3))
    for j in range(4):
        out[np.arange(len(t)), k + j] = parts[:, j]
    return out


def smooth_curve(xy: np.ndarray, stiffness: float = 1e-3, end_weight: float = 5.0, spacing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(points at equal arc length, signed curvature at them) of a spline that smooths a polyline; its ends weigh more."""
    s = np.append(0, np.cumsum(np.hypot(*np.diff(xy, axis=0).T)))
    if len(xy) < 4 or s[-1] == 0:
        return xy, np.zeros(len(xy))
    t, pieces = s / s[-1], int(np.clip(len(xy) // 3, 1, 400))
    b = bspline_basis(t, pieces)
    w = np.ones(len(xy))
    w[[0, -1]] = end_weight
    d = np.diff(np.eye(pieces + 3), 3, axis=0) * pieces**1.5
    c = np.linalg.solve(b.T @ (w[:, None] * b) + stiffness * d.T @ d + 1e-9 * np.eye(pieces + 3), b.T @ (w[:, None] * xy))
    fine = bspline_basis(np.linspace(0, 1, 20 * pieces + 1), pieces) @ c
    arc = np.append(0, np.cumsum(np.hypot(*np.diff(fine, axis=0).T)))
    n = max(2, int(round(arc[-1] / spacing)) + 1)
    at = np.interp(np.linspace(0, arc[-1], n), arc, np.linspace(0, 1, len(fine)))
    h = 1e-4
    low, high = np.clip(at - h, 0, 1 - 2 * h), np.clip(at - h, 0, 1 - 2 * h) + 2 * h
    p, a, z = (bspline_basis(x, pieces) @ c for x in ((low + high) / 2, low, high))
    d1, d2 = (z - a) / (2 * h), (z - 2 * p + a) / h**2
    bend = (d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / np.maximum(np.hypot(*d1.T) ** 3, 1e-12)
    return bspline_basis(at, pieces) @ c, bend


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through the knots whose second derivative is 0 at both ends."""
    n, h = len(x), np.diff(x)
    if n < 3:
        return np.interp(at, x, y)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    k = np.arange(1, n - 1)
    a[k, k - 1], a[k, k], a[k, k + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    right = np.zeros(n)
    right[1:-1] = 6 * (np.diff(y)[1:] / h[1:] - np.diff(y)[:-1] / h[:-1])
    m = np.linalg.solve(a, right)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    p, q = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return p * y[i] + q * y[i + 1] + ((p**3 - p) * m[i] + (q**3 - q) * m[i + 1]) * h[i] ** 2 / 6


def half_width(p: np.ndarray, t: np.ndarray, tail: float = 0.2) -> tuple[float, float, float]:
    """(width at half depth, centre, depth) of the dip in the middle half of a profile; NaN where a side is open."""
    n = len(p)
    k, mid = max(2, int(tail * n)), n // 2
    base = float(np.median(np.concatenate([p[:k], p[-k:]])))
    lo = max(0, mid - n // 4)
    low = lo + int(np.argmin(p[lo : min(n, mid + n // 4)]))
    depth = base - float(p[low])
    if depth <= 0:
        return math.nan, math.nan, 0.0
    half = base - depth / 2
    over = p >= half
    left, right = np.flatnonzero(over[:low]), np.flatnonzero(over[low:])
    if not len(left) or not len(right):
        return math.nan, float(t[low]), depth
    i, j = int(left[-1]), low + int(right[0])
    a = t[i + 1] + (half - p[i + 1]) / (p[i] - p[i + 1]) * (t[i] - t[i + 1])
    b = t[j - 1] + (half - p[j - 1]) / (p[j] - p[j - 1]) * (t[j] - t[j - 1])
    return float(b - a), float(a + b) / 2, depth


def blurred_box(t: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dark box of depth q[2], centre q[3], width q[4], blurred by q[5], on a straight line q[0] + q[1] t; and its derivatives."""
    r = math.sqrt(2) * q[5]
    a, b = (t - q[3] + q[4] / 2) / r, (t - q[3] - q[4] / 2) / r
    box, ea, eb = _erf(a) - _erf(b), np.exp(-a * a), np.exp(-b * b)
    k = 2 / math.sqrt(math.pi)
    by_centre, by_width, by_blur = -k / r * (ea - eb), k / (2 * r) * (ea + eb), -k / q[5] * (a * ea - b * eb)
    return q[0] + q[1] * t - q[2] / 2 * box, np.stack([np.ones_like(t), t, -box / 2, -q[2] / 2 * by_centre, -q[2] / 2 * by_width, -q[2] / 2 * by_blur], axis=1)


def fit_box(p: np.ndarray, t: np.ndarray, width: float, centre: float = 0.0, blur: float | None = None, blur_weight: float = 0.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(parameters of ``blurred_box``, share explained) by damped Gauss-Newton within bounds; ``blur`` may be a belief."""
    k = max(2, len(p) // 5)
    base = float(np.median(np.concatenate([p[:k], p[-k:]])))
    depth, reach = max(base - float(p.min()), 1e-6), float(t[-1])
    low = np.array([-np.inf, -np.inf, 0.0, -reach / 2, 0.5, 0.3])
    high = np.array([np.inf, np.inf, np.inf, reach / 2, 1.6 * reach, 6.0])
    q = np.clip([base, 0.0, depth, centre, max(width, 1.5), blur or 1.2], low, high)
    pull = blur_weight * math.sqrt(len(t)) * depth if blur is not None else 0.0

    def residuals(q):
        f, j = blurred_box(t, q)
        if not pull:
            return f - p, j
        return np.append(f - p, pull * (q[5] - blur)), np.vstack([j, [0, 0, 0, 0, 0, pull]])

    r, j = residuals(q)
    cost, damp = float(r @ r), 1e-3
    for _ in range(rounds):
        g, h = j.T @ r, j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), -g)
        trial = np.clip(q + step, low, high)
        rt, jt = residuals(trial)
        new = float(rt @ rt)
        if new < cost:
            done = cost - new <= 1e-12 * cost
            q, r, j, cost, damp = trial, rt, jt, new, max(damp / 4, 1e-12)
            if done:
                break
        else:
            damp *= 6
            if damp > 1e12:
                break
    total = float(((p - p.mean()) ** 2).sum()) + 1e-12
    return q, 1 - float((r[: len(t)] ** 2).sum()) / total


def across(image: np.ndarray, xy: np.ndarray, half: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(profiles along the normal at each point of a curve, places on it); the border is repeated."""
    d = np.gradient(xy, axis=0)
    n = np.column_stack([-d[:, 1], d[:, 0]]) / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)[:, None]
    t = np.arange(-half, half + 1e-9, step)
    x, y = xy[:, :1] + t * n[:, :1], xy[:, 1:] + t * n[:, 1:]
    h, w = image.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    p, q = y - i, x - j
    return image[i, j] * (1 - p) * (1 - q) + image[i + 1, j] * p * (1 - q) + image[i, j + 1] * (1 - p) * q + image[i + 1, j + 1] * p * q, t


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    p = np.pad(x, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, size), axis=1)


def diameters(image: np.ndarray, xy: np.ndarray, guess: float, average: int = 3, step: float = 0.5, every: int = 2, without: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """width (at half depth), fitted, blur, explained and valid at each point of a curve.

    Profiles are averaged over neighbours. Valid: both widths there, the fit explains 0.8, no place of ``without`` within
    the guessed diameter, and within 35 % and a pixel of the running median.
    """
    p, t = across(image, xy, max(8.0, 1.6 * guess), step)
    if average:
        pad = np.pad(p, ((average, average), (0, 0)), mode="edge")
        p = np.lib.stride_tricks.sliding_window_view(pad, 2 * average + 1, axis=0).mean(-1)
    n = len(xy)
    at = np.unique(np.append(np.arange(0, n, every), n - 1))
    got = np.full((4, len(at)), np.nan)
    for k, i in enumerate(at):
        w, c, _ = half_width(p[i], t)
        q, r2 = fit_box(p[i], t, w if w == w else guess, c if c == c else 0.0)
        got[:, k] = w, q[4], q[5], r2
    out = {}
    for name, v in zip(("width", "fitted", "blur", "explained"), got, strict=True):
        ok = np.isfinite(v)
        full = np.interp(np.arange(n), at[ok], v[ok]) if ok.sum() >= 2 else np.full(n, np.nan)
        gap = np.interp(np.arange(n), at, (~ok).astype(float)) > 0
        out[name] = np.where(gap, np.nan, full)
    valid = np.isfinite(out["width"]) & np.isfinite(out["fitted"]) & (out["explained"] > 0.8)
    for x, y in [] if without is None else without:
        valid &= np.hypot(xy[:, 0] - x, xy[:, 1] - y) > max(guess, 5)
    if valid.sum() > 5:
        med = running_median(np.where(valid, out["width"], np.median(out["width"][valid])), 15)
        valid &= np.abs(out["width"] - med) < 0.35 * med + 1
    return out | {"valid": valid}


def despiked(xy: np.ndarray, most: float = 110.0) -> np.ndarray:
    """Points without those at which the way turns back by over ``most`` degrees, the sharpest first, until none is left."""
    while len(xy) > 2:
        d = np.diff(xy, axis=0)
        size = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)
        turn = np.degrees(np.arccos(np.clip((d[:-1] * d[1:]).sum(1) / (size[:-1] * size[1:]), -1, 1)))
        k = int(np.argmax(turn))
        if turn[k] <= most:
            break
        xy = np.delete(xy, k + 1, axis=0)
    return xy


def tracked(strength: np.ndarray, start: tuple[float, float], heading: float, step: float = 1.0, swing: float = 0.35, least: float = 0.1, most: int = 200) -> np.ndarray:
    """A path from ``start`` (y, x) on: each step takes the strongest of eleven headings within ``swing`` of the last one, while it is strong enough."""
    y, x = start
    path, (h, w) = [(y, x)], strength.shape
    while len(path) < most:
        a = heading + np.linspace(-swing, swing, 11)
        yy, xx = y + step * np.sin(a), x + step * np.cos(a)
        ok = (yy >= 0) & (xx >= 0) & (yy <= h - 1) & (xx <= w - 1)
        if not ok.any():
            break
        i, j = np.clip(yy.astype(int), 0, max(h - 2, 0)), np.clip(xx.astype(int), 0, max(w - 2, 0))
        p, q = yy - i, xx - j
        i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
        v = strength[i, j] * (1 - p) * (1 - q) + strength[i1, j] * p * (1 - q) + strength[i, j1] * (1 - p) * q + strength[i1, j1] * p * q
        v = np.where(ok, np.round(v, 9) - 1e-6 * np.abs(a - heading), -np.inf)
        k = int(np.argmax(v))
        if v[k] < least:
            break
        y, x, heading = float(yy[k]), float(xx[k]), float(a[k])
        path.append((y, x))
    return np.array(path)


def render_line(shape: tuple[int, int], q: np.ndarray, cell: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Optical density of one straight vessel, and its derivatives by q: angle, distance from the middle, log width, strength."""
    h, w = shape
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = (y - (h - 1) / 2) * cell, (x - (w - 1) / 2) * cell
    c, s = math.cos(q[0]), math.sin(q[0])
    d, along, width = -x * s + y * c - q[1], x * c + y * s, math.exp(q[2])
    g = np.exp(-0.5 * (d / width) ** 2)
    by_d = -q[3] * g * d / width**2
    return q[3] * g, np.stack([-by_d * along, -by_d, q[3] * g * (d / width) ** 2, g], axis=-1)


def fit_line(image: np.ndarray, rounds: int = 40, frozen: bool = False, q: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(parameters of ``render_line``, squared error per pixel): on block means first, then on pixels; ``frozen`` keeps the place.

    The start is the best of twelve angles and five distances. Widths stay between half a pixel and a quarter of the picture.
    """
    stages = [(image, 1.0)]
    if min(image.shape) >= 8 and q is None:
        h, w = image.shape[0] // 2, image.shape[1] // 2
        stages.insert(0, (image[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3)), 2.0))
    reach = min(image.shape) / 2
    if q is None:
        a, cell = stages[0]
        best = None
        for angle in np.pi * np.arange(12) / 12:
            for off in reach * np.linspace(-0.6, 0.6, 5):
                g = render_line(a.shape, np.array([angle, off, math.log(1.5), 1.0]), cell)[0]
                s = max(float((g * a).sum() / (g * g).sum()), 0.0)
                e = float(((a - s * g) ** 2).sum())
                if best is None or e < best[0] - 1e-12:
                    best = (e, np.array([angle, off, math.log(1.5), s]))
        q = best[1]
    free = np.array([2, 3]) if frozen else np.arange(4)
    for a, cell in stages:
        damp = 1e-2
        f, j = render_line(a.shape, q, cell)
        cost = float(((a - f) ** 2).sum())
        for _ in range(rounds):
            jj, r = j.reshape(-1, 4)[:, free], (a - f).ravel()
            m = jj.T @ jj
            trial = q.copy()
            trial[free] += np.linalg.solve(m + damp * (np.diag(np.diag(m)) + 1e-9 * np.eye(len(free))), jj.T @ r)
            trial[1], trial[2], trial[3] = np.clip(trial[1], -reach, reach), np.clip(trial[2], math.log(0.5), math.log(reach / 2)), max(trial[3], 0.0)
            ft, jt = render_line(a.shape, trial, cell)
            new = float(((a - ft) ** 2).sum())
            if new < cost:
                done = cost - new < 1e-10 * max(cost, 1e-12)
                q, f, j, cost, damp = trial, ft, jt, new, damp / 4
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e9:
                    break
    return q, cost / image.size
