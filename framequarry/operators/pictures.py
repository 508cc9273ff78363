"""numpy kernels on stacks of pictures (n, h, w), and the Arrow plumbing that runs one over a table of pictures.

Pictures of one shape are worked on together; a batch holds at most CELLS numbers. NaN is no data and null outside.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a stack that is worked on at once.
CELLS = 1 << 21


def run(df: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys and ``schema`` of df (keys, height, width, v: numbers row by row): what ``work`` gives for a stack of pictures.

    ``work`` returns a row of numbers or a picture for each input picture. Pictures that do not fit their height and
    width have nulls; null numbers are NaN inside, NaN is null outside.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    lists = ["array" in c for c in schema.split(",")]
    whole = [("int" in c or "long" in c) for c in schema.split(",")]

    def column(rows: list, k: int) -> pa.Array:
        if lists[k]:
            return pa.array([None if r is None else [None if x != x else float(x) for x in np.ravel(r)] for r in rows], pa.list_(pa.float64()))
        if whole[k]:
            return pa.array([None if r is None else int(r) for r in rows], pa.int64())
        return pa.array([None if r is None or r != r else float(r) for r in rows], pa.float64())

    def task(batches):
        for batch in batches:
            n = batch.num_rows
            hs, ws = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            vs = batch.column(len(keys) + 2).to_pylist()
            out: list[list] = [[None] * n for _ in names]
            shapes: dict[tuple, list[int]] = {}
            for k, (h, w, v) in enumerate(zip(hs, ws, vs, strict=True)):
                if v is not None and h and w and len(v) == h * w:
                    shapes.setdefault((h, w), []).append(k)
            for (h, w), members in shapes.items():
                step = max(1, CELLS // (h * w))
                for a in range(0, len(members), step):
                    part = members[a : a + step]
                    got = work(np.array([vs[k] for k in part], np.float64).reshape(len(part), h, w))
                    for c, name in enumerate(names):
                        for i, k in enumerate(part):
                            out[c][k] = got[name][i]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(column(rows, k) for k, rows in enumerate(out))], names=[*keys, *names])

    types = dict(df.dtypes)
    full = ", ".join([f"`{k}` {types[k]}" for k in keys] + [c.strip().replace(" int", " long") for c in schema.split(",")])
    return df.select(*keys, F.col("height").cast("int"), F.col("width").cast("int"), F.col("v").cast("array<double>")).mapInArrow(task, full)


def _index(n: int, r: int, border: str) -> np.ndarray:
    """Indices of n places with r more at either end: mirrored without the edge, or the edge repeated."""
    at = np.arange(-r, n + r)
    if border == "mirror":
        at = np.abs(at) % max(2 * (n - 1), 1)
        return np.where(at > n - 1, 2 * (n - 1) - at, at)
    return np.clip(at, 0, n - 1)


def padded(a: np.ndarray, r: int, border: str = "mirror") -> np.ndarray:
    return a[:, _index(a.shape[1], r, border)][:, :, _index(a.shape[2], r, border)]


def gaussian_weights(sigma: float, r: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def blur(a: np.ndarray, sigma: float, r: int) -> np.ndarray:
    """Separable Gaussian of radius r, border mirrored without the edge."""
    k, p = gaussian_weights(sigma, r), padded(a, r)
    p = sum(w * p[:, i : i + a.shape[1]] for i, w in enumerate(k))
    return sum(w * p[:, :, i : i + a.shape[2]] for i, w in enumerate(k))


def blur_valid(a: np.ndarray, sigma: float, r: int) -> np.ndarray:
    """Gaussian mean of what has data; NaN where nothing within reach has."""
    ok = np.isfinite(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = blur(ok.astype(float), sigma, r)
        return np.where(weight > 0, blur(np.where(ok, a, 0), sigma, r) / weight, np.nan)


def windows(a: np.ndarray, r: int = 1, border: str = "edge") -> np.ndarray:
    """The (2r + 1) squared neighbours of every pixel, as a last axis."""
    p, (n, h, w) = padded(a, r, border), a.shape
    return np.stack([p[:, y : y + h, x : x + w] for y in range(2 * r + 1) for x in range(2 * r + 1)], axis=-1)


def window_inside(a: np.ndarray) -> np.ndarray:
    """The nine neighbours; NaN beyond the border."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
    return np.stack([p[:, y : y + a.shape[1], x : x + a.shape[2]] for y in range(3) for x in range(3)], axis=-1)


def laplacian(a: np.ndarray) -> np.ndarray:
    """Second differences, border repeated."""
    p = padded(a, 1, "edge")
    return p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * a


def frame_statistics(a: np.ndarray, full: float) -> dict:
    """log_sharpness (of the variance of second differences), brightness, clipped (share at or over ``full``)."""
    axes = (1, 2)
    return {"log_sharpness": np.log(np.maximum(laplacian(a).var(axis=axes), 1e-12)), "brightness": a.mean(axis=axes), "clipped": (a >= full).mean(axis=axes)}


def block_means(a: np.ndarray, k: int) -> np.ndarray:
    n, h, w = a.shape
    return a[:, : h // k * k, : w // k * k].reshape(n, h // k, k, w // k, k).mean(axis=(2, 4))


def second_derivatives(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """yy, xx, yx by central differences, border repeated."""
    p = padded(a, 1, "edge")
    yy = p[:, 2:, 1:-1] - 2 * a + p[:, :-2, 1:-1]
    xx = p[:, 1:-1, 2:] - 2 * a + p[:, 1:-1, :-2]
    return yy, xx, (p[:, 2:, 2:] - p[:, 2:, :-2] - p[:, :-2, 2:] + p[:, :-2, :-2]) / 4


def eigenvalues(a: np.ndarray, sigma: float, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Second derivative along and across the strongest bend of the blurred picture, times sigma squared: (small, big)."""
    yy, xx, yx = second_derivatives(blur(a, sigma, r))
    half, root = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
    low, high = (half - root) * sigma**2, (half + root) * sigma**2
    first = np.abs(low) > np.abs(high)
    return np.where(first, high, low), np.where(first, low, high)


def ridges(a: np.ndarray, scales: tuple[tuple[float, int], ...], contrast: np.ndarray, beta: float = 0.5) -> np.ndarray:
    """Strength of dark ridges, 0 to 1, the largest of all scales; ``contrast`` is one number a picture, the same for a recording."""
    best = np.zeros(a.shape)
    for sigma, r in scales:
        small, big = eigenvalues(a, sigma, r)
        across = (small / np.where(big == 0, 1, big)) ** 2
        power = big**2 + small**2
        v = np.exp(-across / (2 * beta**2)) * (1 - np.exp(-power / (2 * contrast[:, None, None] ** 2)))
        best = np.maximum(best, np.where(big > 0, v, 0))
    return best


def disc(r: float) -> list[tuple[int, int]]:
    k = int(r)
    return [(y, x) for y in range(-k, k + 1) for x in range(-k, k + 1) if y * y + x * x <= r * r]


def dilate(m: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    k = max(abs(c) for p in shape for c in p)
    p, (_, h, w) = np.pad(m, ((0, 0), (k, k), (k, k))), m.shape
    return np.logical_or.reduce([p[:, k + y : k + y + h, k + x : k + x + w] for y, x in shape])


def erode(m: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    return ~dilate(~m, shape)


SQUARE = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]


def grown(seed: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Allowed pixels that 8-neighbours connect with a seed."""
    seed = seed & allowed
    while True:
        more = dilate(seed, SQUARE) & allowed
        if (more == seed).all():
            return seed
        seed = more


def labelled(m: np.ndarray) -> np.ndarray:
    """Smallest place (row by row, from 1) of each pixel's component of 8 neighbours; 0 outside."""
    n, h, w = m.shape
    far = h * w + 1
    out = np.where(m, np.arange(1, h * w + 1).reshape(1, h, w), far)
    while True:
        p = np.pad(out, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        best = np.minimum.reduce([p[:, 1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in SQUARE])
        best = np.where(m, best, far)
        if (best == out).all():
            return np.where(m, out, 0)
        out = best


def distance(m: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest one that is false; NaN where none is."""
    n, h, w = m.shape
    y, x, far = np.arange(h)[None, :, None], np.arange(w)[None, None, :], np.inf
    base = np.where(m, far, 0.0)
    g = np.full(m.shape, far)
    for k in range(h):
        g = np.minimum(g, base[:, k : k + 1, :] + (y - k) ** 2)
    out = np.full(m.shape, far)
    for k in range(w):
        out = np.minimum(out, g[:, :, k : k + 1] + (x - k) ** 2)
    return np.where(np.isinf(out), np.nan, np.sqrt(out))


def warped(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Picture at (x, y) is the old one at the place that the 3 x 3 map m sends (x, y) to, bilinear; NaN outside."""
    n, h, w = a.shape
    y, x = np.mgrid[:h, :w].astype(float)
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    return sampled(a, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d)


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear at the places (y, x), the same for all pictures; NaN outside."""
    n, h, w = a.shape
    ok = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
    i = np.clip(np.floor(y).astype(int), 0, max(h - 2, 0))
    j = np.clip(np.floor(x).astype(int), 0, max(w - 2, 0))
    p, q = y - i, x - j
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    v = a[:, i, j] * (1 - p) * (1 - q) + a[:, i1, j] * p * (1 - q) + a[:, i, j1] * (1 - p) * q + a[:, i1, j1] * p * q
    return np.where(ok, v, np.nan)


def cubic(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bicubic (a = -0.75) at the places (y, x); the border is repeated."""
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)

    def weights(t):
        """Of the four pixels around."""
        u = 1 - t
        near = lambda d: (1.25 * d - 2.25) * d * d + 1
        far = lambda d: ((-0.75 * d + 3.75) * d - 6) * d + 3
        return far(t + 1), near(t), near(u), far(u + 1)

    n, h, w = a.shape
    wide = np.pad(a, ((0, 0), (3, 3), (3, 3)), mode="edge").reshape(n, -1)
    # the first of the sixteen pixels; the others stand at fixed distances from it
    first = (np.clip(i, -2, h) + 2) * (w + 6) + np.clip(j, -2, w) + 2
    wy, wx, out = weights(y - i), weights(x - j), 0.0
    for r in range(4):
        line = 0.0
        for c in range(4):
            line = line + wx[c] * wide[:, r * (w + 6) + c :].take(first, axis=1)
        out = out + wy[r] * line
    return out


def moved(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a moved by whole pixels; NaN where it was not seen."""
    n, h, w = a.shape
    out = np.full(a.shape, np.nan)
    out[:, max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = a[:, max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def line_kernels(sigma: float, stretch: float, r: int, angles: int) -> np.ndarray:
    """(angles, 2r + 1, 2r + 1): second derivative across, Gaussian along a line of each angle; mean 0, squares sum to 1."""
    y, x = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    out = []
    for k in range(angles):
        t = np.pi * k / angles
        along, across = x * np.cos(t) + y * np.sin(t), -x * np.sin(t) + y * np.cos(t)
        g = (across**2 / sigma**2 - 1) * np.exp(-0.5 * (across**2 / sigma**2 + along**2 / (stretch * sigma) ** 2))
        g -= g.mean()
        out.append(g / np.sqrt((g * g).sum()))
    return np.array(out)


def oriented(a: np.ndarray, kernels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest response of the kernels at each pixel and which one, the first of equals; border mirrored."""
    r = kernels.shape[1] // 2
    w = windows(a, r, "mirror")
    answers = np.einsum("nhwk,ak->nhwa", w, kernels.reshape(len(kernels), -1))
    best = np.argmax(np.round(answers, 9), axis=-1)
    return np.take_along_axis(answers, best[..., None], -1)[..., 0], best


def crest(strength: np.ndarray, which: np.ndarray, angles: int) -> np.ndarray:
    """Pixels stronger than both neighbours across their own line (beyond the border nothing is stronger)."""
    p = np.pad(strength, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    t = np.pi * np.arange(angles) / angles
    dy, dx = np.rint(np.round(np.cos(t), 9)).astype(int), np.rint(np.round(-np.sin(t), 9)).astype(int)
    n, h, w = strength.shape
    i, y, x = np.ogrid[:n, :h, :w]
    ahead = p[i, y + 1 + dy[which], x + 1 + dx[which]]
    behind = p[i, y + 1 - dy[which], x + 1 - dx[which]]
    return (strength > ahead) & (strength >= behind)


def nan_median(a: np.ndarray) -> np.ndarray:
    """Median of the neighbours that have data; gaps are filled from theirs."""
    w = window_inside(a)
    empty = ~np.isfinite(w).any(-1)
    w = np.where(empty[..., None], 0.0, w)
    return np.where(empty, np.nan, np.nanmedian(w, axis=-1))


def thinned(m: np.ndarray) -> np.ndarray:
    """One-pixel skeletons: border pixels go in two half steps as long as no component breaks."""
    a = np.pad(m.astype(np.int8), ((0, 0), (1, 1), (1, 1)))
    core = a[:, 1:-1, 1:-1]
    while True:
        before = a.sum()
        for half in (0, 1):
            p = [a[:, 1 + y : a.shape[1] - 1 + y, 1 + x : a.shape[2] - 1 + x] for y, x in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            n = sum(x.astype(int) for x in p)
            turns = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            free = (north * east * south == 0) & (east * south * west == 0) if not half else (north * east * west == 0) & (north * south * west == 0)
            core[(core == 1) & (n >= 2) & (n <= 6) & (turns == 1) & free] = 0
        if a.sum() == before:
            return core.astype(bool)


def smooth_surface(a: np.ndarray, weight: np.ndarray, stiffness: float, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """The picture x of least weight * (x - a)^2 + stiffness * (second differences of x)^2, by conjugate gradients.

    Where the weight is 0 there is no data, and x is as straight as it can be.
    """
    a, weight = np.where(np.isfinite(a), a, 0.0), np.where(np.isfinite(a), weight, 0.0)

    def bend(x):
        return np.diff(x, 2, axis=1), np.diff(x, 2, axis=2), np.diff(np.diff(x, axis=1), axis=2)

    def unbend(yy, xx, yx):
        out = np.zeros(a.shape)
        out[:, :-2] += yy
        out[:, 1:-1] -= 2 * yy
        out[:, 2:] += yy
        out[:, :, :-2] += xx
        out[:, :, 1:-1] -= 2 * xx
        out[:, :, 2:] += xx
        out[:, :-1, :-1] += 2 * yx
        out[:, 1:, :-1] -= 2 * yx
        out[:, :-1, 1:] -= 2 * yx
        out[:, 1:, 1:] += 2 * yx
        return out

    apply = lambda x: weight * x + stiffness * unbend(*bend(x))
    dot = lambda p, q: (p * q).sum(axis=(1, 2), keepdims=True)
    x = np.zeros(a.shape) + dot(weight, a) / np.maximum(weight.sum(axis=(1, 2), keepdims=True), 1e-12)
    r = weight * a - apply(x)
    p, rr = r.copy(), dot(r, r)
    for _ in range(rounds):
        if (rr <= tolerance**2).all():
            break
        ap = apply(p)
        step = rr / np.maximum(dot(p, ap), 1e-300)
        x, r = x + step * p, r - step * ap
        new = dot(r, r)
        p, rr = r + new / np.maximum(rr, 1e-300) * p, new
    return x


def upper_envelope(a: np.ndarray, block: int, stiffness: float) -> np.ndarray:
    """A smooth surface through the largest value of each block."""
    n, h, w = a.shape
    tiles = a.reshape(n, h // block, block, w // block, block).transpose(0, 1, 3, 2, 4).reshape(n, h // block, w // block, -1)
    top = np.nanmax(tiles, axis=-1)
    at = np.repeat(np.repeat(top, block, axis=1), block, axis=2)
    return smooth_surface(at, (a >= at).astype(float), stiffness)


def background(a: np.ndarray, block: int, stiffness: float, rounds: int = 3, cutoff: float = 2.0) -> np.ndarray:
    """Background of logs: the upper envelope first, then refits to pixels that are not darker than their spread allows."""
    b = upper_envelope(a, block, stiffness)
    for _ in range(rounds):
        d = b - a
        mid = np.median(d, axis=(1, 2), keepdims=True)
        spread = 1.4826 * np.median(np.abs(d - mid), axis=(1, 2), keepdims=True) + 1e-9
        b = smooth_surface(a, (np.abs(d - mid) <= cutoff * spread).astype(float), stiffness)
    return b
