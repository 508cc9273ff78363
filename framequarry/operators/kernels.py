"""numpy kernels on pixels and profiles, in Arrow batches: spectra, sub-pixel peaks, filters, frame scores."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small


def subpixel_peak(c: np.ndarray, at: int) -> float:
    """Place of the parabola's top through a peak and its (circular) neighbours."""
    n = len(c)
    a, b, d = c[(at - 1) % n], c[at], c[(at + 1) % n]
    bend = a - 2 * b + d
    return at + (0.5 * (a - d) / bend if bend < 0 else 0.0)


def phase_shift_1d(ref: np.ndarray, row: np.ndarray, alpha: float = 0.5) -> tuple[float, float]:
    """Shift of ``row`` against ``ref`` and the peak's height; the cross spectrum is whitened to the power alpha."""
    x = np.conj(np.fft.rfft(ref - ref.mean())) * np.fft.rfft(row - row.mean())
    size = np.abs(x)
    x = np.where(size > 1e-12, x / np.maximum(size, 1e-12) ** alpha, 0)
    c = np.fft.irfft(x, len(ref))
    k = int(np.argmax(c))
    shift = subpixel_peak(c, k)
    return (shift - len(ref) if shift > len(ref) / 2 else shift), float(c[k])


@lru_cache(32)
def _hann(h: int, v: int) -> np.ndarray:
    return np.outer(np.hanning(h), np.hanning(v))


@lru_cache(32)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n frequencies of a spectrum, and their waves at -1 to 1 by 1/20."""
    fine, f = np.arange(-20, 21) / 20, np.fft.fftfreq(n)
    return fine, f, np.exp(2j * np.pi * np.outer(fine, f))


def _around(x: np.ndarray, v: int, y: int, z: int) -> np.ndarray:
    """Real part of the sum over the whole spectrum, of which x is the half that rfft2 gives, by 1/20 pixel around (y, z); not divided by its size.

    Highest frequencies count with the sign that fftfreq gives them.
    """
    h, half = x.shape
    (fine, fy, wy), (_, fx, wx) = _waves(h), _waves(v)
    ey, ex = wy * np.exp(2j * np.pi * y * fy), wx[:, :half] * np.exp(2j * np.pi * z * fx[:half])
    ex[:, 1 : (v + 1) // 2] *= 2  # these stand for their mirrored ones as well
    if h % 2 == 0:
        ey[:, h // 2] = ey[:, h // 2].real
    up = (ey @ x @ ex.T).real
    if h % 2 == 0 and v % 2 == 0:
        up -= x[h // 2, -1].real * np.outer(np.sin(np.pi * (y + fine)), np.sin(np.pi * (z + fine)))
    return up


def phase_shift_2d(ref: np.ndarray, img: np.ndarray, alpha: float = 0.5, window: bool = True) -> tuple[float, float, float]:
    """dy, dx of ``img`` against ``ref`` and the peak's height, with a Hann window against the border.

    The whole-pixel peak is refined on a grid of 1/20 pixel, where the correlation is summed from its spectrum.
    """
    h, v = ref.shape
    w = _hann(h, v) if window else 1.0
    x = np.conj(np.fft.rfft2((ref - ref.mean()) * w)) * np.fft.rfft2((img - img.mean()) * w)
    size = np.abs(x)
    x *= np.where(size > 1e-12, 1 / np.maximum(size, 1e-12) ** alpha, 0) if alpha != 0.5 else np.where(size > 1e-12, 1 / np.sqrt(np.maximum(size, 1e-12)), 0)
    c = np.fft.irfft2(x, (h, v))
    y, z = np.unravel_index(int(np.argmax(c)), c.shape)
    fine, up = _waves(h)[0], _around(x, v, int(y), int(z))
    p, q = np.unravel_index(int(np.argmax(up)), up.shape)
    dy, dx = y + fine[p], z + fine[q]
    if 0 < p < 40 and 0 < q < 40:
        dy, dx = dy + (subpixel_peak(up[:, q], p) - p) / 20, dx + (subpixel_peak(up[p], q) - q) / 20
    return float(dy - h if dy > h / 2 else dy), float(dx - v if dx > v / 2 else dx), float(c[y, z])


def laplacian(a: np.ndarray) -> np.ndarray:
    """Second differences, border repeated."""
    p = np.pad(np.asarray(a, np.float64), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared pixels, border repeated."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(np.asarray(a, np.float64), pad, mode="edge"), axis=axis)
        n = a.shape[axis]
        a = (np.take(s, np.arange(2 * r + 1, n + 2 * r + 1), axis) - np.take(s, np.arange(n), axis)) / (2 * r + 1)
    return a


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius 4 sigma, border mirrored."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    a = np.asarray(a, np.float64)
    for axis in range(a.ndim):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="symmetric")
        at = lambda i, n: p[tuple(slice(i, i + n) if d == axis else slice(None) for d in range(p.ndim))]  # noqa: B023, E731
        a = sum(w * at(i, a.shape[axis]) for i, w in enumerate(k))
    return a


def vesselness(a: np.ndarray, sigmas: tuple[float, ...], dark: bool = True) -> np.ndarray:
    """Ridge strength from the eigenvalues of the second derivatives, the largest of all scales; 0 to 1."""
    best = np.zeros(a.shape)
    for s in sigmas:
        g = gaussian(a, s)
        gy, gx = np.gradient(g)
        yy, yx = np.gradient(gy)
        _, xx = np.gradient(gx)
        half, root = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
        l1, l2 = half - root, half + root
        big = np.where(np.abs(l1) > np.abs(l2), l1, l2) * s * s
        small = np.where(np.abs(l1) > np.abs(l2), l2, l1) * s * s
        across = (small / np.where(big == 0, 1, big)) ** 2
        power = np.hypot(big, small)
        c = power.max() / 2 or 1.0
        v = np.exp(-across / 0.5) * (1 - np.exp(-(power**2) / (2 * c * c)))
        best = np.maximum(best, np.where((big > 0) == dark, v, 0))
    return best


def ncc(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Correlation over pixels that both have; NaN is no data."""
    ok = np.isfinite(a) & np.isfinite(b) & (True if mask is None else mask)
    x, y = a[ok] - a[ok].mean() if ok.any() else a[ok], b[ok] - b[ok].mean() if ok.any() else b[ok]
    size = float(np.sqrt((x * x).sum() * (y * y).sum()))
    return float((x * y).sum()) / size if size > 0 else 0.0


def _frames(df: DataFrame, names: list[str], kinds: list[pa.DataType], schema: str, work) -> DataFrame:
    """df (burst, index, height, width, bit_depth, pixels) -> burst, index and what ``work(image, bits)`` gives."""

    def run(batches):
        for batch in small(batches):
            rows = []
            for h, w, bits, raw in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                ok = raw is not None and h and w and len(raw) == h * w * (2 if bits > 8 else 1)
                rows.append(work(np.frombuffer(raw, "<u2" if bits > 8 else np.uint8).reshape(h, w), bits) if ok else (None,) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]], names=["burst", "index", *names])

    return df.select("burst", "index", "height", "width", "bit_depth", "pixels").mapInArrow(run, f"burst string, index int, {schema}")


def frame_scores(frames: DataFrame) -> DataFrame:
    """burst, index, log_sharpness (of the variance of second differences), brightness, clipped_fraction."""

    def work(a, bits):
        full = (1 << bits) - 1
        x = a / full
        return float(np.log(max(laplacian(x).var(), 1e-12))), float(x.mean()), float((a >= full).mean())

    return _frames(frames, ["log_sharpness", "brightness", "clipped_fraction"], [pa.float64()] * 3, "log_sharpness double, brightness double, clipped_fraction double", work)


def phase_shift(df: DataFrame, ref: str, row: str, alpha: float = 0.5) -> DataFrame:
    """df with shift and response of array column ``row`` against ``ref``; null where lengths differ or are below 3."""
    import pyarrow

    kind = pa.struct([("shift", pa.float64()), ("response", pa.float64())])

    @F.arrow_udf("struct<shift: double, response: double>")
    def shifted(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            ok = x and y and len(x) == len(y) and len(x) > 2 and None not in x and None not in y
            got = phase_shift_1d(np.array(x), np.array(y), alpha) if ok else (None, None)
            out.append({"shift": got[0], "response": got[1]})
        return pyarrow.array(out, kind)

    return df.withColumn("_p", shifted(F.col(ref), F.col(row))).select("*", "_p.*").drop("_p")


def fwhm(profile: np.ndarray) -> tuple[float, float]:
    """(width at half depth, centre) of the dark dip around a profile's middle, between samples; NaN where it is open."""
    p = np.asarray(profile, float)
    mid = len(p) // 2
    lo = max(0, mid - len(p) // 4)
    k = lo + int(np.argmin(p[lo : mid + len(p) // 4 + 1]))
    base = float(np.median(np.concatenate([p[: max(1, len(p) // 6)], p[-max(1, len(p) // 6) :]])))
    half = (base + p[k]) / 2
    left = next((i + (half - p[i]) / (p[i + 1] - p[i]) for i in range(k - 1, -1, -1) if p[i] >= half > p[i + 1]), np.nan)
    right = next((i - 1 + (half - p[i - 1]) / (p[i] - p[i - 1]) for i in range(k + 1, len(p)) if p[i] >= half > p[i - 1]), np.nan)
    return float(right - left), float((right + left) / 2)


def resampled(xy: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc length along a polyline."""
    s = np.append(0, np.cumsum(np.hypot(*np.diff(xy, axis=0).T)))
    at = np.linspace(0, s[-1], n)
    return np.column_stack([np.interp(at, s, xy[:, 0]), np.interp(at, s, xy[:, 1])])


def curvature(xy: np.ndarray) -> np.ndarray:
    """Signed curvature at the points of a curve, by differences along its own parameter."""
    d = np.gradient(xy, axis=0)
    dd = np.gradient(d, axis=0)
    return (d[:, 0] * dd[:, 1] - d[:, 1] * dd[:, 0]) / np.maximum(np.hypot(d[:, 0], d[:, 1]) ** 3, 1e-12)


def strip(image: np.ndarray, xy: np.ndarray, half: int) -> np.ndarray:
    """Pixels across a curve: one row a point, 2 * half + 1 places along its normal; NaN outside the picture."""
    from .masks import sampled

    d = np.gradient(xy, axis=0)
    n = np.column_stack([-d[:, 1], d[:, 0]]) / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)[:, None]
    off = np.arange(-half, half + 1)
    return sampled(image, xy[:, 1:2] + n[:, 1:2] * off, xy[:, 0:1] + n[:, 0:1] * off)
