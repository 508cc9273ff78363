"""Velocity along a vessel from its kymograph: three estimators that must agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import gaussian, subpixel_peak

#: Estimators agree within this relative difference plus slack (places a row).
TOLERANCE, SLACK = 0.35, 0.3


def centred(k: np.ndarray) -> np.ndarray:
    """Rows and columns less their means, unit spread; no data counts as the mean."""
    a = k - np.nanmean(k)
    a = a - np.nanmean(a, axis=1, keepdims=True)
    a = np.nan_to_num(a - np.nanmean(a, axis=0, keepdims=True))
    return a / max(a.std(), 1e-12)


def by_lag(a: np.ndarray, lag: int) -> float:
    """Mean cross-correlation of rows with those ``lag`` later; its peak's shift a row."""
    n = a.shape[1]
    f = np.fft.rfft(a, 2 * n, axis=1)
    c = np.fft.irfft((np.conj(f[:-lag]) * f[lag:]).mean(0), 2 * n)
    k = int(np.argmax(c))
    s = subpixel_peak(c, k)
    return (s - 2 * n if s > n else s) / lag


def by_structure(a: np.ndarray) -> float:
    """Slope of the stripes from the structure tensor."""
    gt, gs = np.gradient(gaussian(a, 1.0))
    jtt, jss, jts = (gt * gt).mean(), (gs * gs).mean(), (gt * gs).mean()
    angle = 0.5 * np.arctan2(2 * jts, jss - jtt)
    return float(-np.tan(angle))


def by_radon(a: np.ndarray, speeds: np.ndarray) -> float:
    """The speed whose shear makes the columns differ most."""
    t, s = np.arange(a.shape[0])[:, None], np.arange(a.shape[1])[None]
    score = []
    for v in speeds:
        at = s + v * t
        inside = (at >= 0) & (at <= a.shape[1] - 1)
        lo = np.clip(at.astype(int), 0, a.shape[1] - 2)
        w = at - lo
        x = np.where(inside, np.take_along_axis(a, lo, 1) * (1 - w) + np.take_along_axis(a, lo + 1, 1) * w, 0)
        n = inside.sum(0)
        score.append(float(((x.sum(0) / np.maximum(n, 1)) ** 2 * n).sum() / max(n.sum(), 1)))
    return float(speeds[int(np.argmax(score))])


def estimate(k: np.ndarray) -> tuple[float, float, int, bool]:
    """velocity (places a row), spread of the estimators, how many agree, reliable (two of three, quality enough)."""
    a = centred(k)
    lag = by_lag(a, 1)
    around = np.unique(np.concatenate([np.linspace(-6, 6, 121), lag + np.linspace(-0.5, 0.5, 11)]))
    all_ = np.array([lag, by_radon(a, around), by_structure(a)])
    mid = float(np.median(all_))
    agree = np.abs(all_ - mid) <= TOLERANCE * abs(mid) + SLACK
    quality = float(np.corrcoef(a[:-1].ravel(), np.roll(a, -int(round(mid)), axis=1)[1:].ravel())[0, 1])
    return float(all_[agree].mean()), float(all_.std()), int(agree.sum()), bool(agree.sum() >= 2 and quality > 0.15)


def velocities(kymographs: DataFrame) -> DataFrame:
    """vessel, velocity, spread, agree, reliable of kymographs in long form (vessel, t, s, k; null: no data).

    A vessel's kymograph is one group: as large as its frames times its length. Fewer than 8 rows or places give nulls.
    """

    def run(table: pa.Table) -> pa.Table:
        t, s = table.column("t").to_numpy(), table.column("s").to_numpy()
        k = np.full((int(t.max() - t.min()) + 1, int(s.max() - s.min()) + 1), np.nan)
        k[t - t.min(), s - s.min()] = table.column("k").to_numpy(zero_copy_only=False).astype(float)
        got = estimate(k) if min(k.shape) >= 8 and np.isfinite(k).any() else (None, None, None, None)
        kinds = (pa.float64(), pa.float64(), pa.int32(), pa.bool_())
        cols = [pa.array([g], x) for g, x in zip(got, kinds, strict=True)]
        return pa.Table.from_arrays([pa.array([table.column("vessel")[0].as_py()], pa.string()), *cols], names=["vessel", "velocity", "spread", "agree", "reliable"])

    long = kymographs.selectExpr("cast(vessel as string) as vessel", "cast(t as bigint) as t", "cast(s as bigint) as s", "cast(k as double) as k").filter("t is not null and s is not null")
    return long.groupBy("vessel").applyInArrow(run, "vessel string, velocity double, spread double, agree int, reliable boolean")


def series(k: np.ndarray, window: int, step: int, lag: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(middle row, velocity) of sliding windows of rows, by correlation at a lag."""
    a = centred(k)
    starts = np.arange(0, len(a) - window + 1, step)
    return starts + window / 2, np.array([by_lag(a[s : s + window], lag) for s in starts])


def best_lag(k: np.ndarray, most: int) -> int:
    """The longest lag whose correlation peak is still half of that of lag 1: slow flow is measured better over more rows."""
    a, n, out = centred(k), k.shape[1], 1
    f = np.fft.rfft(a, 2 * n, axis=1)
    peak = [float(np.fft.irfft((np.conj(f[:-g]) * f[g:]).mean(0), 2 * n).max()) for g in range(1, most + 1)]
    for g in range(2, most + 1):
        if peak[g - 1] < 0.5 * peak[0]:
            break
        out = g
    return out


def time_of_flight(k: np.ndarray, gap: int, most: int) -> float:
    """Velocity from the delay between places ``gap`` apart: the median over places of gap / delay, sub-row."""
    a, out = centred(k), []
    n = len(a)
    for s in range(0, a.shape[1] - gap, gap):
        c = np.fft.irfft(np.conj(np.fft.rfft(a[:, s], 2 * n)) * np.fft.rfft(a[:, s + gap], 2 * n), 2 * n)
        at = np.concatenate([np.arange(-most, 0), np.arange(1, most + 1)])
        d = int(at[int(np.argmax(c[at]))])
        delay = subpixel_peak(c, d % (2 * n)) - (2 * n if d < 0 else 0)
        if abs(delay) > 0.3:
            out.append(gap / delay)
    return float(np.median(out)) if out else float("nan")


def pulsatility(v: np.ndarray, rate: float, low: float, high: float) -> tuple[float, float]:
    """(dominant frequency in the band, (max - min) / mean) of a velocity series sampled ``rate`` times a second."""
    v = v[np.isfinite(v)]
    if len(v) < 8:
        return float("nan"), float("nan")
    power = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v)))) ** 2
    f = np.fft.rfftfreq(len(v), 1 / rate)
    band = (f >= low) & (f <= high)
    mean = abs(v.mean())
    return (float(f[band][int(np.argmax(power[band]))]) if band.any() else float("nan")), (float((v.max() - v.min()) / mean) if mean > 0 else float("nan"))


def multi_scale(k: np.ndarray, scales: tuple[int, ...] = (1, 3, 9)) -> tuple[float, int]:
    """(velocity, scale): rows binned by each scale; the first whose shift a row is between 1/2 and a quarter of the places."""
    got = []
    for s in scales:
        n = len(k) // s
        if n < 8:
            break
        a = centred(np.nanmean(k[: n * s].reshape(n, s, -1), axis=1))
        got.append((by_lag(a, 1), s))
    fits = [(v / s, s) for v, s in got if 0.5 <= abs(v) <= k.shape[1] / 4]
    return fits[0] if fits else (got[0][0] / got[0][1], got[0][1])


def beats_chance(k: np.ndarray, v: float, shuffles: int = 20, seed: int = 0) -> bool:
    """Whether rows sheared by v agree better than rows in any shuffled order."""
    a, rng = centred(k), np.random.default_rng(seed)

    def score(x: np.ndarray) -> float:
        s = np.arange(x.shape[1])
        return float(np.mean([np.mean(x[t] * np.interp(s + v, s, x[t + 1], left=0, right=0)) for t in range(len(x) - 1)]))

    own = score(a)
    return all(own > score(a[rng.permutation(len(a))]) for _ in range(shuffles))


def without_static(k: np.ndarray) -> np.ndarray:
    """Each row less what its offset and the mean row explain; NaN is no data. Rows with too little data are NaN."""
    mean = np.nanmean(k, axis=0)
    mean = np.where(np.isfinite(mean), mean, np.nanmean(mean))
    x = mean - mean.mean()
    ok = np.isfinite(k)
    n = ok.sum(1)
    at = lambda v: np.where(ok, v, 0).sum(1)
    sx, sy, sxx, sxy = at(x[None]), at(np.nan_to_num(k)), at((x * x)[None]), at(np.nan_to_num(k) * x)
    det = n * sxx - sx * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(det > 0, (n * sxy - sx * sy) / det, 0)
        out = k - ((sy - slope * sx) / n)[:, None] - slope[:, None] * x
    return np.where((n >= 5)[:, None], out, np.nan)


def correlation_map(k: np.ndarray, most_lag: int, most_shift: int) -> np.ndarray:
    """(lag, shift + most_shift): normalised correlation of rows with those a lag later, shifted, per overlapping place."""
    a, n = centred(k), k.shape[1]
    shift = np.arange(-most_shift, most_shift + 1)
    f = np.fft.rfft(a, 2 * n, axis=1)
    power = (a * a).mean()
    out = []
    for lag in range(1, most_lag + 1):
        c = np.fft.irfft((np.conj(f[:-lag]) * f[lag:]).mean(0), 2 * n)
        out.append(c[shift] / (n - np.abs(shift)) / max(power, 1e-12))
    return np.array(out)


def seed_speed(cmap: np.ndarray, least: float = 1.5) -> float:
    """The line through the origin on which correlations exceed those of its mirror image most; NaN if none does."""
    m = cmap.shape[1] // 2
    odd, lags = (cmap - cmap[:, ::-1]) / 2, np.arange(1, len(cmap) + 1)
    grid = np.geomspace(0.02, m - 3, 240)
    best, at = 0.0, np.nan
    for v in np.concatenate([-grid[::-1], grid]):
        d = v * lags
        use = (np.abs(d) >= least) & (np.abs(d) <= m - 3)
        if use.sum() >= 3:
            score = float(np.mean([np.interp(x, np.arange(-m, m + 1), odd[j]) for j, x in zip(np.flatnonzero(use), d[use], strict=True)]))
            if score > best:
                best, at = score, float(v)
    return at


def log_peak(c: np.ndarray, k: int) -> float:
    """Place of the top of a Gaussian through a peak and its neighbours."""
    if not 0 < k < len(c) - 1 or (c[k - 1 : k + 2] <= 0).any():
        return float(k)
    a, b, d = np.log(c[k - 1 : k + 2])
    bend = a - 2 * b + d
    return k + (float(np.clip(0.5 * (a - d) / bend, -1, 1)) if bend < 0 else 0.0)


def ridge_speed(cmap: np.ndarray, least_peak: float = 0.08, least: float = 1.5) -> tuple[float, float, float]:
    """(speed, share explained, mean height) of the correlation ridge, followed lag by lag from the seed's prediction."""
    m, lags = cmap.shape[1] // 2, np.arange(1, len(cmap) + 1)
    v, shift, misses = seed_speed(cmap, least), np.arange(-m, m + 1), 0
    if not np.isfinite(v):
        return np.nan, np.nan, 0.0
    at, top = np.full(len(lags), np.nan), np.zeros(len(lags))
    for j, lag in enumerate(lags):
        near = np.abs(shift - v * lag) <= max(3.0, 0.3 * abs(v * lag))
        if abs(v * lag) > m - 3:
            break
        k = int(np.argmax(np.where(near, cmap[j], -np.inf)))
        if 0 < k < 2 * m and near[k - 1] and near[k + 1] and cmap[j, k] >= least_peak:
            at[j], top[j], misses = log_peak(cmap[j], k) - m, cmap[j, k], 0
            ok = np.isfinite(at)
            v = float((top[ok] * at[ok] * lags[ok]).sum() / (top[ok] * lags[ok] ** 2).sum())
        else:
            misses += 1
            if misses >= 3 and np.isfinite(at).any():
                break
    ok = np.isfinite(at) & (np.abs(at) >= least)
    if ok.sum():
        ok &= np.sign(at) == np.sign((np.sign(at[ok]) * top[ok]).sum())
    if ok.sum() < 2:
        return np.nan, np.nan, 0.0
    w, d, g = top[ok], at[ok], lags[ok]
    v = float((w * g * d).sum() / (w * g * g).sum())
    spread = float((w * (d - np.average(d, weights=w)) ** 2).sum())
    return v, 1 - float((w * (d - v * g) ** 2).sum()) / spread if spread > 0 else 1.0, float(w.mean())


def flight_speed(k: np.ndarray, gaps: tuple[int, ...] = (4, 8, 12, 16), most_lag: int = 20) -> float:
    """Speed from the delays over several distances: delay against distance through the origin, weighted by the peaks."""
    a = centred(k)
    n, top, low = len(a), 0.0, 0.0
    f = np.fft.rfft(a, 2 * n, axis=0)
    for gap in (g for g in gaps if g < a.shape[1]):
        c = np.fft.irfft((np.conj(f[:, :-gap]) * f[:, gap:]).mean(1), 2 * n)
        lag = np.arange(-min(most_lag, n // 2), min(most_lag, n // 2) + 1)
        v = c[lag] / (n - np.abs(lag))
        j = int(np.argmax(v))
        if v[j] > 0 and lag[j]:
            delay = log_peak(v, j) + lag[0]
            top, low = top + v[j] * gap * delay, low + v[j] * gap * gap
    return low / top if top else float("nan")


def fast_speed(k: np.ndarray, lags: tuple[int, ...] = (1, 2, 3), least: float = 3.0, most_shift: int = 40, shuffles: int = 20, seed: int = 0) -> tuple[float, float, float]:
    """(speed, score, the best score of rows in shuffled order): the best line over large shifts and few lags, against chance."""
    def best(x: np.ndarray) -> tuple[float, float]:
        cmap = correlation_map(x, max(lags), most_shift)
        odd = (cmap - cmap[:, ::-1]) / 2
        out = (0.0, float("nan"))
        for v in np.concatenate([np.linspace(-most_shift + 2, -least, 120), np.linspace(least, most_shift - 2, 120)]):
            d = [(g, v * g) for g in lags if abs(v * g) <= most_shift - 2]
            if d:
                score = float(np.mean([np.interp(s, np.arange(-most_shift, most_shift + 1), odd[g - 1]) for g, s in d]))
                out = max(out, (score, float(v)), key=lambda o: o[0])
        return out

    rng = np.random.default_rng(seed)
    score, v = best(k)
    return v, score, max(best(k[rng.permutation(len(k))])[0] for _ in range(shuffles))


def transit_ratio(k: np.ndarray, joint: int, v: float, skip: int = 4) -> tuple[float, float, float]:
    """(ratio, across, within): correlation of places on both sides of a joint at the delay of their distance, against pairs on one side.

    The side with the clearer pattern counts; NaN where the path is too short or nothing moves.
    """
    a, n = centred(k), len(k)
    most, least = min(joint, k.shape[1] - joint) - 2, 2 * skip + 4
    if not np.isfinite(v) or abs(v) < 1e-3 or most < least:
        return float("nan"), float("nan"), float("nan")

    def pair(p: int, q: int) -> float:
        delay = (q - p) / v
        if abs(delay) >= n // 3:
            return float("nan")  # too few rows see both
        half = max(1.0, 0.5 * abs(delay))
        lag = [g for g in range(int(np.floor(delay - half)), int(np.ceil(delay + half)) + 1) if abs(g) < n // 3]
        x, y = a[:, p] - a[:, p].mean(), a[:, q] - a[:, q].mean()
        size = x.std() * y.std() + 1e-12
        return max((float(np.mean(x[: n - g] * y[g:] if g >= 0 else x[-g:] * y[: n + g])) / size for g in lag), default=float("nan"))

    across, sides = [], [[], []]
    for d in np.unique(np.linspace(least, most, 5).astype(int)):
        across += [pair(s, s + d) for s in range(max(0, joint + skip - d), min(joint - skip + 1, k.shape[1] - d))]
        sides[0] += [pair(s, s + d) for s in range(0, max(0, joint - d))]
        sides[1] += [pair(s, s + d) for s in range(joint, max(joint, k.shape[1] - d))]
    finite = lambda x: [c for c in x if np.isfinite(c)]
    across, within = finite(across), [float(np.median(finite(s))) for s in sides if len(finite(s)) >= 3]
    if len(across) < 3 or not within:
        return float("nan"), float("nan"), float("nan")
    c, w = float(np.median(across)), max(within)
    return (c / w if w > 0.05 else float("nan")), c, w
