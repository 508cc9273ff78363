"""Queries on pixels. Each vector of ``embeddings``, times 8, is a square picture, its label the recording that it belongs to.

What a picture operator gives is compared by three numbers a picture: how many pixels have data, their sum, and their
sum weighted by place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pictures as P
from .registry import query, r6, table

#: Pixels (vec_id, label, i, y, x, v) of the 8 x 8 pictures.
PX = "px as (select vec_id, label, k - 1 as i, (k - 1) // 8 as y, (k - 1) % 8 as x, cast(embedding[k] as double) * 8 as v from embeddings, unnest(range(1, 65)) as u(k))"
#: The nine neighbours of a pixel, with the border repeated, or only those inside.
EDGE = "join {t} n on n.vec_id = p.vec_id and n.y = least(greatest(p.y + dy, 0), 7) and n.x = least(greatest(p.x + dx, 0), 7)"
INSIDE = "join {t} n on n.vec_id = p.vec_id and n.y = p.y + dy and n.x = p.x + dx"
NINE = "(select a.d as dy, b.d as dx from range(-1, 2) a(d), range(-1, 2) b(d))"


def digest_sql(t: str, v: str = "v", where: str = "true") -> str:
    return f"select vec_id, count({v}) as n, round(coalesce(sum({v}), 0), 6) + 0.0 as total, round(coalesce(sum(i * {v}), 0), 6) + 0.0 as placed from {t} where {where} group by vec_id"


def _digest(df: DataFrame, out: str = "out") -> DataFrame:
    zero = F.lit(0.0)
    some = F.filter(out, lambda x: x.isNotNull())
    placed = F.aggregate(F.transform(out, lambda x, i: F.coalesce(x, zero) * i), zero, lambda a, x: a + x)
    return df.select(F.col("id").alias("vec_id"), F.size(some).cast("long").alias("n"), r6(F.aggregate(some, zero, lambda a, x: a + x)).alias("total"), r6(placed).alias("placed"))


def pictures(spark, sf_dir) -> DataFrame:
    """id, label, height, width, v."""
    side = F.sqrt(F.size("embedding")).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", side.alias("height"), side.alias("width"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("v"))


def _each(spark, sf_dir, work) -> DataFrame:
    return _digest(P.run(pictures(spark, sf_dir), lambda a: {"out": work(a)}, "out array<double>"))


def blur_sql(t: str, v: str, sigma: float, r: int) -> str:
    """select vec_id, label, i, y, x, g: the Gaussian mean of v in t, border mirrored."""
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1))
    k = f"(select d, exp(-0.5 * (d / {sigma}::double) * (d / {sigma}::double)) / {total!r}::double as w from range(-{r}, {r + 1}) a(d))"
    return f"""select p.vec_id, p.label, p.i, p.y, p.x, sum(a.w * b.w * n.{v}) as g from {t} p, {k} a, {k} b, {t} n
      where n.vec_id = p.vec_id and n.y = 7 - abs(7 - abs(p.y + a.d)) and n.x = 7 - abs(7 - abs(p.x + b.d)) group by all"""


@query(f"""with {PX}, l as (select p.vec_id, p.i, p.v, sum(case when dy = 0 and dx = 0 then -4 when dy = 0 or dx = 0 then 1 else 0 end * n.v) as d from px p, {NINE} o {EDGE.format(t="px")} group by all)
 select vec_id, round(ln(greatest(var_pop(d), 1e-12)), 6) as log_sharpness, round(avg(v), 6) + 0.0 as brightness, round(avg(case when v >= 1.5 then 1.0::double else 0.0::double end), 6) as clipped from l group by 1""")
def frame_statistics(spark, sf_dir):
    """Log of the variance of second differences, mean, share of clipped pixels."""
    got = P.run(pictures(spark, sf_dir), lambda a: P.frame_statistics(a, 1.5), "log_sharpness double, brightness double, clipped double")
    return got.select(F.col("id").alias("vec_id"), *[r6(c).alias(c) for c in ("log_sharpness", "brightness", "clipped")])


@query(f"""with {PX}, b as (select vec_id, label, (y // 2) * 4 + x // 2 as i, y // 2 as y, x // 2 as x, avg(v) as v from px group by all),
 l as (select p.vec_id, p.i, p.v, sum(case when dy = 0 and dx = 0 then -4 when dy = 0 or dx = 0 then 1 else 0 end * n.v) as d from b p, {NINE} o join b n on n.vec_id = p.vec_id and n.y = least(greatest(p.y + dy, 0), 3) and n.x = least(greatest(p.x + dx, 0), 3) group by all)
 select vec_id, round(ln(greatest(var_pop(d), 1e-12)), 6) as log_sharpness, round(avg(v), 6) + 0.0 as brightness from l group by 1""")
def block_scores(spark, sf_dir):
    """Sharpness and brightness of block means."""
    got = P.run(pictures(spark, sf_dir), lambda a: P.frame_statistics(P.block_means(a, 2), np.inf), "log_sharpness double, brightness double")
    return got.select(F.col("id").alias("vec_id"), r6("log_sharpness").alias("log_sharpness"), r6("brightness").alias("brightness"))


@query(f"""with {PX}, g as (select p.vec_id, p.i, max(case when n.v >= 1.6 then 1.0::double else 0.0::double end) as v from px p, (select a.d as dy, b.d as dx from range(-2, 3) a(d), range(-2, 3) b(d) where a.d * a.d + b.d * b.d <= 4) o {INSIDE.format(t="px")} group by all) {digest_sql("g")}""")
def glare_mask(spark, sf_dir):
    """Pixels at or over a level, widened by a disc."""
    return _each(spark, sf_dir, lambda a: P.dilate(a >= 1.6, P.disc(2)).astype(float))


@query(f"with {PX}, g as ({blur_sql('px', 'v', 0.7, 2)}) {digest_sql('g', 'g')}")
def gaussian_blur(spark, sf_dir):
    """Separable Gaussian, border mirrored."""
    return _each(spark, sf_dir, lambda a: P.blur(a, 0.7, 2))


def _hessian_sql(name: str, t: str, sigma: float, r: int) -> str:
    """CTEs that end in ``name``: vec_id, label, i, small, big."""
    c = lambda dy, dx: f"sum(case when dy = {dy} and dx = {dx} then n.g else 0 end)"
    return f"""{name}b as ({blur_sql(t, 'v', sigma, r)}),
 {name}d as (select p.vec_id, p.label, p.i, {c(1, 0)} - 2 * {c(0, 0)} + {c(-1, 0)} as yy, {c(0, 1)} - 2 * {c(0, 0)} + {c(0, -1)} as xx, ({c(1, 1)} - {c(1, -1)} - {c(-1, 1)} + {c(-1, -1)}) / 4 as yx from {name}b p, {NINE} o {EDGE.format(t=name + "b")} group by all),
 {name}e as (select *, ((yy + xx) / 2 - sqrt(pow((yy - xx) / 2, 2) + yx * yx)) * {sigma * sigma}::double as lo, ((yy + xx) / 2 + sqrt(pow((yy - xx) / 2, 2) + yx * yx)) * {sigma * sigma}::double as hi from {name}d),
 {name} as (select vec_id, label, i, case when abs(lo) > abs(hi) then hi else lo end as small, case when abs(lo) > abs(hi) then lo else hi end as big from {name}e)"""


@query(f"with {PX}, {_hessian_sql('h', 'px', 0.8, 2)}, q as (select vec_id, i, abs(small) + abs(big) as v from h) {digest_sql('q')}")
def hessian_eigenvalues(spark, sf_dir):
    """Both bends of the blurred picture, scaled by its width."""
    return _each(spark, sf_dir, lambda a: np.abs(np.stack(P.eigenvalues(a, 0.8, 2))).sum(0))


@query(f"""with {PX}, {_hessian_sql('s', 'px', 0.8, 2)}, {_hessian_sql('t', 'px', 1.2, 3)}, c as (select label, max(sqrt(small * small + big * big)) / 2 as c from s group by 1),
 r as (select vec_id, i, big, c, exp(-pow(small / case when big = 0 then 1 else big end, 2) / 0.5) * (1 - exp(-(big * big + small * small) / (2 * c * c))) as v from (select * from s union all select * from t) h join c using (label)),
 m as (select vec_id, i, max(case when big > 0 then v else 0 end) as v from r group by all) {digest_sql('m')}""")
def ridge_strength(spark, sf_dir):
    """Dark ridges over two scales, with one contrast for all pictures of a recording."""
    scales = ((0.8, 2), (1.2, 3))
    px = pictures(spark, sf_dir)
    power = P.run(px, lambda a: {"p": np.sqrt(np.square(np.stack(P.eigenvalues(a, *scales[0]))).sum(0).max(axis=(1, 2)))}, "p double", ("id", "label"))
    contrast = power.groupBy("label").agg((F.max("p") / 2).alias("c"))
    # the recording's constant travels as one more row of the picture
    framed = px.join(contrast, "label").withColumn("v", F.concat("v", F.array_repeat(F.col("c"), F.col("width")))).withColumn("height", F.col("height") + 1)
    return _digest(P.run(framed, lambda a: {"out": P.ridges(a[:, :-1], scales, a[:, -1, 0])}, "out array<double>"))


@query(f"""with {PX}, t as (select label, quantile_cont(v, 0.4) as t from px group by 1), m as (select vec_id, i, y, x, v > t as m from px join t using (label)),
 e as (select p.vec_id, p.i, p.y, p.x, bool_and(n.m) as m from m p, {NINE} o {INSIDE.format(t="m")} group by all),
 d as (select p.vec_id, p.i, max(case when n.m then 1.0::double else 0.0::double end) as v from e p, {NINE} o {INSIDE.format(t="e")} group by all) {digest_sql("d")}""")
def binary_envelope(spark, sf_dir):
    """Over a threshold of the whole recording, opened by 3 x 3 (I8)."""
    px = pictures(spark, sf_dir)
    level = px.select("label", F.explode("v").alias("x")).groupBy("label").agg(F.percentile("x", F.lit(0.4)).alias("t"))
    over = px.join(level, "label").withColumn("v", F.transform("v", lambda x: F.when(x > F.col("t"), 1.0).otherwise(0.0)))
    return _digest(P.run(over, lambda a: {"out": P.dilate(P.erode(a > 0, P.SQUARE), P.SQUARE).astype(float)}, "out array<double>"))


@query(f"""with recursive {PX}, g(vec_id, i, y, x) as (select vec_id, i, y, x from px where v > 1.4 union select n.vec_id, n.i, n.y, n.x from g p join px n on n.vec_id = p.vec_id and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1 where n.v > 0.6),
 o as (select px.vec_id, px.i, case when g.i is null then 0.0::double else 1.0::double end as v from px left join g on g.vec_id = px.vec_id and g.i = px.i) {digest_sql("o")}""")
def hysteresis_mask(spark, sf_dir):
    """Pixels over the low level that touch one over the high level through others."""
    return _each(spark, sf_dir, lambda a: P.grown(a > 1.4, a > 0.6).astype(float))


@query(f"""with recursive {PX}, m as (select * from px where v > 0.9), r(vec_id, i, root) as (select vec_id, i, i from m union select n.vec_id, n.i, r.root from r join m p on p.vec_id = r.vec_id and p.i = r.i join m n on n.vec_id = p.vec_id and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1),
 l as (select vec_id, i, min(root) as label from r group by all)
 select l.vec_id, cast(l.label + 1 as bigint) as spot, count(*) as area, round(avg(y), 6) as cy, round(avg(x), 6) as cx from l join m on m.vec_id = l.vec_id and m.i = l.i group by 1, 2""")
def spots(spark, sf_dir):
    """Components of 8 neighbours with area and centroid."""
    got = P.run(pictures(spark, sf_dir), lambda a: {"out": P.labelled(a > 0.9).astype(float)}, "out array<double>")
    each = got.select("id", F.posexplode("out").alias("i", "spot")).filter("spot > 0")
    by = each.groupBy(F.col("id").alias("vec_id"), F.col("spot").cast("long").alias("spot"))
    return by.agg(F.count(F.lit(1)).alias("area"), F.round(F.avg(F.floor(F.col("i") / 8)), 6).alias("cy"), F.round(F.avg(F.col("i") % 8), 6).alias("cx"))


@query(f"with {PX}, d as (select p.vec_id, p.i, sqrt(min(pow(p.y - n.y, 2) + pow(p.x - n.x, 2))) as v from px p join px n on n.vec_id = p.vec_id and n.v <= 0.3 group by all) {digest_sql('d')}")
def distance_map(spark, sf_dir):
    """Distance to the nearest pixel outside the mask."""
    return _each(spark, sf_dir, lambda a: P.distance(a > 0.3))


@query(f"""with {PX}, s as (select vec_id, label, i, y, x, v + 6 as v from px), b as ({blur_sql('s', 'v', 2.0, 4)}), w as ({blur_sql('s', 'v', 0.7, 2)}),
 o as (select s.vec_id, s.i, s.v / b.g + (w.g - b.g) as v from s join b on b.vec_id = s.vec_id and b.i = s.i join w on w.vec_id = s.vec_id and w.i = s.i) {digest_sql('o')}""")
def flat_field(spark, sf_dir):
    """Picture over its smooth part, plus a band pass."""

    def work(a):
        a = a + 6
        smooth = P.blur(a, 2.0, 4)
        return a / smooth + (P.blur(a, 0.7, 2) - smooth)

    return _each(spark, sf_dir, work)


@query(f"""with {PX}, m as (select *, case when v > -0.5 then v end as k, case when v > -0.5 then 1.0::double else 0.0::double end as w, case when v > -0.5 then v else 0.0 end as z from px),
 a as ({blur_sql('m', 'z', 1.0, 2)}), b as ({blur_sql('m', 'w', 1.0, 2)}), o as (select m.vec_id, m.i, m.k - case when b.g > 0 then a.g / b.g end as v from m join a on a.vec_id = m.vec_id and a.i = m.i join b on b.vec_id = m.vec_id and b.i = m.i) {digest_sql('o')}""")
def fine_detail_valid(spark, sf_dir):
    """Picture less its smooth part, where pixels without data count for nothing."""

    def work(a):
        a = np.where(a > -0.5, a, np.nan)
        return a - P.blur_valid(a, 1.0, 2)

    return _each(spark, sf_dir, work)


@query(f"with {PX}, o as (select p.vec_id, p.i, sqrt(avg(n.v * n.v)) as v from px p, {NINE} o {EDGE.format(t='px')} group by all) {digest_sql('o')}")
def local_rms(spark, sf_dir):
    """Root mean square around each pixel."""
    return _each(spark, sf_dir, lambda a: np.sqrt(np.square(P.windows(a)).mean(-1)))


@query(f"""with {PX}, a as ({blur_sql('px', 'v', 0.5, 2)}), b as ({blur_sql('px', 'v', 1.0, 3)}), c as ({blur_sql('px', 'v', 2.0, 4)}),
 d as (select a.vec_id, a.g - b.g as fine, b.g - c.g as coarse from a join b on b.vec_id = a.vec_id and b.i = a.i join c on c.vec_id = a.vec_id and c.i = a.i),
 m as (select vec_id, median(fine) as f, median(coarse) as c from d group by 1)
 select d.vec_id, round(stddev_pop(fine) / (1.4826 * median(abs(fine - f))), 6) as fine, round(stddev_pop(coarse) / (1.4826 * median(abs(coarse - c))), 6) as coarse from d join m using (vec_id) group by 1""")
def band_contrast(spark, sf_dir):
    """Spread over robust noise in two bands of scale."""

    def work(a):
        g = [P.blur(a, s, r) for s, r in ((0.5, 2), (1.0, 3), (2.0, 4))]
        out = {}
        for name, d in (("fine", g[0] - g[1]), ("coarse", g[1] - g[2])):
            mid = np.median(d, axis=(1, 2), keepdims=True)
            out[name] = d.std(axis=(1, 2)) / (1.4826 * np.median(np.abs(d - mid), axis=(1, 2)))
        return out

    got = P.run(pictures(spark, sf_dir), work, "fine double, coarse double")
    return got.select(F.col("id").alias("vec_id"), r6("fine").alias("fine"), r6("coarse").alias("coarse"))


@query(f"""with {PX}, b as (select label, i, max(v) + 7 as b from px group by 1, 2), d as (select px.vec_id, px.i, ln(b) - ln(px.v + 6) as d from px join b on b.label = px.label and b.i = px.i), m as (select vec_id, median(d) as m from d group by 1),
 o as (select d.vec_id, i, d - m as v from d join m using (vec_id)) {digest_sql('o')}""")
def optical_density(spark, sf_dir):
    """Log of background over picture, centred on its median."""
    px = pictures(spark, sf_dir)
    each = px.select("id", "label", F.posexplode("v").alias("i", "x"))
    base = each.groupBy("label", "i").agg((F.max("x") + 7).alias("b")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("b"))  # a picture a recording
    d = px.join(base, "label").withColumn("d", F.zip_with("v", F.col("b.b"), lambda x, b: F.log(b) - F.log(x + 6)))
    s, n = F.array_sort("d"), F.size("d")
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    return _digest(d.withColumn("m", mid).withColumn("out", F.transform("d", lambda x: x - F.col("m"))))


@query(f"with {PX} select label, i as pix, count(*) filter (v >= 1.5) as times, bool_or(v >= 1.5) as saturated, count(*) filter (v >= 0.5) >= 0.4 * count(*) as stuck from px group by 1, 2")
def saturated_pixels(spark, sf_dir):
    """Pixels that any picture of a recording has at full scale, how often, and those bright in most."""
    each = pictures(spark, sf_dir).select("label", F.posexplode("v").alias("pix", "x"))
    by = each.groupBy("label", F.col("pix").cast("long").alias("pix"))
    return by.agg(F.count_if(F.col("x") >= 1.5).alias("times"), F.max(F.col("x") >= 1.5).alias("saturated"), (F.count_if(F.col("x") >= 0.5) >= 0.4 * F.count(F.lit(1))).alias("stuck"))


@query(f"with {PX}, o as (select p.vec_id, p.i, p.v, quantile_cont(n.v, 0.75) as q from px p, {NINE} o {EDGE.format(t='px')} group by all) select vec_id, round(sum(q), 6) + 0.0 as level, count(*) filter (v > q + 0.8) as too_bright from o group by 1")
def bright_level(spark, sf_dir):
    """Moving percentile, and the pixels too far over it."""

    def work(a):
        q = np.percentile(P.windows(a), 75, axis=-1)
        return {"level": q.sum(axis=(1, 2)), "too_bright": (a > q + 0.8).sum(axis=(1, 2))}

    got = P.run(pictures(spark, sf_dir), work, "level double, too_bright long")
    return got.select(F.col("id").alias("vec_id"), r6("level").alias("level"), "too_bright")


@query(f"""with {PX}, s as (select label, i, avg(v) as m from px group by 1, 2), o as (select px.vec_id, px.i, px.v / nullif(case when abs(m) < 0.05 then 0 else 1 + m end, 0) as v from px join s on s.label = px.label and s.i = px.i) {digest_sql('o')}""")
def clean_frame(spark, sf_dir):
    """Picture over its recording's sensor map; where the map is zero there is no data."""
    px = pictures(spark, sf_dir)
    mean = px.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    maps = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))  # a picture a recording
    over = F.zip_with("v", F.col("m.m"), lambda x, m: F.when(F.abs(m) >= 0.05, x / (m + 1)))
    return _digest(px.join(maps, "label").withColumn("out", over))


def _warp_sql(m: list[list[float]]) -> str:
    at = lambda r: " + ".join(f"({m[r][k]!r}::double) * {c}" for k, c in enumerate(("x", "y", "1")))
    return f"""{PX}, s as (select vec_id, i, ({at(0)}) / ({at(2)}) as sx, ({at(1)}) / ({at(2)}) as sy from px),
 k as (select *, least(greatest(floor(sy), 0), 6) as ky, least(greatest(floor(sx), 0), 6) as kx from s where sy >= 0 and sx >= 0 and sy <= 7 and sx <= 7),
 o as (select k.vec_id, k.i, sum(n.v * (case when n.y = ky then 1 - (sy - ky) else sy - ky end) * (case when n.x = kx then 1 - (sx - kx) else sx - kx end)) as v
       from k join px n on n.vec_id = k.vec_id and n.y between ky and ky + 1 and n.x between kx and kx + 1 group by all), f as (select px.vec_id, px.i, o.v from px left join o on o.vec_id = px.vec_id and o.i = px.i)"""


_AFFINE = [[0.98, -0.17, 0.6], [0.17, 0.98, -0.4], [0.0, 0.0, 1.0]]
_HOMOGRAPHY = [[1.02, 0.05, 0.1], [-0.03, 0.97, 0.2], [0.004, -0.003, 1.0]]


@query(f"with {_warp_sql(_AFFINE)} {digest_sql('f')}")
def affine_warp(spark, sf_dir):
    """Pictures seen through an affine map, bilinear, no data outside."""
    return _each(spark, sf_dir, lambda a: P.warped(a, np.array(_AFFINE)))


@query(f"with {_warp_sql(_HOMOGRAPHY)} {digest_sql('f')}")
def perspective_warp(spark, sf_dir):
    """Pictures seen through a homography."""
    return _each(spark, sf_dir, lambda a: P.warped(a, np.array(_HOMOGRAPHY)))


@query(f"""with {PX}, w as (select vec_id, i, y, x, v from px), m as (select p.vec_id, p.i, n.v from px p left join px n on n.vec_id = p.vec_id and n.y = p.y - (p.vec_id % 3 - 1) and n.x = p.x - (p.vec_id % 5 - 2)),
 c as (select vec_id, median(v) as c from m group by 1), o as (select m.vec_id, m.i, m.v / nullif(c, 0) as v from m join c using (vec_id)) {digest_sql('o')}""")
def registered_stack(spark, sf_dir):
    """Pictures moved by whole pixels, over their median; no data where they were not seen."""
    px = pictures(spark, sf_dir).withColumn("v", F.concat("v", F.array_repeat(F.col("id").cast("double"), F.col("width")))).withColumn("height", F.col("height") + 1)

    def work(a):
        ids = a[:, -1, 0].astype(np.int64)
        a = a[:, :-1]
        out = np.stack([P.moved(a[k : k + 1], int(i % 3 - 1), int(i % 5 - 2))[0] for k, i in enumerate(ids)])
        mid = np.nanmedian(out, axis=(1, 2), keepdims=True)
        return {"out": out / np.where(mid == 0, np.nan, mid)}

    return _digest(P.run(px, work, "out array<double>"))


@query(f"""with {PX}, pt as (select k as i, 0.5 + 0.31 * k as sy, 6.4 - 0.27 * k as sx from range(0, 20) t(k)),
 o as (select n.vec_id, pt.i, sum(n.v * (case when n.y = floor(sy) then 1 - (sy - floor(sy)) else sy - floor(sy) end) * (case when n.x = floor(sx) then 1 - (sx - floor(sx)) else sx - floor(sx) end)) as v
       from pt join px n on n.y between floor(sy) and floor(sy) + 1 and n.x between floor(sx) and floor(sx) + 1 group by all) {digest_sql('o')}""")
def sampled_path(spark, sf_dir):
    """Bilinear values along a path through each picture."""
    k = np.arange(20)
    return _each(spark, sf_dir, lambda a: P.sampled(a, 0.5 + 0.31 * k, 6.4 - 0.27 * k))


@query(f"with {PX}, m as (select *, case when v > -1 then v end as k from px), o as (select p.vec_id, p.i, median(n.k) as v from m p, {NINE} o {INSIDE.format(t='m')} group by all) {digest_sql('o')}")
def median_gap_fill(spark, sf_dir):
    """Median of the neighbours with data, which also fills gaps."""
    return _each(spark, sf_dir, lambda a: P.nan_median(np.where(a > -1, a, np.nan)))


@query(f"""with {PX}, l as (select vec_id, label, i, y, x, ln(greatest(v + 3, 0.05)) as v from px), d as (select p.vec_id, p.i, p.v, sum(case when dy = 0 and dx = 0 then -4 when dy = 0 or dx = 0 then 1 else 0 end * n.v) as d from l p, {NINE} o {EDGE.format(t="l")} group by all),
 m as (select vec_id, median(d) as m from d group by 1)
 select d.vec_id, round(sum(v), 6) + 0.0 as logs, round(1.4826 * median(abs(d - m)), 6) as noise, count(*) filter (exp(v) < 0.5 or exp(v) >= 5) as invalid from d join m using (vec_id) group by 1""")
def log_preparation(spark, sf_dir):
    """Logs, their noise and the pixels too dark or too bright to use."""

    def work(a):
        v = np.log(np.maximum(a + 3, 0.05))
        d = P.laplacian(v)
        mid = np.median(d, axis=(1, 2), keepdims=True)
        return {"logs": v.sum(axis=(1, 2)), "noise": 1.4826 * np.median(np.abs(d - mid), axis=(1, 2)), "invalid": ((np.exp(v) < 0.5) | (np.exp(v) >= 5)).sum(axis=(1, 2))}

    got = P.run(pictures(spark, sf_dir), work, "logs double, noise double, invalid long")
    return got.select(F.col("id").alias("vec_id"), r6("logs").alias("logs"), r6("noise").alias("noise"), "invalid")


_BANK = "r as (select a.d as angle, cos(pi() * a.d / 8) as c, sin(pi() * a.d / 8) as s from range(0, 8) a(d)), k0 as (select angle, b.d as dy, e.d as dx, e.d * c + b.d * s as al, -e.d * s + b.d * c as ac from r, range(-2, 3) b(d), range(-2, 3) e(d)), k1 as (select angle, dy, dx, (ac * ac / 0.81 - 1) * exp(-0.5 * (ac * ac / 0.81 + al * al / 3.24)) as g from k0), k2 as (select angle, dy, dx, g - avg(g) over (partition by angle) as g from k1), bank as (select angle, dy, dx, g / sqrt(sum(g * g) over (partition by angle)) as w from k2)"


@query(f"with {PX}, {_BANK} select vec_id, cast(angle as bigint) as angle, round(sum(w * v), 6) + 0.0 as response from px join bank on px.y = 4 + dy and px.x = 4 + dx group by 1, 2")
def kernel_bank(spark, sf_dir):
    """What line filters of eight orientations (mean 0, squares summing to 1) give at the middle of each picture."""
    k = P.line_kernels(0.9, 2.0, 2, 8)
    bank = spark.createDataFrame([(a, 8 * (2 + y) + 2 + x, float(k[a, y, x])) for a in range(8) for y in range(5) for x in range(5)], "angle long, i int, w double")
    px = pictures(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode("v").alias("i", "v"))
    return px.join(F.broadcast(bank), "i").groupBy("vec_id", "angle").agg(r6(F.sum(F.col("w") * F.col("v"))).alias("response"))  # 200 rows


@query(f"""with {PX}, {_BANK}, a as (select p.vec_id, p.i, p.y, p.x, angle, sum(w * n.v) as v from px p, bank, px n where n.vec_id = p.vec_id and n.y = 7 - abs(7 - abs(p.y + dy)) and n.x = 7 - abs(7 - abs(p.x + dx)) group by all),
 b as (select *, row_number() over (partition by vec_id, i order by round(v, 9) desc, angle) as rn from a), m as (select vec_id, i, y, x, v, angle, cast(round(round(cos(pi() * angle / 8), 9)) as bigint) as sy, cast(round(round(-sin(pi() * angle / 8), 9)) as bigint) as sx from b where rn = 1),
 c as (select p.vec_id, p.i, p.v, p.angle, coalesce(f.v, -1e30) < p.v and coalesce(g.v, -1e30) <= p.v as crest from m p left join m f on f.vec_id = p.vec_id and f.y = p.y + p.sy and f.x = p.x + p.sx left join m g on g.vec_id = p.vec_id and g.y = p.y - p.sy and g.x = p.x - p.sx)
 select vec_id, round(sum(v), 6) + 0.0 as strength, cast(sum(angle) as bigint) as angles, count(*) filter (crest) as crests from c group by 1""")
def oriented_lines(spark, sf_dir):
    """Strongest of eight line filters at each pixel, and the crests across their lines."""
    bank = P.line_kernels(0.9, 2.0, 2, 8)

    def work(a):
        v, which = P.oriented(a, bank)
        return {"strength": v.sum(axis=(1, 2)), "angles": which.sum(axis=(1, 2)), "crests": P.crest(v, which, 8).sum(axis=(1, 2))}

    got = P.run(pictures(spark, sf_dir), work, "strength double, angles long, crests long")
    return got.select(F.col("id").alias("vec_id"), r6("strength").alias("strength"), "angles", "crests")


@query(f"""with {PX}, q as (select vec_id, abs(embedding[1]::double * 8) + 1 as a, abs(embedding[2]::double * 8) + 3 as b, abs(embedding[3]::double * 8) + 4 as c, abs(embedding[4]::double * 8) + 2 as d from embeddings),
 e as (select vec_id, 0.3::double as x0, a as y0, b as x1, 0.4::double as y1 from q union all select vec_id, b, 0.4, 6.7, c from q union all select vec_id, 6.7, c, d, 6.6 from q union all select vec_id, d, 6.6, 0.3, a from q),
 h as (select px.vec_id, px.i, count(*) filter ((y0 > px.y) <> (y1 > px.y) and px.x < x0 + (px.y - y0) * (x1 - x0) / case when y1 = y0 then 1 else y1 - y0 end) % 2 + 0.0::double as v from px join e on e.vec_id = px.vec_id group by all) {digest_sql('h')}""")
def polygon_mask(spark, sf_dir):
    """Pixels inside a polygon, by crossings."""
    from ..operators.masks import polygon

    def work(stack):
        out = []
        for f in stack.reshape(len(stack), -1):
            a, b, c, d = (abs(v) + k for v, k in zip(f[:4].tolist(), (1, 3, 4, 2), strict=True))
            out.append(polygon(stack.shape[1:], np.array([a, 0.4, c, 6.6]), np.array([0.3, b, 6.7, d])).astype(float))
        return np.array(out)

    return _each(spark, sf_dir, work)


@query()
def skeleton_pixels(spark, sf_dir):
    """Thinned masks: pixels, ends, links and junctions by their neighbours."""

    def work(a):
        s = P.thinned(a > 0)
        n = np.nansum(P.window_inside(s.astype(float)), axis=-1) - s
        axes = (1, 2)
        return {"pixels": s.sum(axis=axes), "ends": (s & (n == 1)).sum(axis=axes), "links": (s & (n == 2)).sum(axis=axes), "junctions": (s & (n > 2)).sum(axis=axes)}

    return P.run(pictures(spark, sf_dir), work, "pixels long, ends long, links long, junctions long").withColumnRenamed("id", "vec_id")


@query()
def background_chain(spark, sf_dir):
    """Upper envelope, robust refits, and the density under it (I16, I32)."""

    def work(a):
        v = np.log(np.maximum(a + 6, 0.05))
        b = P.background(v, 2, 0.5)
        return {"background": b.mean(axis=(1, 2)), "density": (b - v).mean(axis=(1, 2)), "spread": (b - v).std(axis=(1, 2))}

    got = P.run(pictures(spark, sf_dir), work, "background double, density double, spread double")
    return got.select(F.col("id").alias("vec_id"), *[r6(c).alias(c) for c in ("background", "density", "spread")])


@query()
def combined_ridges(spark, sf_dir):
    """Ridges of the mean and of the flicker of a recording, each over its own percentile; the larger, but inside thick ones only the first."""
    each = pictures(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    px = each.groupBy("label", "i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    maps = px.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("a"))  # two pictures a recording
    side = F.sqrt(F.size("a")).cast("int")
    both = maps.select(F.col("label").alias("id"), (2 * side).alias("height"), side.alias("width"), F.concat("a.m", "a.s").alias("v"))

    def work(a):
        h = a.shape[1] // 2
        scales = ((0.8, 2), (1.2, 3))

        def ridge(x):
            small, big = P.eigenvalues(x, *scales[0])
            v = P.ridges(x, scales, np.sqrt(small**2 + big**2).max(axis=(1, 2)) / 2)
            return np.clip(v / (np.percentile(v, 99.5, axis=(1, 2))[:, None, None] + 1e-12), 0, 1)

        first, second = ridge(a[:, :h]), ridge(-a[:, h:])
        thick = P.dilate(P.erode(first > 0.3, P.SQUARE), P.SQUARE)
        v = np.maximum(first, np.where(thick, 0, second))
        return {"strength": v.sum(axis=(1, 2)), "structural": first.sum(axis=(1, 2)), "thick": thick.sum(axis=(1, 2))}

    got = P.run(both, work, "strength double, structural double, thick long")
    return got.select(F.col("id").alias("label"), r6("strength").alias("strength"), r6("structural").alias("structural"), "thick")
