"""Queries on pictures in long form: a vector of ``embeddings`` is a row of pixels, its label the recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus, kernels
from .registry import query, r6, table

_PX = "px as (select label, vec_id, u.pix - 1 as pix, cast(embedding[u.pix] as double) as v from embeddings, generate_series(1, 64) as u(pix))"


def _pixels(spark, sf_dir):
    return consensus.pixels(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query(f"""with {_PX} select label, cast(pix as int) as pix, round(avg(v), 6) + 0.0 as mean, round(stddev_pop(v), 6) as sd, count(*) as n from px group by 1, 2""")
def coverage_mean_sd(spark, sf_dir):
    """Mean and spread of each pixel over the frames that show it."""
    px = _pixels(spark, sf_dir).withColumnRenamed("vec_id", "frame")
    return consensus.projections(px, "label").select("label", "pix", r6("mean").alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(f"""with {_PX}, k as (select label, pix, count(*) filter (v > 0.05) as k, count(*) as n from px group by 1, 2) select label, round(sum(k * (k - 1)) / nullif(sum(k * (n - 1)), 0), 6) as overlap from k group by 1""")
def mask_overlap(spark, sf_dir):
    """Share of mask pixels that pairs of frames agree on (D3)."""
    px = _pixels(spark, sf_dir).withColumn("m", F.col("v") > 0.05)
    return consensus.mask_overlap(px, "label").withColumn("overlap", F.round("overlap", 6))


@query(f"""with {_PX}, b as (select label, pix, count(*) filter (v > 0.0) * 2 > count(*) as major from px group by 1, 2),
 d as (select label, vec_id, 2 * count(*) filter (v > 0.0 and major) / nullif(count(*) filter (v > 0.0) + count(*) filter (major), 0) as d from px join b using (label, pix) group by 1, 2)
 select label, round(avg(d), 6) as dice from d group by 1""")
def mask_dice(spark, sf_dir):
    """Mean agreement of frames with the majority mask."""
    px = _pixels(spark, sf_dir).withColumn("m", F.col("v") > 0.0)
    return consensus.dice(px, "label", "vec_id").withColumn("dice", F.round("dice", 6))


@query(f"""with {_PX}, t as (select label, vec_id, pix // 8 as tile, v from px), m as (select label, tile, median(v) as med from t group by 1, 2)
 select label, tile, round(1.4826 * median(abs(v - med)), 6) as noise from t join m using (label, tile) group by 1, 2""")
def tile_noise(spark, sf_dir):
    """Robust spread of each tile."""
    from ..functions.stats import MAD_TO_SD, median_mad

    t = _pixels(spark, sf_dir).withColumn("tile", F.floor(F.col("pix") / 8))
    return median_mad(t.select("label", "tile", "v"), ["label", "tile"], "v").select("label", "tile", F.round(F.col("mad") * MAD_TO_SD, 6).alias("noise"))


@query(f"""with {_PX}, t as (select label, pix, avg(v) as e from px group by 1, 2), g as (select vec_id, sum(v * e) / sum(e * e) as gain, 1 - sum(pow(v - e, 2)) / sum(pow(v, 2)) as explained from px join t using (label, pix) group by 1)
 select vec_id, round(gain, 6) + 0.0 as gain, round(explained, 6) + 0.0 as explained from g""")
def frame_gain(spark, sf_dir):
    """Least-squares gain of each frame on its template and the share explained."""
    px = _pixels(spark, sf_dir)
    t = px.groupBy("label", "pix").agg(F.avg("v").alias("e"))
    g = px.join(t, ["label", "pix"]).groupBy("vec_id").agg((F.sum(F.col("v") * F.col("e")) / F.sum(F.col("e") * F.col("e"))).alias("gain"), (1 - F.sum(F.pow(F.col("v") - F.col("e"), 2)) / F.sum(F.pow("v", 2))).alias("explained"))
    return g.select("vec_id", r6("gain").alias("gain"), r6("explained").alias("explained"))


@query(f"""with {_PX}, a as (select vec_id, array_agg(v order by pix) as v from px group by 1)
 select vec_id, round(list_max(list_transform(range(2, 64), lambda i: abs(v[i - 1] - 2 * v[i] + v[i + 1]))), 6) as sharpest from a""")
def laplacian_peak(spark, sf_dir):
    """Largest second difference along a profile."""
    v = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    second = F.transform(F.sequence(F.lit(2), F.size("v") - 1), lambda i: F.abs(F.element_at("v", i - 1) - 2 * F.element_at("v", i) + F.element_at("v", i + 1)))
    return e.select("vec_id", F.round(F.array_max(second), 6).alias("sharpest"))


@query(f"""with {_PX}, b as (select vec_id, (pix // 8) - k as box, v from px, generate_series(0, 1) as g(k) where (pix // 8) - k between 0 and 6)
 select vec_id, cast(box as bigint) as box, round(sum(v * v) / 16, 6) as energy, round(max(abs(v)), 6) as peak from b group by 1, 2""")
def box_energy(spark, sf_dir):
    """Energy in boxes that overlap by half: each pixel goes to its two."""
    b = _pixels(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("box", F.floor(F.col("pix") / 8) - F.col("k")).filter("box between 0 and 6")
    return b.groupBy("vec_id", "box").agg(F.round(F.sum(F.col("v") * F.col("v")) / 16, 6).alias("energy"), F.round(F.max(F.abs("v")), 6).alias("peak"))


@query(f"""with {_PX}, m as (select vec_id, pix, v, v > 0.02 as "on" from px), r as (select *, pix - row_number() over (partition by vec_id, "on" order by pix) as run from m)
 select vec_id, cast(min(pix) as bigint) as first, count(*) as length, round(sum(v), 6) as mass from r where "on" group by vec_id, run having count(*) >= 2""")
def components_1d(spark, sf_dir):
    """The newest frames kept, timed by the rate that was reached."""
    from pyspark.sql import Window

    w = Window.partitionBy("vec_id").orderBy("pix")
    m = _pixels(spark, sf_dir).filter("v > 0.02").withColumn("run", F.col("pix") - F.row_number().over(w))
    return m.groupBy("vec_id", "run").agg(F.min("pix").cast("long").alias("first"), F.count(F.lit(1)).alias("length"), F.round(F.sum("v"), 6).alias("mass")).filter("length >= 2").drop("run")


_COS, _SIN = "cos(2 * pi() * (f * n % 64) / 64)", "sin(2 * pi() * (f * n % 64) / 64)"


@query(f"""with p as (select vec_id, label, k - 1 as n, cast(embedding[k] as double) as v from embeddings, unnest(range(1, 65)) as u(k)), m as (select vec_id, label, n, v - avg(v) over (partition by vec_id) as v from p),
 s as (select vec_id, any_value(label) as label, f, sum(v * {_COS}) as re, -sum(v * {_SIN}) as im from m, range(0, 33) g(f) group by vec_id, f), r as (select label, min(vec_id) as ref from embeddings group by 1),
 x as (select b.vec_id, b.label, b.f, a.re * b.re + a.im * b.im as re, a.re * b.im - a.im * b.re as im from s b join r using (label) join s a on a.vec_id = r.ref and a.f = b.f),
 w as (select vec_id, label, f, case when sqrt(re * re + im * im) > 1e-12 then re / sqrt(sqrt(re * re + im * im)) else 0 end as re, case when sqrt(re * re + im * im) > 1e-12 then im / sqrt(sqrt(re * re + im * im)) else 0 end as im from x),
 c as (select vec_id, any_value(label) as label, n, sum(case when f in (0, 32) then re * {_COS} else 2 * (re * {_COS} - im * {_SIN}) end) / 64 as c from w, range(0, 64) h(n) group by vec_id, n),
 t as (select vec_id, label, arg_max(n, c) as k, max(c) as b from c group by 1, 2), q as (select t.*, l.c as a, h.c as d from t join c l on l.vec_id = t.vec_id and l.n = (k + 63) % 64 join c h on h.vec_id = t.vec_id and h.n = (k + 1) % 64),
 z as (select *, k + case when a - 2 * b + d < 0 then 0.5 * (a - d) / (a - 2 * b + d) else 0 end as s from q) select label, vec_id, round(case when s > 32 then s - 64 else s end, 6) + 0.0 as shift, round(b, 6) + 0.0 as response from z""")
def phase_correlation_1d(spark, sf_dir):
    """Shift of each profile to its recording's first one, by phase correlation with a sub-pixel peak."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("ref"))
    return kernels.phase_shift(e.join(first, "label"), "ref", "v").select("label", "vec_id", (F.round("shift", 6) + F.lit(0.0)).alias("shift"), (F.round("response", 6) + F.lit(0.0)).alias("response"))
