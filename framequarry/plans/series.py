"""Queries on ordered series: frames of a recording are a user's events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quantiles, stats
from ..operators import gate as gates
from ..operators import motion, series
from .registry import EVENTS, events, query, r6, table

_Z = """
 m as (select user_id, median(value) as med from e group by 1),
 d as (select e.user_id, median(abs(value - med)) as mad from e join m using (user_id) group by 1),
 z as (select e.*, med, mad, case when mad <= 1e-12 then 0.0 else (value - med) / (mad * 1.4826) end as z
       from e join m using (user_id) join d using (user_id))"""


@query(f"with {EVENTS}, {_Z} select event_id, user_id, round(z, 6) + 0.0 as z, abs(z) <= 2.0 as keep, case when z < -2.0 then 'low' when z > 2.0 then 'high' else '' end as reason from z")
def robust_z_gate(spark, sf_dir):
    """Robust z of each frame in its recording, the keep flag and its reason."""
    e = events(spark, sf_dir)
    z = stats.robust_z(F.col("value"), F.col("med"), F.col("mad"))
    rows = e.join(stats.median_mad(e.select("user_id", "value"), ["user_id"], "value"), "user_id").withColumn("z", z)
    reason = F.when(F.col("z") < -2.0, "low").when(F.col("z") > 2.0, "high").otherwise("")
    return rows.select("event_id", "user_id", r6("z").alias("z"), (F.abs("z") <= 2.0).alias("keep"), reason.alias("reason"))


@query(f"""with {EVENTS}, f as (select *, ln(value + 1) as sharp from e),
 m as (select user_id, median(sharp) as sm, median(value) as bm from f group by 1),
 d as (select f.user_id, median(abs(sharp - sm)) as sd, median(abs(value - bm)) as bd from f join m using (user_id) group by 1),
 z as (select f.*, sm, bm, case when sd <= 1e-12 then 0.0 else (sharp - sm) / (sd * 1.4826) end as zs,
       case when bd <= 1e-12 then 0.0 else (value - bm) / (bd * 1.4826) end as zb from f join m using (user_id) join d using (user_id)),
 g as (select *, zs < -2.0 and exp(sharp - sm) < 0.6 as blurred, abs(zb) > 2.0 and abs(value / greatest(bm, 1e-9) - 1) > 0.25 as lighting from z)
 select event_id, not (blurred or lighting) as keep, concat_ws('+', case when blurred then 'blink/blur' end, case when lighting then 'brightness' end) as reason from g""")
def quality_gate(spark, sf_dir):
    """The whole gate on two scores, reasons joined by + (B1, H8)."""
    e = events(spark, sf_dir).withColumn("sharp", F.log(F.col("value") + 1))
    params = gates.GateParams(sharpness_min_z=-2.0, brightness_max_abs_z=2.0)
    return gates.gate(e, "user_id", "sharp", "value", params).select("event_id", "keep", "reason")


@query(f"with {EVENTS}, {_Z} select user_id, case when z < 0 then 'low' else 'high' end as reason, count(*) as n from z where abs(z) > 2.0 group by 1, 2")
def gate_reason_histogram(spark, sf_dir):
    """Rejected frames by reason."""
    z = robust_z_gate(spark, sf_dir)
    return gates.rejected_counts(z, "user_id")


@query(f"""with {EVENTS}, p as (select user_id, us, s, event_id, value as x, cast(event_id % 97 as double) as y from e),
 c as (select user_id, median(x) as cx, median(y) as cy from p group by 1),
 g as (select p.user_id, count(*) as frames, median(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) as dm,
       quantile_cont(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 0.95) as d95, max(x) - min(x) as rx,
       sqrt(pow(regr_slope(x, s), 2) + pow(regr_slope(y, s), 2)) as drift from p join c using (user_id) group by 1),
 v as (select *, s - lag(s) over w as dt, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from p
       window w as (partition by user_id order by us, event_id)),
 sp as (select user_id, step / dt as speed from v where dt > 0),
 sm as (select user_id, median(speed) as med from sp group by 1),
 sd as (select sp.user_id, median(abs(speed - med)) as mad from sp join sm using (user_id) group by 1),
 j as (select sp.user_id, any_value(med) as speed_median, count(*) filter (speed > med + mad * (6.0 * 1.4826)) as saccades,
       sqrt(avg(speed * speed) filter (not speed > med + mad * (6.0 * 1.4826))) as jitter from sp join sm using (user_id) join sd using (user_id) group by 1)
 select user_id, frames, round(dm, 6) as displacement_median, round(d95, 6) as displacement_p95, round(rx, 6) as range_x, round(drift, 6) as drift,
        round(speed_median, 6) as speed_median, saccades, round(jitter, 6) as jitter_rms from g left join j using (user_id) where frames >= 3""")
def motion_metrics(spark, sf_dir):
    """Displacement, speed, jitter, saccades and drift of a recording."""
    e = events(spark, sf_dir).withColumn("at", F.struct("us", "event_id")).withColumn("x", F.col("value")).withColumn("y", (F.col("event_id") % 97).cast("double"))
    m = motion.motion_metrics(e, "user_id", "at", "seconds", "x", "y")
    return m.select("user_id", "frames", *[F.round(c, 6).alias(c) for c in ("displacement_median", "displacement_p95", "range_x", "drift", "speed_median")], "saccades", F.round("jitter_rms", 6).alias("jitter_rms"))


@query(f"""with {EVENTS}, f as (select user_id, event_id, us, row_number() over (partition by user_id order by event_id) - 1 as idx from e),
 stamps as (select event_id, us as stamp from e where event_type <> 'signup'),
 j as (select f.*, stamp, bool_and(stamp is not null) over (partition by user_id) as whole, min(stamp) over (partition by user_id) as t0 from f left join stamps using (event_id))
 select event_id, user_id, round(case when whole then (stamp - t0) / 1e6 else idx / 30.0 end, 6) as time_s from j""")
def frame_times_fallback(spark, sf_dir):
    """Camera clock where every frame of a recording has a stamp, else the frame number by the rate."""
    e = events(spark, sf_dir)
    w = Window.partitionBy("user_id")
    stamp = F.when(F.col("event_type") != "signup", F.col("us"))
    frames = e.select("event_id", "user_id", (F.row_number().over(w.orderBy("event_id")) - 1).alias("idx"), stamp.alias("stamp"))
    rows = frames.withColumn("whole", F.bool_and(F.col("stamp").isNotNull()).over(w)).withColumn("t0", F.min("stamp").over(w))
    time = F.when(F.col("whole"), (F.col("stamp") - F.col("t0")) / 1e6).otherwise(F.col("idx") / 30.0)
    return rows.select("event_id", "user_id", F.round(time, 6).alias("time_s"))


@query(f"""with {EVENTS}, f as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as idx, count(*) over (partition by user_id) as n from e),
 k as (select distinct user_id, cast(floor(i * (n - 1) / 7.0) as bigint) as idx from f, generate_series(0, 7) as g(i))
 select user_id, event_id, f.idx from f join k using (user_id, idx)""")
def evenly_spaced_sample(spark, sf_dir):
    """Eight evenly spaced frames of each recording (F8, A5)."""
    e = events(spark, sf_dir)
    w = Window.partitionBy("user_id")
    rows = e.select("user_id", "event_id", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.filter(F.array_contains(stats.evenly_spaced(F.col("n"), 8), F.col("idx"))).select("user_id", "event_id", "idx")


@query(f"""with {EVENTS}, s as (select *, abs(value - lag(value) over (partition by user_id order by us, event_id)) as step from e),
 i as (select user_id, event_id, us, sum(case when step > 15 then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as fixation from s)
 select user_id, cast(fixation as bigint) as fixation, count(*) as frames, min(event_id) as first_event, max(us) - min(us) as span_us from i group by 1, 2""")
def saccade_fixations(spark, sf_dir):
    """Recordings split at great steps."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("step", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("limit", F.lit(15)).withColumn("at", F.struct("us", "event_id"))
    rows = motion.fixations(e, "user_id", "at", "step", "limit")
    return rows.groupBy("user_id", "fixation").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first_event"), (F.max("us") - F.min("us")).alias("span_us"))


@query(f"""with {EVENTS}, p as (select *, row_number() over (partition by user_id order by event_id) as pos from e),
 g as (select *, pos - row_number() over (partition by user_id order by event_id) as run from p where value < 20),
 r as (select user_id, min(event_id) as first, max(event_id) as last, count(*) as length from g group by user_id, run having count(*) >= 2)
 select user_id, first, last, length from (select *, row_number() over (partition by user_id order by length desc, first) as rn from r) where rn <= 3""")
def good_runs_longest(spark, sf_dir):
    """The three longest runs of good frames of each recording."""
    e = events(spark, sf_dir).withColumn("good", F.col("value") < 20)
    runs = motion.good_runs(e, "user_id", "event_id", "good", 2)
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("length"), "first"))
    return runs.withColumn("rn", rn).filter("rn <= 3").select("user_id", "first", "last", "length")


@query(f"""with {EVENTS}, r as (select *, sum(value) over (partition by user_id order by event_id rows unbounded preceding) as run from e)
 select event_id, round(run - median(run) over (partition by user_id), 6) + 0.0 as position from r""")
def centred_trajectory(spark, sf_dir):
    """Steps summed up to a trajectory, centred on its median."""
    rows = motion.trajectory(events(spark, sf_dir), "user_id", "event_id", ["value"])
    return rows.select("event_id", r6("value_sum").alias("position"))


@query(f"""with {EVENTS} select event_id, round(m, 6) as running_mean from (select event_id, avg(value) over w as m, count(*) over w as n from e
 window w as (partition by user_id order by event_id rows between 4 preceding and 4 following)) where n = 9""")
def running_mean_centred(spark, sf_dir):
    """Mean over nine frames, edges left out."""
    return series.centred_mean(events(spark, sf_dir), ["user_id"], "event_id", "value", 4).select("event_id", F.round("running_mean", 6).alias("running_mean"))


@query(f"""with {EVENTS}, p as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from e),
 b as (select *, greatest(0, least(pos - 4, n - 9)) as lo from p)
 select b.event_id, round(avg(o.value), 6) as running_mean from b join p o on o.user_id = b.user_id and o.pos >= b.lo and o.pos < b.lo + 9 group by 1""")
def slow_movement(spark, sf_dir):
    """Mean over nine frames with the window shifted at the ends."""
    return series.edge_shifted_mean(events(spark, sf_dir), ["user_id"], "event_id", "value", 9).select("event_id", F.round("running_mean", 6).alias("running_mean"))


@query(f"""with {EVENTS}, p as (select *, (row_number() over (partition by user_id order by event_id) - 1) // 5 as bin from e)
 select user_id, bin, round(avg(value), 6) as mean from p group by 1, 2 having count(*) = 5""")
def time_bin_k(spark, sf_dir):
    """Means of five frames, the remainder dropped."""
    return series.bins_of_k(events(spark, sf_dir), ["user_id"], "event_id", "value", 5).select("user_id", "bin", F.round("mean", 6).alias("mean"))


@query(f"""with {EVENTS}, p as (select *, (row_number() over (partition by user_id order by event_id) - 1) % 2 as odd from e)
 select user_id, round(var_samp(value), 6) as var_all, round(var_samp(value) filter (odd = 0), 6) as var_even, round(var_samp(value) filter (odd = 1), 6) as var_odd from p group by 1""")
def split_half_variance(spark, sf_dir):
    """Variance over all, even and odd frames."""
    rows = series.split_half(events(spark, sf_dir), ["user_id"], "event_id", "value")
    return rows.select("user_id", *[F.round(c, 6).alias(c) for c in ("var_all", "var_even", "var_odd")])


@query(f"""with {EVENTS}, b as (select user_id, cast(floor(value / 2.5) as bigint) as bin, count(*) as n from e group by 1, 2),
 r as (select *, row_number() over (partition by user_id order by n desc, bin) as rn from b) select user_id, bin as mode_bin, n as mode_count from r where rn = 1""")
def histogram_mode_floor(spark, sf_dir):
    """The fullest bin as noise floor."""
    return stats.histogram_mode(events(spark, sf_dir), ["user_id"], "value", 2.5)


@query(f"""with {EVENTS}, w as (select *, cast(event_id % 7 + 1 as double) as w from e),
 c as (select user_id, value, event_id, sum(w) over (partition by user_id order by value, event_id rows unbounded preceding) as upto, sum(w) over (partition by user_id) as whole from w),
 r as (select *, row_number() over (partition by user_id order by upto, value, event_id) as rn from c where upto * 2 >= whole) select user_id, value as weighted_median from r where rn = 1""")
def weighted_median(spark, sf_dir):
    """Weighted median of each recording."""
    e = events(spark, sf_dir).withColumn("w", (F.col("event_id") % 7 + 1).cast("double"))
    return stats.weighted_median(e, ["user_id"], "value", "w", "event_id")


@query(f"""with {EVENTS}, z as (select user_id, event_id, cast(round(value * 100) as bigint) - 1000 as g from e),
 p as (select *, sum(g) over w as p, sum(g) over w - g as p0 from z window w as (partition by user_id order by event_id rows unbounded preceding)),
 l as (select *, min(p0) over (partition by user_id order by event_id rows unbounded preceding) as low from p),
 s as (select *, p - low as s from l), b as (select *, row_number() over (partition by user_id order by s desc, event_id) as rn from s)
 select b.user_id, cast(b.s as bigint) as best_sum, (select min(p.event_id) from p where p.user_id = b.user_id and p.event_id <= b.event_id and p.p0 = b.low) as first, b.event_id as last from b where rn = 1""")
def kadane_stretch(spark, sf_dir):
    """The stretch of the largest sum."""
    e = events(spark, sf_dir).withColumn("g", F.round(F.col("value") * 100).cast("long") - 1000)
    return stats.best_stretch(e, ["user_id"], "event_id", "g")


@query(f"""with {EVENTS}, z as (select user_id, event_id, cast(round(value) as bigint) as x from e),
 p as (select user_id, event_id, count(*) over u as n, sum(x) over u as s, sum(x * x) over u as q, count(*) over a as m, sum(x) over a as sa, sum(x * x) over a as qa from z
       window u as (partition by user_id order by event_id rows unbounded preceding), a as (partition by user_id)),
 e2 as (select *, round((q - s * s / n) + ((qa - q) - (sa - s) * (sa - s) / (m - n)), 6) as sse from
        (select user_id, event_id, cast(n as double) n, cast(s as double) s, cast(q as double) q, cast(m as double) m, cast(sa as double) sa, cast(qa as double) qa from p where n >= 3 and m - n >= 3)),
 r as (select *, row_number() over (partition by user_id order by sse, event_id) as rn from e2) select user_id, event_id as split_after, sse from r where rn = 1""")
def change_point(spark, sf_dir):
    """The best split in two levels."""
    e = events(spark, sf_dir).withColumn("x", F.round("value").cast("double"))
    return stats.change_point(e, ["user_id"], "event_id", "x", 3)


@query(f"""with {EVENTS} select event_id, round((value - avg(value) over w) / (stddev_pop(value) over w + 1e-12), 6) + 0.0 as score, value >= 0.8 * median(value) over w as sharp_enough
 from e window w as (partition by user_id)""")
def standardized_scores(spark, sf_dir):
    """Standard scores and the gate at 0.8 of the median (E5, B2)."""
    w = Window.partitionBy("user_id")
    return events(spark, sf_dir).select("event_id", r6(stats.standardized(F.col("value"), w)).alias("score"), (F.col("value") >= 0.8 * F.median("value").over(w)).alias("sharp_enough"))


_KYMO = f"{EVENTS}, k as (select cast(user_id % 5 as bigint) as vessel, cast((us // 3600000000) % 24 as bigint) as t, cast(user_id % 8 as bigint) as s, cast(floor(avg(value) * 100) as double) as k from e group by 1, 2, 3)"


def _kymograph(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy((F.col("user_id") % 5).alias("vessel"), (F.floor(F.col("us") / 3600000000) % 24).alias("t"), (F.col("user_id") % 8).alias("s")).agg(F.floor(F.avg("value") * 100).cast("double").alias("k"))


@query(f"""with {_KYMO} select vessel, t, s, round(k - avg(k) over (partition by vessel, t) - avg(k) over (partition by vessel, s) + avg(k) over (partition by vessel), 6) + 0.0 as centred from k""")
def double_centred_kymograph(spark, sf_dir):
    """Rows and columns of a kymograph less their means (K4)."""
    return series.double_centred(_kymograph(spark, sf_dir), "vessel", "t", "s", "k").select("vessel", "t", "s", r6("centred").alias("centred"))


@query(f"""with {_KYMO}, l as (select vessel, n as lag, k, lead(k, cast(n as int)) over (partition by vessel, s, n order by t) as later from k, generate_series(1, 3) as g(n))
 select vessel, cast(lag as int) as lag, round(corr(k, later), 6) + 0.0 as corr, count(*) as pairs from l where later is not null group by 1, 2""")
def lag_correlation(spark, sf_dir):
    """Correlation of each place with itself later."""
    return series.lag_correlation(_kymograph(spark, sf_dir), "vessel", "t", "s", "k", [1, 2, 3]).select("vessel", "lag", r6("corr").alias("corr"), "pairs")


@query(f"""with {EVENTS}, n as (select user_id, event_id, case when event_type = 'error' then null else value end as v from e),
 w as (select *, last_value(case when v is not null then event_id end ignore nulls) over a as i0, last_value(v ignore nulls) over a as v0,
       first_value(case when v is not null then event_id end ignore nulls) over b as i1, first_value(v ignore nulls) over b as v1 from n
       window a as (partition by user_id order by event_id rows between unbounded preceding and current row), b as (partition by user_id order by event_id rows between current row and unbounded following))
 select event_id, round(case when i1 - i0 > 0 then v0 + (v1 - v0) * (event_id - i0) / (i1 - i0) else coalesce(v0, v1) end, 6) as filled from w""")
def interpolated_gaps(spark, sf_dir):
    """Missing values blended from the known ones on both sides."""
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return series.interpolated(e, ["user_id"], "event_id", "v").select("event_id", F.round("filled", 6).alias("filled"))


@query("""select cast(label as bigint) as label, cast(json_extract_string(props, '$.k') as bigint) % 2 as half, count(*) as n, round(avg(value), 6) as mean
 from events join (select distinct label from embeddings) on event_id % 10 = label group by 1, 2""")
def broadcast_constants(spark, sf_dir):
    """Constants of a small table joined to every row."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label")).distinct()
    e = events(spark, sf_dir).withColumn("label", F.col("event_id") % 10).withColumn("half", F.get_json_object("props", "$.k").cast("long") % 2)
    return e.join(labels, "label").groupBy("label", "half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""with {EVENTS}, b as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as pos, value from e),
 h as (select *, pos - lag(pos) over (partition by user_id order by pos) as gap from b where value > 12),
 r as (select *, sum(case when gap > 3 then 1 else 0 end) over (partition by user_id order by pos rows unbounded preceding) as run from h)
 select user_id, min(event_id) as first, max(event_id) as last, count(*) as bright from r group by user_id, run""")
def bright_runs(spark, sf_dir):
    """Bright runs, merged across short gaps."""
    w = Window.partitionBy("user_id").orderBy("pos")
    e = events(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("value > 12")
    rows = e.withColumn("run", stats.islands(F.coalesce(F.col("pos") - F.lag("pos").over(w) > 3, F.lit(False)), w))
    return rows.groupBy("user_id", "run").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("bright")).drop("run")


@query(f"""with {EVENTS}, s as (select user_id, abs(value - lag(value) over (partition by user_id order by event_id)) as step, lead(value, 2) over (partition by user_id order by event_id) - value as closure from e)
 select user_id, round(median(step), 6) as step_median, round(quantile_cont(step, 0.9), 6) as step_p90, round(median(abs(closure)), 6) as closure_median from s group by 1""")
def residual_steps(spark, sf_dir):
    """Medians and tails of steps between neighbours and over triples."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = events(spark, sf_dir).select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("step"), (F.lead("value", 2).over(w) - F.col("value")).alias("closure"))
    return s.groupBy("user_id").agg(F.round(F.median("step"), 6).alias("step_median"), F.round(F.percentile("step", F.lit(0.9)), 6).alias("step_p90"), F.round(F.median(F.abs("closure")), 6).alias("closure_median"))


@query(f"""with {EVENTS}, s as (select *, case when value > 4 then 'locked' else 'lost' end as state from e),
 c as (select *, lag(state) over (partition by user_id order by us, event_id) as before from s)
 select user_id, event_id, state from c where before is null or before <> state""")
def state_changes(spark, sf_dir):
    """Only the changes of a stream's state."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    s = events(spark, sf_dir).withColumn("state", F.when(F.col("value") > 4, "locked").otherwise("lost"))
    return s.withColumn("before", F.lag("state").over(w)).filter("before is null or before <> state").select("user_id", "event_id", "state")


@query(f"""with {EVENTS}, c as (select user_id, event_id, us, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as epoch from e)
 select user_id, cast(epoch as bigint) as epoch, count(*) as frames, min(event_id) as first from c group by 1, 2""")
def relock_epochs(spark, sf_dir):
    """Frames between control messages in the stream."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("epoch", stats.islands(F.col("event_type") == "signup", w))
    return e.groupBy("user_id", "epoch").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first"))


@query(f"""with {EVENTS}, r as (select *, row_number() over (partition by user_id order by us desc, event_id desc) as rn, count(*) over (partition by user_id) as n, min(us) over (partition by user_id) as t0, max(us) over (partition by user_id) as t1 from e)
 select user_id, event_id, round((n - rn) * ((t1 - t0) / 1e6 / greatest(n - 1, 1)), 3) as due_s from r where rn <= 20""")
def retimed_newest(spark, sf_dir):
    """The newest frames kept, timed by the rate that was reached."""
    w = Window.partitionBy("user_id")
    r = events(spark, sf_dir).withColumn("rn", F.row_number().over(w.orderBy(F.desc("us"), F.desc("event_id")))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("t0", F.min("us").over(w)).withColumn("t1", F.max("us").over(w))
    step = (F.col("t1") - F.col("t0")) / 1e6 / F.greatest(F.col("n") - 1, F.lit(1))
    return r.filter("rn <= 20").select("user_id", "event_id", F.round((F.col("n") - F.col("rn")) * step, 3).alias("due_s"))


@query("""select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.05), 6) as p05, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.95), 6) as p95, round(median(l_quantity), 6) as quantity
 from lineitem group by 1""")
def quantiles_of_large_groups(spark, sf_dir):
    """Exact quantiles of three groups that hold all rows, by narrowing ranks down instead of one buffer a group."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    small = 1000  # groups beyond it are narrowed down: here all
    wanted = {"p05": ("l_extendedprice", 0.05), "p50": ("l_extendedprice", 0.5), "p95": ("l_extendedprice", 0.95), "quantity": ("l_quantity", 0.5)}
    got = quantiles.grouped_quantiles(li, ["l_returnflag"], wanted, quantiles.large_groups(li, ["l_returnflag"], small), small)
    n = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return got.join(n, "l_returnflag").select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in wanted])
