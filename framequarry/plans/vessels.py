"""Queries on curves, the profiles across them, kymographs, graphs of vessels and fits of their models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import chains, graph, kernels, nets, profiles, spatial, velocity
from ..operators import pictures as P
from .pictures import PX, pictures
from .registry import events, query, r6, table
from .rows import _ENDS, _NEAR, _POS, _curves, _ends, _near, end_links
from .series import _KYMO, _kymograph
from .table_frames import numbers, patterns


@query(f"""with {_POS}, a as (select *, sqrt(pow(value - lag(value) over w, 2) + pow(y - lag(y) over w, 2)) as step from c window w as (partition by user_id order by pos)),
 s as (select *, sum(coalesce(step, 0)) over (partition by user_id order by pos) as arc, sum(coalesce(step, 0)) over (partition by user_id) as total from a)
 select user_id, min(event_id) as first, max(event_id) as last, count(*) as points, round(max(arc) - min(arc), 6) as length from s where round(arc, 9) between round(0.25 * total, 9) and round(0.75 * total, 9) group by 1""")
def cut_stretch(spark, sf_dir):
    """The middle half of each curve by length."""
    from ..operators.curves import steps

    s = steps(_curves(spark, sf_dir).withColumn("x", F.col("value")), "user_id", "pos", "x", "y").withColumn("total", F.sum("step").over(Window.partitionBy("user_id")))
    s = s.filter(F.round("arc", 9).between(F.round(F.col("total") * 0.25, 9), F.round(F.col("total") * 0.75, 9)))
    return s.groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("points"), F.round(F.max("arc") - F.min("arc"), 6).alias("length"))


_BRIDGE = f"""{_ENDS}, u as (select user_id, tip, x, y, dx / sqrt(dx * dx + dy * dy) as tx, dy / sqrt(dx * dx + dy * dy) as ty from t where dx <> 0 or dy <> 0),
 j as (select a.user_id, a.x as x0, a.y as y0, a.tx as tx0, a.ty as ty0, b.x as x1, b.y as y1, -b.tx as tx1, -b.ty as ty1, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from u a join u b on b.user_id = a.user_id + 1 and a.tip = 1 and b.tip = 0)"""


@query(f"""with {_BRIDGE}, s as (select j.*, k.k as place, k.k / 8.0::double as s from j, range(1, 8) k(k))
 select user_id, place, round((2 * s * s * s - 3 * s * s + 1) * x0 + (s * s * s - 2 * s * s + s) * d * tx0 + (3 * s * s - 2 * s * s * s) * x1 + (s * s * s - s * s) * d * tx1, 6) + 0.0 as x,
 round((2 * s * s * s - 3 * s * s + 1) * y0 + (s * s * s - 2 * s * s + s) * d * ty0 + (3 * s * s - 2 * s * s * s) * y1 + (s * s * s - s * s) * d * ty1, 6) + 0.0 as y from s""")
def hermite_bridges(spark, sf_dir):
    """Cubic bridges from the end of each curve to the beginning of the next, along both directions."""
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    u = _ends(spark, sf_dir).filter("dx <> 0 or dy <> 0").select("user_id", "tip", "x", "y", (F.col("dx") / size).alias("tx"), (F.col("dy") / size).alias("ty"))
    a = u.filter("tip = 1").select("user_id", *[F.col(c).alias(f"{c}0") for c in ("x", "y", "tx", "ty")])
    b = u.filter("tip = 0").select((F.col("user_id") - 1).alias("user_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (-F.col("tx")).alias("tx1"), (-F.col("ty")).alias("ty1"))
    j = a.join(b, "user_id").withColumn("d", F.sqrt((F.col("x0") - F.col("x1")) ** 2 + (F.col("y0") - F.col("y1")) ** 2))
    j = j.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("s", F.col("place") / 8.0)
    s = F.col("s")
    at = lambda c: (2 * s * s * s - 3 * s * s + 1) * F.col(f"{c}0") + (s * s * s - 2 * s * s + s) * F.col("d") * F.col(f"t{c}0") + (3 * s * s - 2 * s * s * s) * F.col(f"{c}1") + (s * s * s - s * s) * F.col("d") * F.col(f"t{c}1")
    return j.select("user_id", F.col("place").cast("long").alias("place"), r6(at("x")).alias("x"), r6(at("y")).alias("y"))


@query(f"""with {_POS}, t as (select *, lead(value) over w - lag(value) over w as dx, lead(y) over w - lag(y) over w as dy from c window w as (partition by user_id order by pos)), k as (select *, sqrt(dx * dx + dy * dy) as d from t where dx is not null)
 select event_id, o.o as lane, round(value - dy / d * (o.o - 2) * 0.75, 6) + 0.0 as x, round(y + dx / d * (o.o - 2) * 0.75, 6) + 0.0 as y from k, range(0, 5) o(o) where d > 0""")
def lumen_grid(spark, sf_dir):
    """Five lanes beside each point of a curve, along its normal."""
    w = Window.partitionBy("user_id").orderBy("pos")
    t = _curves(spark, sf_dir).withColumn("dx", F.lead("value").over(w) - F.lag("value").over(w)).withColumn("dy", F.lead("y").over(w) - F.lag("y").over(w)).filter("dx is not null")
    t = t.withColumn("d", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).filter("d > 0").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(4))))
    off = (F.col("lane") - 2) * 0.75
    return t.select("event_id", F.col("lane").cast("long").alias("lane"), r6(F.col("value") - F.col("dy") / F.col("d") * off).alias("x"), r6(F.col("y") + F.col("dx") / F.col("d") * off).alias("y"))


@query(f"""with {_KYMO}, b as (select *, avg(k) over (partition by vessel, s) as bar from k), f as (select vessel, t, regr_slope(k, bar) as c1, regr_intercept(k, bar) as c0, count(*) as n, var_pop(bar) as v from b group by 1, 2)
 select b.vessel, b.t, b.s, round(k - c0 - c1 * bar, 5) + 0.0 as moving from b join f using (vessel, t) where n >= 5 and v > 1e-9""")
def static_removed(spark, sf_dir):
    """Each row of a kymograph less what its offset and the mean row explain (K3)."""
    k = _kymograph(spark, sf_dir)
    b = k.join(k.groupBy("vessel", "s").agg(F.avg("k").alias("bar")), ["vessel", "s"])
    f = b.groupBy("vessel", "t").agg(F.regr_slope("k", "bar").alias("c1"), F.regr_intercept("k", "bar").alias("c0"), F.count(F.lit(1)).alias("n"), F.var_pop("bar").alias("v"))
    return b.join(f, ["vessel", "t"]).filter("n >= 5 and v > 1e-9").select("vessel", "t", "s", (F.round(F.col("k") - F.col("c0") - F.col("c1") * F.col("bar"), 5) + F.lit(0.0)).alias("moving"))


@query(f"""with {PX}, l as (select vec_id, i, v, lag(v) over w as a, lead(v) over w as d, row_number() over (partition by vec_id order by v desc, i) as rn from px where i between 0 and 63 window w as (partition by vec_id order by i))
 select vec_id, round(i + case when a is null or d is null or a - 2 * v + d >= 0 then 0 else greatest(least(0.5 * (a - d) / (a - 2 * v + d), 1), -1) end, 6) as peak from l where rn = 1""")
def subpixel_peaks(spark, sf_dir):
    """The top of a Gaussian through the logs of a peak and its neighbours (K6)."""
    p = pictures(spark, sf_dir).withColumn("top", F.array_max("v")).withColumn("k", F.array_position("v", F.col("top")).cast("int"))
    side = lambda n: F.get("v", F.col("k") - 1 + n)
    a, d = side(-1), side(1)
    bend = a - 2 * F.col("top") + d
    shift = F.when(a.isNull() | d.isNull() | (F.col("k") == 1) | (bend >= 0), 0.0).otherwise(F.greatest(F.least(0.5 * (a - d) / bend, F.lit(1.0)), F.lit(-1.0)))
    return p.select(F.col("id").alias("vec_id"), F.round(F.col("k") - 1 + shift, 6).alias("peak"))


@query(f"""with {_POS}, n as (select user_id, event_id, value, ntile(5) over (partition by user_id order by y, event_id) as band from c) select user_id, band, count(*) as samples, round(avg(value), 6) as v, round(median(value), 6) as middle from n group by 1, 2""")
def lane_profile(spark, sf_dir):
    """Velocity in five bands across each vessel."""
    band = F.ntile(5).over(Window.partitionBy("user_id").orderBy("y", "event_id"))
    n = _curves(spark, sf_dir).withColumn("band", band)
    return n.groupBy("user_id", "band").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 6).alias("v"), F.round(F.median("value"), 6).alias("middle")).withColumn("band", F.col("band").cast("long"))


@query(f"""with {_POS}, m as (select user_id, count(*) as length, avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as b, count(*) filter (event_type = 'click') as n from c group by 1)
 select user_id, length, round(coalesce(case when n >= 10 then a end, b), 6) as v, case when n >= 10 then 'primary' when b is not null then 'fallback' else 'none' end as method,
 case when user_id % 2 = 1 and coalesce(case when n >= 10 then a end, b) > 5 then 'in' when user_id % 2 = 0 and coalesce(case when n >= 10 then a end, b) < 5 then 'in' else 'out' end as at_joint from m where length >= 20""")
def measured_edges(spark, sf_dir):
    """Edges long enough, measured by one way or else by the other; and whether they flow into the joint."""
    kind = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    m = _curves(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("length"), kind("click").alias("a"), kind("view").alias("b"), F.count_if(F.col("event_type") == "click").alias("n")).filter("length >= 20")
    m = m.withColumn("first", F.when(F.col("n") >= 10, F.col("a"))).withColumn("v", F.coalesce("first", "b"))
    method = F.when(F.col("n") >= 10, "primary").when(F.col("b").isNotNull(), "fallback").otherwise("none")
    into = F.when((F.col("user_id") % 2 == 1) & (F.col("v") > 5), "in").when((F.col("user_id") % 2 == 0) & (F.col("v") < 5), "in").otherwise("out")
    return m.select("user_id", "length", F.round("v", 6).alias("v"), method.alias("method"), into.alias("at_joint"))


@query(f"""with {_POS}, a as (select user_id, list(event_id order by pos) as ids from c group by 1) select x.user_id, array_to_string(list_concat(list_reverse(x.ids[1:4]), [-1], z.ids[1:4]), ',') as path, least(len(x.ids), 4) as joint from a x join a z on z.user_id = x.user_id + 1""")
def joint_paths(spark, sf_dir):
    """A path through a joint: one end reversed, the bridge, the other end."""
    a = _curves(spark, sf_dir).filter("pos <= 4").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id"))).alias("p")).select("user_id", F.col("p.event_id").alias("ids"))
    z = a.select((F.col("user_id") - 1).alias("user_id"), F.col("ids").alias("next"))
    path = F.concat(F.reverse("ids"), F.array(F.lit(-1).cast("long")), "next")
    return a.join(z, "user_id").select("user_id", F.array_join(path.cast("array<string>"), ",").alias("path"), F.size("ids").cast("long").alias("joint"))


@query("""with s as (select l_orderkey as edge, l_linenumber, l_partkey as node, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem),
 n as (select *, lead(node) over (partition by edge order by k) as next from s) select edge, k as segment, least(node, next) as a, greatest(node, next) as b from n where next is not null and next <> node""")
def edge_segments(spark, sf_dir):
    """Edges cut at the nodes that they pass, without loops."""
    w = Window.partitionBy("edge").orderBy("l_linenumber", "node", "l_suppkey", "l_extendedprice")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), "l_linenumber", F.col("l_partkey").alias("node"), "l_suppkey", "l_extendedprice")
    n = s.withColumn("segment", F.row_number().over(w)).withColumn("next", F.lead("node").over(w)).filter("next is not null and next <> node")
    return n.select("edge", F.col("segment").cast("long").alias("segment"), F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"))


@query("""with e as (select l_orderkey * 10 + l_linenumber as edge, l_partkey as u, l_suppkey as v, l_quantity as len, l_discount * 10 as cutat from lineitem), k as (select * from e where u <> v),
 p as (select edge * 2 as edge, u, -edge as v, len * cutat as len from k where cutat between 0.25 and 0.75 union all select edge * 2 + 1, -edge, v, len * (1 - cutat) from k where cutat between 0.25 and 0.75 union all select edge * 2, u, v, len from k where cutat not between 0.25 and 0.75)
 select edge, least(u, v) as a, greatest(u, v) as b, u > v as reversed, round(len, 6) as length from p""")
def split_edges(spark, sf_dir):
    """Edges split where a step lies far enough from both ends; loops go, and each edge points from its smaller node."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_quantity").alias("len"), (F.col("l_discount") * 10).alias("cut")).filter("u <> v")
    whole = F.array(F.struct((F.col("edge") * 2).alias("edge"), "u", "v", "len"))
    halves = F.array(F.struct((F.col("edge") * 2).alias("edge"), F.col("u"), (-F.col("edge")).alias("v"), (F.col("len") * F.col("cut")).alias("len")), F.struct((F.col("edge") * 2 + 1).alias("edge"), (-F.col("edge")).alias("u"), F.col("v"), (F.col("len") * (1 - F.col("cut"))).alias("len")))
    p = e.select(F.explode(F.when(F.col("cut").between(0.25, 0.75), halves).otherwise(whole)).alias("p")).select("p.*")
    return p.select("edge", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.col("u") > F.col("v")).alias("reversed"), F.round("len", 6).alias("length"))


@query("""with recursive p as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings), r as (select a.vec_id as a, b.vec_id as b from p a join p b on a.vec_id <> b.vec_id where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0001),
 t(node, label) using key (node) as (select distinct a, a from r union select r.b, min(t.label) from t join r on t.node = r.a join recurring.t k on k.node = r.b where t.label < k.label group by r.b),
 m as (select p.vec_id, coalesce(t.label, p.vec_id) as into_, x, y from p left join t on t.node = p.vec_id) select into_ as node, count(*) as members, round(avg(x), 6) + 0.0 as x, round(avg(y), 6) + 0.0 as y from m group by 1""")
def merged_close_nodes(spark, sf_dir):
    """Nodes that chains of close pairs connect become one, at their mean place."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    pairs = _near(spark, sf_dir, 0.01).filter("a < b").select("a", "b")
    m = graph.merged_nodes(pairs, p)
    return m.groupBy(F.col("into").alias("node")).agg(F.count(F.lit(1)).alias("members"), r6(F.first("x")).alias("x"), r6(F.first("y")).alias("y"))


@query("""with px as (select distinct l_suppkey as o, l_partkey as p, s_nationkey as node from lineitem join supplier on s_suppkey = l_suppkey), x as (select a.o as a, b.o as b, a.p as p from px a join px b on a.p = b.p and a.o < b.o where a.node <> b.node),
 g as (select *, case when p - lag(p) over w > 6 then 1 else 0 end as new from x window w as (partition by a, b order by p)), c as (select *, sum(new) over (partition by a, b order by p rows unbounded preceding) as k from g)
 select a, b, min(p) as first, count(*) as pixels from c group by a, b, k""")
def edge_crossings(spark, sf_dir):
    """Where edges without a common node share pixels, neighbours taken together."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o"), F.col("s_nationkey").alias("node"))
    px = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("o"), F.col("l_partkey").alias("p")).distinct().join(own, "o")
    return spatial.shared_runs(px, "o", "p", "node", 6)


@query(f"""with {_NEAR}, e as (select label, min(vec_id) as tip from p group by 1 union select label, max(vec_id) from p group by 1), n as (select e.label, e.tip, r.b, r.lb, r.d, row_number() over (partition by e.tip order by r.d, r.b) as rn from e join r on r.a = e.tip and r.lb <> e.label)
 select label, tip, b as onto, lb as edge, round(d, 6) as gap, d <= 0.02 as joined from n where rn = 1""")
def faint_bridges(spark, sf_dir):
    """Ends of faint tracks, each with the nearest mapped point of another edge, and whether the gap is bridged."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).select("label", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("tip"))
    # only the tips ask; they are among their labels' points
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    p = p.join(e.select(F.col("tip").alias("vec_id"), F.lit(True).alias("is_tip")), "vec_id", "left").withColumn("is_tip", F.col("is_tip").isNotNull())
    near = F.col("near")[0]
    n = spatial.nearest_in_reach(p, "vec_id", "x", "y", 0.04, 1, other="label", asked=F.col("is_tip")).select(F.col("a").alias("tip"), F.struct(near["dist"].alias("d"), near["b"].alias("b"), near["other"].cast("int").alias("lb")).alias("x"))
    return e.join(n, "tip").select("label", "tip", F.col("x.b").alias("onto"), F.col("x.lb").alias("edge"), F.round("x.d", 6).alias("gap"), (F.col("x.d") <= 0.02).alias("joined"))


@query("""select l_suppkey as edge, round(pow(covar_pop(exp(-pow(l_linenumber - 2, 2) / 4.0), l_quantity), 2) / var_pop(exp(-pow(l_linenumber - 2, 2) / 4.0)) * count(*), 5) as gain, round(sum(exp(-pow(l_linenumber - 2, 2) / 4.0) * (l_quantity - 25)) / sum(exp(-pow(l_linenumber - 2, 2) / 2.0)), 6) + 0.0 as share,
 round(sum((1 - l_discount) * (pow(l_quantity - 24, 2) - pow(l_quantity - 26, 2))) / 2, 5) + 0.0 as zone_gain, round(sum(-(l_linenumber - 2) / 2.0 * exp(-pow(l_linenumber - 2, 2) / 4.0) * (l_quantity - 25)) / sum(pow((l_linenumber - 2) / 2.0 * exp(-pow(l_linenumber - 2, 2) / 4.0), 2)), 6) + 0.0 as shift from lineitem group by 1""")
def edge_tests(spark, sf_dir):
    """Gain beyond a flat background, share of a bridge, gain of a link in its zone, and the shift that residuals ask for."""
    far = F.col("l_linenumber") - 2
    p, q = F.exp(-F.pow(far, F.lit(2)) / 4.0), F.col("l_quantity")
    slope = far / 2.0 * p
    zone = (1 - F.col("l_discount")) * (F.pow(q - 24, F.lit(2)) - F.pow(q - 26, F.lit(2)))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("edge"))
    return g.agg(F.round(F.pow(F.covar_pop(p, q), F.lit(2)) / F.var_pop(p) * F.count(F.lit(1)), 5).alias("gain"), r6(F.sum(p * (q - 25)) / F.sum(p * p)).alias("share"), (F.round(F.sum(zone) / 2, 5) + F.lit(0.0)).alias("zone_gain"), r6(F.sum(-slope * (q - 25)) / F.sum(slope * slope)).alias("shift"))


@query(f"""with {PX}, b as (select vec_id, v, exp(-pow(y - 3.5, 2) / 4.0) as p, exp(-pow(y - 2, 2) / 2.0) as q, exp(-pow(y - 5, 2) / 2.0) as r from px), s as (select vec_id, sum(v * v) as vv, sum(p * p) as pp, sum(p * v) as pv, sum(q * q) as qq, sum(r * r) as rr, sum(q * r) as qr, sum(q * v) as qv, sum(r * v) as rv from b group by 1),
 e as (select vec_id, vv - pv * pv / pp as one, vv - ((qv * rr - rv * qr) * qv + (rv * qq - qv * qr) * rv) / (qq * rr - qr * qr) as two from s) select vec_id, round(one, 6) as one, round(two, 6) as two, 64 * ln(one / two) > 2 * ln(64) as split from e""")
def split_tests(spark, sf_dir):
    """Whether two parallel vessels explain a picture better than one, for the parameters they take."""
    i = F.sequence(F.lit(0), F.lit(63))
    row = lambda at, w: F.transform(i, lambda k: F.exp(-F.pow(F.floor(k / 8) - at, F.lit(2)) / w))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    c = pictures(spark, sf_dir).withColumn("p", row(3.5, 4.0)).withColumn("q", row(2, 2.0)).withColumn("r", row(5, 2.0))
    s = c.select("id", dot("v", "v").alias("vv"), *[dot(a, b).alias(a + b) for a, b in (("p", "p"), ("p", "v"), ("q", "q"), ("r", "r"), ("q", "r"), ("q", "v"), ("r", "v"))])
    one = F.col("vv") - F.col("pv") ** 2 / F.col("pp")
    two = F.col("vv") - ((F.col("qv") * F.col("rr") - F.col("rv") * F.col("qr")) * F.col("qv") + (F.col("rv") * F.col("qq") - F.col("qv") * F.col("qr")) * F.col("rv")) / (F.col("qq") * F.col("rr") - F.col("qr") ** 2)
    return s.select(F.col("id").alias("vec_id"), F.round(one, 6).alias("one"), F.round(two, 6).alias("two"), (64 * F.log(one / two) > 2 * math.log(64)).alias("split"))


def _turns_sql(rounds: int) -> str:
    out = "h0 as (select l_suppkey, 0.0::double as h from lineitem group by 1)"
    for k in range(1, rounds + 1):
        out += f", a{k} as (select b.l_suppkey, sum(p * (q - h)) / sum(p * p) as a from b join h{k - 1} using (l_suppkey) group by 1), h{k} as (select b.l_suppkey, avg(q - a * p) as h from b join a{k} using (l_suppkey) group by 1)"
    return out


@query(f"with b as (select l_suppkey, l_quantity as q, exp(-pow(l_linenumber - 2, 2) / 4.0) as p from lineitem), {_turns_sql(3)} select l_suppkey as flow, round(a, 6) + 0.0 as amplitude, round(h, 6) + 0.0 as haze from a3 join h3 using (l_suppkey)")
def amplitude_and_haze(spark, sf_dir):
    """A vessel's strength and the haze over it, fitted in turns."""
    b = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q"), F.exp(-F.pow(F.col("l_linenumber") - 2, F.lit(2)) / 4.0).alias("p"))
    # what a turn needs of the rows are five sums, so rows are read once
    s = b.groupBy("l_suppkey").agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.count(F.lit(1)).alias("n"))
    a, h = None, F.lit(0.0)
    for _ in range(3):
        a = (F.col("pq") - h * F.col("sp")) / F.col("pp")
        h = (F.col("sq") - a * F.col("sp")) / F.col("n")
    return s.select(F.col("l_suppkey").alias("flow"), r6(a).alias("amplitude"), r6(h).alias("haze"))


@query(f"""with recursive {_POS}, f(user_id, pos, state, taken) as (select user_id, pos, value, 1 from c where pos = 1 union all select c.user_id, c.pos, case when abs(c.value - f.state) <= 8 then round(0.9 * f.state + 0.1 * c.value, 9) else f.state end, case when abs(c.value - f.state) <= 8 then f.taken + 1 else f.taken end from f join c on c.user_id = f.user_id and c.pos = f.pos + 1)
 select user_id, round(arg_max(state, pos), 5) as state, cast(arg_max(taken, pos) as bigint) as taken from f group by 1""")
def frame_chain(spark, sf_dir):
    """Each frame fitted from the last accepted one: a fold over sorted rows that holds one state, however long the recording."""
    c = events(spark, sf_dir).select("user_id", "event_id", "value").repartition("user_id").sortWithinPartitions("user_id", "event_id")

    def fold(batches):
        key, state, taken = None, 0.0, 0
        for batch in batches:
            out = []
            for user, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if user != key:
                    if key is not None:
                        out.append((key, state, taken))
                    key, state, taken = user, value, 1
                elif abs(value - state) <= 8:
                    state, taken = round(0.9 * state + 0.1 * value, 9), taken + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["user_id", "state", "taken"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state]), pa.array([taken])], names=["user_id", "state", "taken"])

    return c.mapInArrow(fold, "user_id long, state double, taken long").withColumn("state", F.round("state", 5))


@query()
def smooth_curves(spark, sf_dir):
    """Splines that smooth each curve: points at equal distance, length and the sharpest bend (L1)."""

    def work(x, y):
        xy, bend = profiles.smooth_curve(np.column_stack([x, y]), spacing=5.0)
        return [(len(xy), float(np.hypot(*np.diff(xy, axis=0).T).sum()), float(np.abs(bend).max()))]

    c = _curves(spark, sf_dir)
    return profiles.per_curve(c, "user_id", "pos", ["value", "y"], work, "points long, length double, sharpest double")


@query()
def natural_splines(spark, sf_dir):
    """Splines through the first eight numbers of each vector, halfway between them."""
    k, at = np.arange(8.0), np.arange(7) + 0.5
    got = P.run(pictures(spark, sf_dir), lambda a: {"out": np.array([profiles.natural_spline(k, p[0], at) for p in a])}, "out array<double>")
    return got.select(F.col("id").alias("vec_id"), F.transform("out", lambda x: F.round(x, 6)).alias("halfway"))


@query()
def profile_widths(spark, sf_dir):
    """Width at half depth, and of a blurred box fitted to it, of each vector read as a profile (L2, L3)."""

    def work(a):
        out = {n: [] for n in ("half_width", "depth", "fitted", "explained")}
        for p in a.reshape(len(a), -1):
            p = np.convolve(np.pad(p, 4, mode="edge"), np.ones(9) / 9, "valid")
            t = np.arange(len(p)) - len(p) / 2.0
            w, c, d = profiles.half_width(p, t)
            q, r2 = profiles.fit_box(p, t, w if w == w else 6.0, c if c == c else 0.0, rounds=25)
            for n, x in zip(out, (w, d, q[4], r2), strict=True):
                out[n].append(x)
        return out

    got = P.run(pictures(spark, sf_dir), work, "half_width double, depth double, fitted double, explained double")
    return got.select(F.col("id").alias("vec_id"), *[F.round(c, 4).alias(c) for c in ("half_width", "depth", "fitted", "explained")])


@query()
def diameter_phantoms(spark, sf_dir):
    """A vessel for each block of vectors, as wide as the place of their largest number says, measured along its length: the middle of what is valid."""
    from ..operators.synthetic import vessel_phantom

    def task(batches):
        for batch in batches:
            rows = []
            for i, _, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = (3, 4, 6, 8, 10, 14, 18, 24)[int(np.argmax(e)) % 8]
                image, xy = vessel_phantom(width, seed=numbers(e))
                d = profiles.diameters(image, xy, width)
                ok = d["valid"]
                rows.append((i, float(width), float(np.median(d["width"][ok])) if ok.any() else None, float(np.median(d["fitted"][ok])) if ok.any() else None, float(ok.mean())))
            kinds = (pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["phantom", "width", "half_width", "fitted", "valid"])

    return patterns(spark, sf_dir).mapInArrow(task, "phantom long, width double, half_width double, fitted double, valid double")


@query()
def despiked_points(spark, sf_dir):
    """Curves without the points at which they turn back."""
    work = lambda x, y: [(len(x), len(profiles.despiked(np.column_stack([x, y]))))]
    return profiles.per_curve(_curves(spark, sf_dir), "user_id", "pos", ["value", "y"], work, "points long, kept long")


@query()
def tracked_ridges(spark, sf_dir):
    """Paths from the strongest pixel of each picture along its ridge, both ways."""
    bank = P.line_kernels(0.9, 2.0, 2, 8)

    def work(a):
        strength, which = P.oriented(a, bank)
        out = {"points": [], "evidence": []}
        for s, w in zip(strength, which, strict=True):
            y, x = np.unravel_index(int(np.argmax(np.round(s, 9))), s.shape)
            heading = float(np.pi * w[y, x] / 8)
            paths = [profiles.tracked(s, (float(y), float(x)), heading + turn, least=0.3) for turn in (0.0, np.pi)]
            out["points"].append(len(paths[0]) + len(paths[1]) - 1)
            out["evidence"].append(float(s[y, x]))
        return out

    got = P.run(pictures(spark, sf_dir), work, "points long, evidence double")
    return got.select(F.col("id").alias("vec_id"), "points", r6("evidence").alias("evidence"))


@query()
def fitted_lines(spark, sf_dir):
    """One straight vessel rendered and fitted to each picture, from block means to pixels; then its width alone."""

    def work(a):
        out = {n: [] for n in ("error", "width", "strength", "refit")}
        for p in a:
            q, e = profiles.fit_line(p)
            _, f = profiles.fit_line(p, frozen=True, q=q)
            for n, x in zip(out, (e, math.exp(q[2]), q[3], f), strict=True):
                out[n].append(x)
        return out

    got = P.run(pictures(spark, sf_dir), work, "error double, width double, strength double, refit double")
    return got.select(F.col("id").alias("vec_id"), *[F.round(c, 4).alias(c) for c in ("error", "width", "strength", "refit")])


@query()
def kymograph_phantoms(spark, sf_dir):
    """The table's patterns flowing at a known speed, measured by every estimator, and across a joint."""
    from ..operators.synthetic import kymograph

    speeds = (-2.5, -1.2, 0.8, 1.5, 2.2, 6.0)

    def task(batches):
        for batch in batches:
            rows = []
            for i, kind, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = speeds[kind]
                k = kymograph(120, 100, v, seed=i, pattern=np.array(e))
                ridge, r2, height = velocity.ridge_speed(velocity.correlation_map(k, 12, 40))
                fast, score, chance = velocity.fast_speed(k, least=0.5, shuffles=5)
                ratio = velocity.transit_ratio(k, 50, v)[0]
                rows.append((i, v, velocity.by_lag(velocity.centred(k), 1), ridge, r2, height, velocity.flight_speed(k), fast, bool(score > 1.3 * chance), ratio))
            kinds = (pa.int64(), *[pa.float64()] * 7, pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["phantom", "speed", "by_rows", "ridge", "explained", "height", "flight", "fast", "beats_chance", "transit"])

    return patterns(spark, sf_dir).mapInArrow(task, "phantom long, speed double, by_rows double, ridge double, explained double, height double, flight double, fast double, beats_chance boolean, transit double")


@query()
def local_shifts(spark, sf_dir):
    """Each picture's own shift against its recording's mean, less the recording's middle."""
    px = pictures(spark, sf_dir)
    mean = px.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    both = px.join(mean, "label").select("id", "label", (2 * F.col("height")).alias("height"), "width", F.concat(F.col("m.m"), "v").alias("v"))

    def work(a):
        h = a.shape[1] // 2
        got = [kernels.phase_shift_2d(p[:h], p[h:]) for p in a]
        return {"dy": [g[0] for g in got], "dx": [g[1] for g in got], "response": [g[2] for g in got]}

    s = P.run(both, work, "dy double, dx double, response double", ("id", "label"))
    mid = s.groupBy("label").agg(F.median("dy").alias("my"), F.median("dx").alias("mx"))
    return s.join(mid, "label").select(F.col("id").alias("vec_id"), F.round(F.col("dy") - F.col("my"), 4).alias("dy"), F.round(F.col("dx") - F.col("mx"), 4).alias("dx"), F.round("response", 6).alias("response"))


@query()
def skeleton_edges(spark, sf_dir):
    """Skeletons of pictures as graphs: chains between junctions and free ends."""
    return nets.skeletons(pictures(spark, sf_dir), 0.0).withColumnRenamed("id", "vec_id")


def _matched(spark, sf_dir):
    """Ends as numbers 2 * curve + tip, matched by weight 4 - cost."""
    c = end_links(spark, sf_dir).select((F.col("ua") * 2 + F.col("ta")).alias("a"), (F.col("ub") * 2 + F.col("tb")).alias("b"), (4 - F.col("cost")).alias("w"))
    return nets.matching(cut(c), "a", "b", "w")


@query()
def end_matching(spark, sf_dir):
    """The matching of curve ends of the largest total weight, exact in every component (M9)."""
    return _matched(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query()
def consolidated_chains(spark, sf_dir):
    """Curves chained through their matched ends, cycles cut at the dearest link."""
    return chains.ranked_chains(cut(_matched(spark, sf_dir).select("a", "b", (4 - F.col("weight")).alias("cost"))))


@query()
def greedy_pairs(spark, sf_dir):
    """Ends joined greedily, the cheapest first."""
    c = end_links(spark, sf_dir).select((F.col("ua") * 2 + F.col("ta")).alias("a"), (F.col("ub") * 2 + F.col("tb")).alias("b"), "cost")
    return graph.greedy_matching(c, "a", "b", "cost").withColumn("cost", F.round("cost", 6))


@query()
def inferred_flow(spark, sf_dir):
    """Flows that are unknown on some edges, inferred where one alone is missing at a node."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 1000 + 1_000_000).alias("v"), F.when(F.col("o_orderkey") % 11 != 0, F.floor("o_totalprice").cast("double")).alias("q"))
    return graph.oriented(o, "edge", "u", "v", "q").select("edge", F.round("q", 3).alias("q"), "inferred")
