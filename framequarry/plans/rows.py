"""Queries on predicates, projections, ends of curves, nearest pairs, splits of data and text forms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import neighbours, ranks, spatial
from .pictures import PX, pictures
from .registry import EVENTS, events, query, r6, table

_POS = f"{EVENTS}, c as (select *, row_number() over (partition by user_id order by event_id) as pos, count(*) over (partition by user_id) as len, cast((event_id * 37) % 101 as double) as y from e)"


def _curves(spark, sf_dir):
    """Events as points (x = value, y) of one curve a user, in order: pos from 1, len of them."""
    w = Window.partitionBy("user_id")
    e = events(spark, sf_dir).withColumn("pos", F.row_number().over(w.orderBy("event_id"))).withColumn("len", F.count(F.lit(1)).over(w))
    return e.withColumn("y", ((F.col("event_id") * 37) % 101).cast("double"))


@query(f"""with {EVENTS} select event_id, value >= 2 and abs((event_id * 37) % 41 - 20) < 16 and abs((event_id * 53) % 41 - 20) < 16 as valid,
 case when value >= 2 and abs((event_id * 37) % 41 - 20) < 16 and abs((event_id * 53) % 41 - 20) < 16 then value else 0.0 end as weight from e""")
def patch_validity(spark, sf_dir):
    """A patch's shift counts if its response is enough and the shift is under a quarter of the patch."""
    n = F.col("event_id")
    ok = (F.col("value") >= 2) & (F.abs((n * 37) % 41 - 20) < 16) & (F.abs((n * 53) % 41 - 20) < 16)
    return events(spark, sf_dir).select("event_id", ok.alias("valid"), F.when(ok, F.col("value")).otherwise(0.0).alias("weight"))


@query(f"""with {EVENTS}, m as (select user_id, count(*) as n, count(*) filter (event_type = 'click') as used, round(avg(value), 3) as overlap, round(max(value), 1) as worst from e group by 1)
 select user_id, n as frames, used, case when used > 15 then overlap end as overlap, coalesce(case when used > 15 then worst end, -1.0) as worst, case when used > 15 then 'ok' else 'skipped' end as status from m""")
def summary_row(spark, sf_dir):
    """A nested record flattened to a summary row, rounded, with defaults."""
    m = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("event_type") == "click").alias("used"), F.avg("value").alias("o"), F.max("value").alias("w"))
    enough = F.col("used") > 15
    record = F.struct("frames", "used", F.when(enough, F.struct(F.struct(F.col("o").alias("overlap"), F.col("w").alias("worst")).alias("after"))).alias("quality"))
    r = m.select("user_id", record.alias("r"))
    return r.select("user_id", "r.frames", "r.used", F.round("r.quality.after.overlap", 3).alias("overlap"), F.coalesce(F.round("r.quality.after.worst", 1), F.lit(-1.0)).alias("worst"), F.when(F.col("r.quality").isNotNull(), "ok").otherwise("skipped").alias("status"))


@query("""select o_custkey as vessel, count(*) as samples, round(avg(o_totalprice), 6) as length_px, case when o_custkey % 3 = 0 then round(avg(o_totalprice) * 0.65, 6) end as length_um,
 case when o_custkey % 3 = 0 then round(max(o_totalprice) * 0.65 * 32, 4) end as speed_um_s from orders group by 1""")
def vessel_table(spark, sf_dir):
    """The table of vessels, with columns in real units where the scale is known."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("vessel")).agg(F.count(F.lit(1)).alias("samples"), F.avg("o_totalprice").alias("l"), F.max("o_totalprice").alias("v"))
    scale = F.when(F.col("vessel") % 3 == 0, 0.65)
    return o.select("vessel", "samples", F.round("l", 6).alias("length_px"), F.round(F.col("l") * scale, 6).alias("length_um"), F.round(F.col("v") * scale * 32, 4).alias("speed_um_s"))


@query("""select o_orderkey, substr('XTV', cast(o_orderkey % 3 as int) + 1, 1) as kind, case when o_totalprice < 1000 then 'unknown' when o_custkey % 10 < 3 and o_totalprice > 100000 then 'overlap' when o_custkey % 10 > 6 then 'joint' else 'unknown' end as verdict from orders""")
def junction_kinds(spark, sf_dir):
    """X, T or V by the number of ends within reach; overlap or joint by share and error."""
    share, size = F.col("o_custkey") % 10, F.col("o_totalprice")
    verdict = F.when(size < 1000, "unknown").when((share < 3) & (size > 100000), "overlap").when(share > 6, "joint").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring(F.lit("XTV"), (F.col("o_orderkey") % 3 + 1).cast("int"), F.lit(1)).alias("kind"), verdict.alias("verdict"))


_PTS = "p as (select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)"
_NEAR = f"{_PTS}, r as (select a.vec_id as a, a.label as la, b.vec_id as b, b.label as lb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from p a join p b on a.vec_id <> b.vec_id where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0016)"


def _near(spark, sf_dir, reach: float = 0.04):
    """a, la, b, lb, d: ordered pairs of points within reach, with their labels."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    pairs = spatial.radius_pairs(p, "vec_id", "x", "y", reach, ("label",))
    way = lambda a, b: pairs.select(F.col(a).alias("a"), F.col(f"label{a}").alias("la"), F.col(b).alias("b"), F.col(f"label{b}").alias("lb"), F.col("dist").alias("d"))
    return way("a", "b").union(way("b", "a"))


def _nearest(spark, sf_dir, k: int, vector: str | None = None, other: str | None = None, asked=None, reach: float = 0.04):
    """a, near: the ``k`` nearest of the points within reach."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label", "embedding")
    return spatial.nearest_in_reach(p, "vec_id", "x", "y", reach, k, vector, other, asked)


@query(f"""with {_NEAR}, q as (select p.vec_id, p.label, exists (select 1 from r where r.a = p.vec_id and r.lb % 2 = 0 and r.d <= 0.012) as shadowed from p where p.label % 2 = 1),
 o as (select *, row_number() over (partition by label order by vec_id) as pos from q), k as (select *, pos - row_number() over (partition by label order by pos) as run from o where not shadowed)
 select label, min(vec_id) as first, max(vec_id) as last, count(*) as points from k group by label, run having count(*) >= 3""")
def unshadowed_runs(spark, sf_dir):
    """Proposed points that no mapped vessel shadows, in runs that are long enough."""
    shadow = _near(spark, sf_dir).filter("lb % 2 = 0 and d <= 0.012").select(F.col("a").alias("vec_id")).distinct().withColumn("shadowed", F.lit(True))
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label").filter("label % 2 = 1").join(shadow, "vec_id", "left")
    w = Window.partitionBy("label")
    o = p.withColumn("pos", F.row_number().over(w.orderBy("vec_id"))).filter("shadowed is null")
    o = o.withColumn("run", F.col("pos") - F.row_number().over(w.orderBy("pos")))
    return o.groupBy("label", "run").agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("points")).filter("points >= 3").drop("run")


@query(f"""with {PX}, m as (select vec_id, sqrt(avg(v * v)) as rms from px group by 1) select label, i as pix, round(max(abs(v) / rms), 6) as ratio, max(abs(v) / rms) > 2.5 as failing from px join m using (vec_id) group by 1, 2""")
def failing_pixels(spark, sf_dir):
    """The largest ratio of each pixel over all pictures, and whether it fails."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) / F.size("v"))
    each = pictures(spark, sf_dir).withColumn("rms", size).select("label", F.posexplode(F.transform("v", lambda x: F.abs(x) / F.col("rms"))).alias("pix", "ratio"))
    by = each.groupBy("label", F.col("pix").cast("long").alias("pix")).agg(F.max("ratio").alias("ratio"))
    return by.select("label", "pix", F.round("ratio", 6).alias("ratio"), (F.col("ratio") > 2.5).alias("failing"))


@query("""with p as (select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
 n as (select a.vec_id as a, b.vec_id as b, b.label as lb, row_number() over (partition by a.vec_id order by sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.vec_id) as rn from p a join p b on a.label % 2 = 1 and b.label % 2 = 0),
 s as (select vec_id as p, lead(vec_id) over (partition by label order by vec_id) as q from p where label % 2 = 1)
 select s.p, s.q, x.lb as edge, case when x.b < y.b then 1 when x.b > y.b then -1 else 0 end as direction from s join n x on x.a = s.p and x.rn = 1 join n y on y.a = s.q and y.rn = 1 where x.lb = y.lb""")
def segment_on_edge(spark, sf_dir):
    """Segments whose ends lie nearest to one edge, and whether they run along it or against it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    near = neighbours.k_nearest(e.filter("label % 2 = 0"), "vec_id", "x", "y", 1, e.filter("label % 2 = 1"))
    n = near.join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b").select("a", F.struct("b", "lb").alias("x"))
    s = table(spark, sf_dir, "embeddings").filter("label % 2 = 1").select(F.col("vec_id").alias("p"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("q"))
    rows = s.join(n.select(F.col("a").alias("p"), F.col("x").alias("x")), "p").join(n.select(F.col("a").alias("q"), F.col("x").alias("z")), "q").filter("x.lb = z.lb")
    return rows.select("p", "q", F.col("x.lb").alias("edge"), F.when(F.col("x.b") < F.col("z.b"), 1).when(F.col("x.b") > F.col("z.b"), -1).otherwise(0).alias("direction"))


@query("""with e as (select o_orderkey as edge, o_custkey as u, o_orderkey % 1000 + 1000000 as v from orders), n as (select u as node, edge from e union all select v, edge from e),
 g as (select node, count(*) as degree, min(edge) as low, max(edge) as high from n group by 1), s as (select node, min(edge) as second from n join g using (node) where edge <> low group by 1)
 select e.edge, a.degree + b.degree - 2 as beside, least(case when a.low <> e.edge then a.low else x.second end, case when b.low <> e.edge then b.low else z.second end) as first
 from e join g a on a.node = e.u join g b on b.node = e.v left join s x on x.node = e.u left join s z on z.node = e.v""")
def edge_adjacency(spark, sf_dir):
    """Edges beside each edge at its two nodes: how many and the first, by what each node knows, so no pairs are made (C17, M2)."""
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 1000 + 1000000).alias("v"))
    n = e.select("edge", F.explode(F.array("u", "v")).alias("node"))
    two = n.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("edge").alias("low"))
    second = n.join(two, "node").filter("edge <> low").groupBy("node").agg(F.min("edge").alias("second"))
    two = two.join(second, "node", "left")
    at = lambda k: two.select(F.col("node").alias(k), F.col("degree").alias(f"{k}_n"), F.col("low").alias(f"{k}_1"), F.col("second").alias(f"{k}_2"))
    rows = e.join(at("u"), "u").join(at("v"), "v")
    other = lambda k: F.when(F.col(f"{k}_1") != F.col("edge"), F.col(f"{k}_1")).otherwise(F.col(f"{k}_2"))
    return rows.select("edge", (F.col("u_n") + F.col("v_n") - 2).alias("beside"), F.least(other("u"), other("v")).alias("first"))


@query("""with a as (select vec_id, [atan2(embedding[1]::double, embedding[2]::double), atan2(embedding[3]::double, embedding[4]::double), atan2(embedding[5]::double, embedding[6]::double), atan2(embedding[7]::double, embedding[8]::double)] as t from embeddings),
 k as (select * from (values (0, 1, 2, 3, 4), (1, 1, 3, 2, 4), (2, 1, 4, 2, 3)) as k(pairing, a, b, c, d)),
 v as (select vec_id, pairing, degrees(greatest(abs(pi() - acos(greatest(least(cos(t[a] - t[b]), 1), -1))), abs(pi() - acos(greatest(least(cos(t[c] - t[d]), 1), -1))))) as off from a, k)
 select vec_id, cast(arg_min(pairing, round(off, 9)) as int) as pairing, round(min(off), 5) as off, min(off) <= 35 as split from v group by 1""")
def crossing_split(spark, sf_dir):
    """The pairing of four ends whose pairs run straightest on, and whether straight enough to split the crossing."""
    turn = lambda i, j: math.pi - F.acos(F.greatest(F.least(F.cos(F.col("t")[i] - F.col("t")[j]), F.lit(1.0)), F.lit(-1.0)))
    angles = F.array(*[F.atan2(F.col("embedding")[2 * k].cast("double"), F.col("embedding")[2 * k + 1].cast("double")) for k in range(4)])
    a = table(spark, sf_dir, "embeddings").select("vec_id", angles.alias("t"))
    three = F.array(*[F.struct(F.degrees(F.greatest(F.abs(turn(i, j)), F.abs(turn(p, q)))).alias("off"), F.lit(n).alias("pairing")) for n, (i, j, p, q) in enumerate(((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2)))])
    best = F.array_min(F.transform(three, lambda s: F.struct(F.round(s["off"], 9).alias("k"), s["pairing"].alias("pairing"), s["off"].alias("off"))))
    return a.withColumn("b", best).select("vec_id", F.col("b.pairing").alias("pairing"), F.round(F.col("b.off"), 5).alias("off"), (F.col("b.off") <= 35).alias("split"))


@query(f"""with {_NEAR}, f as (select r.a, r.b, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(x.embedding[k]::double - z.embedding[k]::double, 2)))) as dist from r join embeddings x on x.vec_id = r.a join embeddings z on z.vec_id = r.b),
 n as (select *, row_number() over (partition by a order by dist, b) as rn, lead(dist) over (partition by a order by dist, b) as second from f) select a, b, round(dist, 6) as dist, round(dist / second, 6) as ratio from n where rn = 1 and dist < 0.95 * second""")
def ratio_test_matches(spark, sf_dir):
    """The nearest descriptor among those at hand, if it is clearly nearer than the second."""
    n = _nearest(spark, sf_dir, 2, "embedding").select("a", F.col("near")[0]["b"].alias("b"), F.col("near")[0]["dist"].alias("dist"), F.get("near", F.lit(1))["dist"].alias("second")).filter("dist < 0.95 * second")
    return n.select("a", "b", F.round("dist", 6).alias("dist"), F.round(F.col("dist") / F.col("second"), 6).alias("ratio"))


@query("""with q as (select l_partkey as a, l_suppkey as b, avg(l_quantity) as x from lineitem group by 1, 2), e as (select l_partkey as a, l_suppkey as b, l_orderkey * 10 + l_linenumber as edge, l_quantity as x from lineitem)
 select q.a, q.b, count(*) as edges, arg_min(e.edge, abs(e.x - q.x) * 1e6 + e.edge * 1e-6) as towards from q join e using (a, b) group by 1, 2 having count(*) > 1""")
def edge_towards(spark, sf_dir):
    """Of several edges between two nodes, the one towards a point (C20)."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), F.col("l_quantity").alias("x"))
    q = e.groupBy("a", "b").agg(F.avg("x").alias("to"))
    off = F.abs(F.col("x") - F.col("to")) * 1e6 + F.col("edge") * 1e-6
    return e.join(q, ["a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"), F.min_by("edge", off).alias("towards")).filter("edges > 1")


@query(f"""with {_NEAR}, n as (select a, la, lb, b, d, row_number() over (partition by a order by d, b) as rn from r where la <> lb)
 select p.label, count(*) as points, count(n.a) as reached, round(avg(case when n.d <= 0.01 + 0.7 * 0.02 * (n.lb % 3) then 1.0 else 0.0 end), 6) as inside, avg(case when n.d <= 0.01 + 0.7 * 0.02 * (n.lb % 3) then 1.0 else 0.0 end) >= 0.4 as within
 from p left join n on n.a = p.vec_id and n.rn = 1 group by 1""")
def footprint_share(spark, sf_dir):
    """Share of a curve's points inside the nearest other curve's footprint."""
    near = F.col("near")[0]
    n = _nearest(spark, sf_dir, 1, other="label").select(F.col("a").alias("vec_id"), F.struct(near["dist"].alias("d"), near["other"].alias("lb")).alias("x"))
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(n, "vec_id", "left")
    inside = F.when(F.col("x.d") <= 0.7 * 0.02 * (F.col("x.lb") % 3) + 0.01, 1.0).otherwise(0.0)
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.count("x").alias("reached"), F.round(F.avg(inside), 6).alias("inside"), (F.avg(inside) >= 0.4).alias("within"))


_ENDS = f"""{_POS}, t as (select user_id, 0 as tip, arg_min(value, pos) as x, arg_min(y, pos) as y, arg_min(value, pos) - arg_max(value, pos) as dx, arg_min(y, pos) - arg_max(y, pos) as dy, median(value) as w, avg(y) as a from c where pos <= 6 and len >= 12 group by 1
 union all select user_id, 1, arg_max(value, pos), arg_max(y, pos), arg_max(value, pos) - arg_min(value, pos), arg_max(y, pos) - arg_min(y, pos), median(value), avg(y) from c where pos > len - 6 and len >= 12 group by 1)"""


def _ends(spark, sf_dir):
    """user_id, tip, x, y, dx, dy (outward), w, a of the two ends of each curve: medians and means of its last six points."""
    c = _curves(spark, sf_dir).filter("len >= 12")
    out = None
    for tip, part, first, last in ((0, "pos <= 6", F.min_by, F.max_by), (1, "pos > len - 6", F.max_by, F.min_by)):
        by = c.filter(part).groupBy("user_id")
        x, y = first("value", "pos"), first("y", "pos")
        one = by.agg(x.alias("x"), y.alias("y"), (x - last("value", "pos")).alias("dx"), (y - last("y", "pos")).alias("dy"), F.median("value").alias("w"), F.avg("y").alias("a")).select("user_id", F.lit(tip).alias("tip"), "x", "y", "dx", "dy", "w", "a")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_ENDS} select user_id, tip, round(x, 6) as x, round(y, 6) as y, round(dx / nullif(sqrt(dx * dx + dy * dy), 0), 6) + 0.0 as tx, round(dy / nullif(sqrt(dx * dx + dy * dy), 0), 6) + 0.0 as ty, round(w, 6) as width, round(a, 6) as amplitude from t")
def curve_ends(spark, sf_dir):
    """Place, outward direction, width and strength of both ends of each curve."""
    size = F.nullif(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), F.lit(0.0))
    return _ends(spark, sf_dir).select("user_id", "tip", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), r6(F.col("dx") / size).alias("tx"), r6(F.col("dy") / size).alias("ty"), F.round("w", 6).alias("width"), F.round("a", 6).alias("amplitude"))


@query(f"""with {_ENDS}, u as (select user_id, tip, x, y, dx / sqrt(dx * dx + dy * dy) as tx, dy / sqrt(dx * dx + dy * dy) as ty, greatest(w, 0.1) as w from t where dx <> 0 or dy <> 0),
 j as (select a.user_id as ua, a.tip as ta, b.user_id as ub, b.tip as tb, degrees(acos(greatest(least(-(a.tx * b.tx + a.ty * b.ty), 1), -1))) as turn, greatest(a.w, b.w) / least(a.w, b.w) as wide, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as gap,
       (b.x - a.x) * a.tx + (b.y - a.y) * a.ty as along, abs((b.x - a.x) * a.ty - (b.y - a.y) * a.tx) as aside from u a join u b on a.user_id < b.user_id where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 144)
 select ua, ta, ub, tb, round(pow(turn / 60, 2) + pow(ln(wide) / ln(2.5), 2) + pow(gap / 12, 2), 6) as cost from j where turn <= 60 and wide <= 2.5 and (along > 0 or aside <= 4)""")
def end_links(spark, sf_dir):
    """Ends that may continue into each other: within reach, turn, width ratio and sideways step small enough; and what it costs."""
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    u = _ends(spark, sf_dir).filter("dx <> 0 or dy <> 0").select((F.col("user_id") * 2 + F.col("tip")).alias("id"), "x", "y", (F.col("dx") / size).alias("tx"), (F.col("dy") / size).alias("ty"), F.greatest("w", F.lit(0.1)).alias("w"))
    j = spatial.radius_pairs(u, "id", "x", "y", 12.0, ("x", "y", "tx", "ty", "w")).withColumnRenamed("dist", "gap").filter(F.floor(F.col("a") / 2) != F.floor(F.col("b") / 2))
    dot = F.col("txa") * F.col("txb") + F.col("tya") * F.col("tyb")
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    j = j.withColumn("turn", F.degrees(F.acos(F.greatest(F.least(-dot, F.lit(1.0)), F.lit(-1.0))))).withColumn("wide", F.greatest("wa", "wb") / F.least("wa", "wb"))
    j = j.withColumn("along", dx * F.col("txa") + dy * F.col("tya")).withColumn("lateral", F.abs(dx * F.col("tya") - dy * F.col("txa"))).filter("turn <= 60 and wide <= 2.5 and (along > 0 or lateral <= 4)")
    cost = F.pow(F.col("turn") / 60, F.lit(2)) + F.pow(F.log("wide") / math.log(2.5), F.lit(2)) + F.pow(F.col("gap") / 12, F.lit(2))
    return j.select(F.floor(F.col("a") / 2).alias("ua"), (F.col("a") % 2).cast("int").alias("ta"), F.floor(F.col("b") / 2).alias("ub"), (F.col("b") % 2).cast("int").alias("tb"), F.round(cost, 6).alias("cost"))


@query(f"with {PX}, m as (select label, i, avg(v) filter (abs(v) < 1.5) as m, count(*) filter (abs(v) < 1.5) as n from px group by 1, 2) select label, count(m) as pixels, cast(sum(n) as bigint) as samples, round(sum(m), 6) + 0.0 as total, round(sum(i * m), 6) + 0.0 as placed from m group by 1")
def fixation_mean(spark, sf_dir):
    """Mean picture of each fixation over valid pixels only."""
    each = pictures(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).filter("abs(x) < 1.5")
    m = each.groupBy("label", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("pixels"), F.sum("n").alias("samples"), r6(F.sum("m")).alias("total"), r6(F.sum(F.col("i") * F.col("m"))).alias("placed"))


def _irls_sql(rounds: int) -> str:
    """Weighted least squares var = a + c m of background pixels, again and again with weights by the residuals."""
    solve = "(sum(w * w * v) * sum(w * w * m * m) - sum(w * w * m) * sum(w * w * m * v)) / (sum(w * w) * sum(w * w * m * m) - pow(sum(w * w * m), 2)) as a, (sum(w * w) * sum(w * w * m * v) - sum(w * w * m) * sum(w * w * v)) / (sum(w * w) * sum(w * w * m * m) - pow(sum(w * w * m), 2)) as c"
    out = f"w0 as (select *, 1.0::double as w from b), s0 as (select label, {solve} from w0 group by 1)"
    for k in range(1, rounds + 1):
        out += f", r{k} as (select b.*, abs(v - a - c * m) as r from b join s{k - 1} using (label)), q{k} as (select label, 1.4826 * median(r) + 1e-12 as s from r{k} group by 1), w{k} as (select r{k}.*, 1 / greatest(1, r / (2 * s)) as w from r{k} join q{k} using (label)), s{k} as (select label, {solve} from w{k} group by 1)"
    return out


@query(f"""with {PX}, p as (select label, i, avg(v) + 2 as m, var_samp(v) as v, sqrt(var_samp(v)) / (avg(v) + 2) as raw from px group by 1, 2), t as (select label, quantile_cont(raw, 0.6) as t from p group by 1), b as (select p.* from p join t using (label) where raw < t), {_irls_sql(3)}
 select label, i as pix, round(sqrt(greatest(v - (a + c * m), 0)) / m, 6) as flicker from p join s3 using (label)""")
def flicker_map(spark, sf_dir):
    """Spread over time beyond a noise model that is fitted robustly to background pixels."""
    each = pictures(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    p = each.groupBy("label", "i").agg((F.avg("x") + 2).alias("m"), F.var_samp("x").alias("v")).withColumn("raw", F.sqrt("v") / F.col("m"))
    b = p.join(p.groupBy("label").agg(F.percentile("raw", F.lit(0.6)).alias("t")), "label").filter("raw < t").withColumn("w", F.lit(1.0))

    def solved(rows):
        w, m, v = F.col("w") ** 2, F.col("m"), F.col("v")
        s = rows.groupBy("label").agg(F.sum(w).alias("s"), F.sum(w * m).alias("sm"), F.sum(w * m * m).alias("smm"), F.sum(w * v).alias("sv"), F.sum(w * m * v).alias("smv"))
        det = F.col("s") * F.col("smm") - F.col("sm") ** 2
        return s.select("label", ((F.col("sv") * F.col("smm") - F.col("sm") * F.col("smv")) / det).alias("a"), ((F.col("s") * F.col("smv") - F.col("sm") * F.col("sv")) / det).alias("c"))

    fit = solved(b)
    for _ in range(3):
        r = b.drop("w").join(fit, "label").withColumn("r", F.abs(F.col("v") - F.col("a") - F.col("c") * F.col("m"))).drop("a", "c")
        spread = r.groupBy("label").agg((1.4826 * F.median("r") + 1e-12).alias("s"))
        fit = solved(r.join(spread, "label").withColumn("w", 1 / F.greatest(F.lit(1.0), F.col("r") / (2 * F.col("s")))))
    out = p.join(fit, "label")
    return out.select("label", F.col("i").cast("long").alias("pix"), F.round(F.sqrt(F.greatest(F.col("v") - (F.col("a") + F.col("c") * F.col("m")), F.lit(0.0))) / F.col("m"), 6).alias("flicker"))


@query("""select l_partkey as edge, count(*) as pixels, round(sum(l_extendedprice * (l_discount - 0.05)), 4) + 0.0 as gain, round(max(l_extendedprice * (l_discount - 0.05)), 4) + 0.0 as best,
 round(sum(l_extendedprice * (l_discount - 0.05)), 4) > 3 * ln(count(*) + 1) as kept from lineitem group by 1""")
def edge_gains(spark, sf_dir):
    """Gains of pixels summed by edge, against a price by size."""
    g = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("edge")).agg(F.count(F.lit(1)).alias("pixels"), F.sum(g).alias("g"), F.max(g).alias("b"))
    four = lambda c: F.round(c, 4) + F.lit(0.0)
    return by.select("edge", "pixels", four("g").alias("gain"), four("b").alias("best"), (F.round("g", 4) > 3 * F.log(F.col("pixels") + 1)).alias("kept"))


@query("""select coalesce(l_returnflag, 'total') as burst, count(*) as frames, round(sum(l_extendedprice), 2) as raw, round(sum(l_extendedprice * (1 - l_discount)), 2) as packed, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) as ratio from lineitem group by rollup (l_returnflag)""")
def release_totals(spark, sf_dir):
    """Sizes, ratio of packed to raw, and a row for all."""
    p = F.col("l_extendedprice")
    g = table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("frames"), F.sum(p).alias("a"), F.sum(p * (1 - F.col("l_discount"))).alias("b"))
    return g.select(F.coalesce("l_returnflag", F.lit("total")).alias("burst"), "frames", F.round("a", 2).alias("raw"), F.round("b", 2).alias("packed"), F.round(F.col("b") / F.col("a"), 6).alias("ratio"))


@query("""select l_suppkey as pix, round(sum(exp(-pow(l_linenumber - 2, 2) / 4.0)), 6) as cover, round(sum(exp(-pow(l_linenumber - 2, 2) / 4.0) * l_quantity) / sum(exp(-pow(l_linenumber - 2, 2) / 2.0)), 6) as amplitude from lineitem group by 1""")
def vessel_cover(spark, sf_dir):
    """Profiles summed by pixel, and the strength that fits them best."""
    far = F.pow(F.col("l_linenumber") - 2, F.lit(2))
    p = F.exp(-far / 4.0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pix")).agg(F.round(F.sum(p), 6).alias("cover"), F.round(F.sum(p * F.col("l_quantity")) / F.sum(F.exp(-far / 2.0)), 6).alias("amplitude"))


@query(f"""with {_POS}, d as (select user_id, pos, value, value - 2 * lag(value) over (partition by user_id order by pos) + lag(value, 2) over (partition by user_id order by pos) as bend from c)
 select user_id, round(regr_slope(value, pos), 6) + 0.0 as drift, round(sqrt(avg(bend * bend)), 6) as roughness from d group by 1""")
def width_drift(spark, sf_dir):
    """Slope of the width along each vessel, and how rough it is."""
    w = Window.partitionBy("user_id").orderBy("pos")
    d = _curves(spark, sf_dir).withColumn("bend", F.col("value") - 2 * F.lag("value").over(w) + F.lag("value", 2).over(w))
    return d.groupBy("user_id").agg(r6(F.regr_slope("value", F.col("pos").cast("double"))).alias("drift"), F.round(F.sqrt(F.avg(F.col("bend") * F.col("bend"))), 6).alias("roughness"))


@query(f"with {PX}, h as (select label, i, y, x, (avg(v) filter (vec_id % 2 = 0) - avg(v) filter (vec_id % 2 = 1)) / 2 as z from px group by all) select p.label, round(avg(q), 6) as noise from (select p.label, p.i, avg(n.z * n.z) as q from h p join h n on n.label = p.label and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1 group by all) p group by 1")
def split_half_noise(spark, sf_dir):
    """Noise from half the difference of even and odd pictures, smoothed over neighbours."""
    import numpy as np

    from ..operators import pictures as P

    each = pictures(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"), (F.col("id") % 2).alias("half"))
    z = each.groupBy("label", "i").agg(((F.avg(F.when(F.col("half") == 0, F.col("x"))) - F.avg(F.when(F.col("half") == 1, F.col("x")))) / 2).alias("z"))
    maps = z.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("a"))  # a picture a recording
    side = F.sqrt(F.size("a")).cast("int")
    got = P.run(maps.select(F.col("label").alias("id"), side.alias("height"), side.alias("width"), F.col("a.z").alias("v")), lambda a: {"noise": np.nanmean(P.window_inside(a * a), axis=-1).mean(axis=(1, 2))}, "noise double")
    return got.select(F.col("id").alias("label"), F.round("noise", 6).alias("noise"))


@query(f"""with {_POS}, d as (select user_id, value - lag(value) over (partition by user_id order by pos) as fx, y - lag(y) over (partition by user_id order by pos) as fy from c) select user_id, round(sqrt(avg(fx * fx + fy * fy)), 6) as update_rms from d group by 1""")
def update_rms(spark, sf_dir):
    """Size of the last update of each recording's field."""
    w = Window.partitionBy("user_id").orderBy("pos")
    d = _curves(spark, sf_dir).select("user_id", (F.col("value") - F.lag("value").over(w)).alias("fx"), (F.col("y") - F.lag("y").over(w)).alias("fy"))
    return d.groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("fx") ** 2 + F.col("fy") ** 2)), 6).alias("update_rms"))


@query(f"""with {_POS}, f as (select user_id, sum(pos * value) / sum(pos * pos) as k from c where pos % 2 = 0 group by 1) select c.user_id, count(*) as held_out, round(sum(pow(value - k * pos, 2)) / sum(value * value), 6) as misfit from c join f using (user_id) where pos % 2 = 1 group by 1""")
def held_out_misfit(spark, sf_dir):
    """A strength fitted on even frames, and how badly it fits the odd ones."""
    c, pos = _curves(spark, sf_dir), F.col("pos").cast("double")
    f = c.filter("pos % 2 = 0").groupBy("user_id").agg((F.sum(pos * F.col("value")) / F.sum(pos * pos)).alias("k"))
    odd = c.filter("pos % 2 = 1").join(f, "user_id")
    return odd.groupBy("user_id").agg(F.count(F.lit(1)).alias("held_out"), F.round(F.sum((F.col("value") - F.col("k") * pos) ** 2) / F.sum(F.col("value") ** 2), 6).alias("misfit"))


@query(f"""with {_POS}, s as (select c.*, w.k as win from c, range(0, 100) w(k) where pos > w.k * 8 and pos <= w.k * 8 + 16 and w.k * 8 + 16 <= len),
 l as (select user_id, win, lag, corr(value, later) as r from (select user_id, win, g.n as lag, value, lead(value, cast(g.n as int)) over (partition by user_id, win, g.n order by pos) as later from s, range(1, 5) g(n)) where later is not null group by all),
 b as (select *, row_number() over (partition by user_id, win order by round(r, 9) desc, lag) as rn from l where r is not null) select user_id, win, lag, round(r, 6) + 0.0 as r from b where rn = 1""")
def sliding_windows(spark, sf_dir):
    """The best lag of each sliding window: windows of 16 rows, every 8."""
    # a row is in the windows that begin 8, 16, .. rows before it: two at most
    k = F.floor((F.col("pos") - 1) / 8)
    s = _curves(spark, sf_dir).withColumn("win", F.explode(F.array(k, k - 1))).filter("win >= 0 and win * 8 + 16 <= len")
    w = Window.partitionBy("user_id", "win").orderBy("pos")
    for n in range(1, 5):
        s = s.withColumn(f"x{n}", F.lead("value", n).over(w))
    l = s.groupBy("user_id", "win").agg(*[F.corr("value", f"x{n}").alias(f"r{n}") for n in range(1, 5)])  # noqa: E741
    cand = F.filter(F.array(*[F.struct(F.round(f"r{n}", 9).alias("k"), F.lit(-n).alias("neg"), F.col(f"r{n}").alias("r")) for n in range(1, 5)]), lambda x: x["k"].isNotNull())
    return l.withColumn("b", F.array_max(cand)).filter("b is not null").select("user_id", "win", (-F.col("b.neg")).cast("long").alias("lag"), r6("b.r").alias("r"))


@query(f"""with {_POS}, s as (select user_id, avg(value) filter (pos <= len // 2) as lo, avg(value) filter (pos > len // 2) as hi, median(value) filter (pos <= len // 2 - 1) as ma, median(value) filter (pos > len // 2 + 1) as mb,
  regr_slope(value, pos) as k, regr_intercept(value, pos) as c0 from c where value > 0 group by 1),
 r as (select user_id, sum(pow(value - case when pos <= len // 2 then lo else hi end, 2)) as step, sum(pow(value - c0 - k * pos, 2)) as ramp from c join s using (user_id) where value > 0 group by 1)
 select user_id, round(step, 6) as sse_step, round(ramp, 6) as sse_ramp, greatest(ma, mb) / least(ma, mb) > 1.3 and step < 0.98 * ramp as is_step from r join s using (user_id) where ma > 0 and mb > 0""")
def step_or_ramp(spark, sf_dir):
    """Whether a step in the middle explains a curve better than a straight line does, and is large enough."""
    c = _curves(spark, sf_dir).filter("value > 0").withColumn("half", F.floor(F.col("len") / 2)).withColumn("p", F.col("pos").cast("double"))
    low = F.col("pos") <= F.col("half")
    when = lambda cond: F.when(cond, F.col("value"))
    s = c.groupBy("user_id").agg(F.avg(when(low)).alias("lo"), F.avg(when(~low)).alias("hi"), F.median(when(F.col("pos") <= F.col("half") - 1)).alias("ma"), F.median(when(F.col("pos") > F.col("half") + 1)).alias("mb"), F.regr_slope("value", "p").alias("k"), F.regr_intercept("value", "p").alias("c0"))
    j = c.join(s, "user_id")
    r = j.groupBy("user_id").agg(F.sum((F.col("value") - F.when(low, F.col("lo")).otherwise(F.col("hi"))) ** 2).alias("step"), F.sum((F.col("value") - F.col("c0") - F.col("k") * F.col("p")) ** 2).alias("ramp"))
    out = r.join(s, "user_id").filter("ma > 0 and mb > 0")
    is_step = (F.greatest("ma", "mb") / F.least("ma", "mb") > 1.3) & (F.col("step") < 0.98 * F.col("ramp"))
    return out.select("user_id", F.round("step", 6).alias("sse_step"), F.round("ramp", 6).alias("sse_ramp"), is_step.alias("is_step"))


@query(f"""with {_POS}, a as (select *, sqrt(pow(value - lag(value) over w, 2) + pow(y - lag(y) over w, 2)) as step, lead(value) over w as nx, lead(y) over w as ny from c window w as (partition by user_id order by pos)),
 s as (select *, sum(coalesce(step, 0)) over (partition by user_id order by pos) as arc, sum(coalesce(step, 0)) over (partition by user_id) as total from a), n as (select *, lead(arc) over (partition by user_id order by pos) as arc1 from s)
 select user_id, k.k as place, round(value + (nx - value) * (total * k.k / 8 - arc) / (arc1 - arc), 6) + 0.0 as x, round(y + (ny - y) * (total * k.k / 8 - arc) / (arc1 - arc), 6) + 0.0 as y from n, range(0, 8) k(k) where arc1 > arc and total * k.k / 8 >= arc and total * k.k / 8 < arc1""")
def resampled_curves(spark, sf_dir):
    """Points at equal distances along each curve: every segment makes those that fall on it."""
    from ..operators.curves import steps

    w = Window.partitionBy("user_id").orderBy("pos")
    s = steps(_curves(spark, sf_dir).withColumn("x", F.col("value")), "user_id", "pos", "x", "y")
    s = s.withColumn("total", F.sum("step").over(Window.partitionBy("user_id"))).withColumn("arc1", F.lead("arc").over(w)).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).filter("arc1 > arc")
    k = F.filter(F.sequence(F.greatest(F.ceil(F.col("arc") / F.col("total") * 8) - 1, F.lit(0)), F.least(F.ceil(F.col("arc1") / F.col("total") * 8), F.lit(7))), lambda k: (F.col("total") * k / 8 >= F.col("arc")) & (F.col("total") * k / 8 < F.col("arc1")))
    e = s.withColumn("k", F.explode(k)).withColumn("part", (F.col("total") * F.col("k") / 8 - F.col("arc")) / (F.col("arc1") - F.col("arc")))
    return e.select("user_id", F.col("k").cast("long").alias("place"), r6(F.col("x") + (F.col("nx") - F.col("x")) * F.col("part")).alias("x"), r6(F.col("y") + (F.col("ny") - F.col("y")) * F.col("part")).alias("y"))


@query("select p_partkey, row_number() over (order by p_name, p_partkey) as place from part")
def sorted_names(spark, sf_dir):
    """All names in order, with their places."""
    return ranks.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], "place").select("p_partkey", "place")


@query("select event_id, row_number() over (order by ts desc, event_id desc) as place from events")
def newest_first(spark, sf_dir):
    """A listing, newest first."""
    return ranks.ranked(events(spark, sf_dir).select("event_id", "us"), [F.desc("us"), F.desc("event_id")], "place").select("event_id", "place")


@query(f"""with {_POS}, k as (select user_id, pos, value, lag(value) over w as b, lead(value) over w as a from c window w as (partition by user_id order by pos)), p as (select user_id, pos, value from k where value >= b and value > a),
 p1 as (select user_id, arg_max(pos, value * 1e6 - pos) as q from p group by 1), r1 as (select p.* from p join p1 using (user_id) where abs(pos - q) >= 6), p2 as (select user_id, arg_max(pos, value * 1e6 - pos) as q from r1 group by 1),
 r2 as (select r1.* from r1 join p2 using (user_id) where abs(pos - q) >= 6), p3 as (select user_id, arg_max(pos, value * 1e6 - pos) as q from r2 group by 1)
 select user_id, 1 as rank, q as pos from p1 union all select user_id, 2, q from p2 union all select user_id, 3, q from p3""")
def spaced_peaks(spark, sf_dir):
    """The three strongest peaks of each recording that stand apart; a pass a peak, no sequence to walk."""
    w = Window.partitionBy("user_id").orderBy("pos")
    k = _curves(spark, sf_dir).withColumn("b", F.lag("value").over(w)).withColumn("a", F.lead("value").over(w)).filter("value >= b and value > a").select("user_id", "pos", "value")
    out, left = None, k
    for n in (1, 2, 3):
        best = left.groupBy("user_id").agg(F.max_by("pos", F.col("value") * 1e6 - F.col("pos")).alias("q"))
        one = best.select("user_id", F.lit(n).alias("rank"), F.col("q").alias("pos"))
        out = one if out is None else out.union(one)
        left = left.join(best, "user_id").filter(F.abs(F.col("pos") - F.col("q")) >= 6).drop("q")
    return out


@query(f"""with {_POS}, k as (select user_id, event_id, value, lag(value) over w as b, lead(value) over w as a from c window w as (partition by user_id order by pos))
 select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank from k where value > 8 and value > coalesce(b, -1) and value > coalesce(a, -1)""")
def crest_seeds(spark, sf_dir):
    """Crests over a level and over both neighbours, strongest first."""
    w = Window.partitionBy("user_id").orderBy("pos")
    k = _curves(spark, sf_dir).withColumn("b", F.coalesce(F.lag("value").over(w), F.lit(-1.0))).withColumn("a", F.coalesce(F.lead("value").over(w), F.lit(-1.0))).filter("value > 8 and value > a and value > b")
    return k.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long").alias("rank"))


@query(f"""with {_POS}, s as (select user_id, var_pop(value) * count(*) as flat, var_pop(value) * count(*) * (1 - coalesce(regr_r2(value, pos), 0)) as line, count(*) as n from c group by 1 having count(*) >= 5),
 b as (select user_id, n * ln(greatest(flat, 1e-9) / n) + 1 * ln(n) as flat, n * ln(greatest(line, 1e-9) / n) + 2 * ln(n) as line from s) select user_id, case when line < flat then 'line' else 'flat' end as shape, round(least(line, flat), 5) + 0.0 as score from b""")
def best_shape(spark, sf_dir):
    """The shape that fits each profile best for its number of parameters."""
    p = F.col("pos").cast("double")
    s = _curves(spark, sf_dir).groupBy("user_id").agg((F.var_pop("value") * F.count(F.lit(1))).alias("f"), F.coalesce(F.regr_r2("value", p), F.lit(0.0)).alias("r2"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    score = lambda sse, k: F.col("n") * F.log(F.greatest(sse, F.lit(1e-9)) / F.col("n")) + k * F.log("n")
    s = s.withColumn("flat", score(F.col("f"), 1)).withColumn("line", score(F.col("f") * (1 - F.col("r2")), 2))
    return s.select("user_id", F.when(F.col("line") < F.col("flat"), "line").otherwise("flat").alias("shape"), (F.round(F.least("line", "flat"), 5) + F.lit(0.0)).alias("score"))


@query(f"""with {_NEAR}, g as (select label, cast(count(*) as bigint) * 100 + label as gain, count(*) as n from p group by 1), s as (select r.la, r.lb, count(distinct r.a) as inside from r where la <> lb and d <= 0.03 group by 1, 2)
 select s.la as edge, min(s.lb) as inside_of, max(round(inside / x.n, 6)) as share from s join g x on x.label = s.la join g z on z.label = s.lb where z.gain >= x.gain and inside > 0.15 * x.n group by 1""")
def duplicate_edges(spark, sf_dir):
    """Edges that mostly run inside a stronger one; the stronger one is still there when a weaker one is tried, so one pass decides."""
    g = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("gain", F.col("n") * 100 + F.col("label"))
    s = _near(spark, sf_dir).filter("la <> lb and d <= 0.03").select("la", "lb", "a").distinct().groupBy("la", "lb").agg(F.count(F.lit(1)).alias("inside"))
    j = s.join(g.select(F.col("label").alias("la"), F.col("n").alias("nx"), F.col("gain").alias("gx")), "la").join(g.select(F.col("label").alias("lb"), F.col("gain").alias("gz")), "lb")
    return j.filter("gz >= gx and inside > 0.15 * nx").groupBy(F.col("la").alias("edge")).agg(F.min("lb").alias("inside_of"), F.max(F.round(F.col("inside") / F.col("nx"), 6)).alias("share"))


def erf(x):
    """The error function as a sum of positive terms, within 1e-9 up to 4; beyond that it is 1."""
    terms = F.sequence(F.lit(1), F.lit(60))
    z = F.abs(x)
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s")), lambda a: a["s"])
    return F.signum(x) * F.when(z > 4, 1.0).otherwise(2 / math.sqrt(math.pi) * z * F.exp(-z * z) * total)


def erf_sql(x: str) -> str:
    """The same sum; the terms' products are exponentials of sums of logs."""
    term = f"exp(k * ln(2 * ({x}) * ({x})) - list_sum(list_transform(range(1, k + 1), lambda j: ln(2 * j + 1))))"
    return f"(sign({x}) * case when abs({x}) > 4 then 1 when {x} = 0 then 0 else 2 / sqrt(pi()) * abs({x}) * exp(-({x}) * ({x})) * (1 + list_sum(list_transform(range(1, 61), lambda k: {term}))) end)"


@query(f"""with z as (select event_id, value, (event_id % 9 - 4) / 2.0::double as d, 1.5::double as r, 0.8 + (event_id % 3) * 0.4::double as s from events), q as (select *, (r - d) / (sqrt(2) * s) as p, (r + d) / (sqrt(2) * s) as m from z)
 select event_id, round(0.5 * ({erf_sql('p')} + {erf_sql('m')}), 6) + 0.0 as profile, round(ln(1 + exp(value / 10)), 6) as softplus, round(10 * ln(exp(ln(1 + exp(value / 10))) - 1), 6) + 0.0 as back from q""")
def blurred_profiles(spark, sf_dir):
    """A blurred box by the error function, softplus and its inverse."""
    n = F.col("event_id")
    d, s = (n % 9 - 4) / 2.0, 0.8 + (n % 3) * 0.4
    soft = F.log(1 + F.exp(F.col("value") / 10))
    profile = 0.5 * (erf((1.5 - d) / (math.sqrt(2) * s)) + erf((1.5 + d) / (math.sqrt(2) * s)))
    return table(spark, sf_dir, "events").select("event_id", r6(profile).alias("profile"), F.round(soft, 6).alias("softplus"), r6(10 * F.log(F.exp(soft) - 1)).alias("back"))


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents), m as (select doc_id, regexp_extract(line, '([A-Za-z_]+) ?[:=] ?["'']?[A-Za-z0-9]+', 1) as name from l)
 select doc_id, count(*) as constants, min(name) as first from m where name <> '' group by 1""")
def text_constants(spark, sf_dir):
    """Names that lines of a source give a literal to, without running it."""
    pattern = r'''([A-Za-z_]+) ?[:=] ?["']?[A-Za-z0-9]+'''
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_extract(x, pattern, 1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(lines, lambda x: x != "").alias("m")).filter("size(m) > 0")
    return d.select("doc_id", F.size("m").cast("long").alias("constants"), F.array_min("m").alias("first"))


@query("""with l as (select vec_id, label, len(embedding) as n, sum(len(embedding)) over (partition by label order by vec_id) - len(embedding) as offset_, list_sum(list_transform(embedding, lambda x: x::double)) as s from embeddings)
 select vec_id, label, cast(offset_ as bigint) as first, cast(offset_ + n as bigint) as after, round(s, 5) + 0.0 as total from l""")
def ragged_offsets(spark, sf_dir):
    """Arrays of several lengths laid end to end: where each begins and ends, and its sum."""
    n = F.size("embedding")
    upto = F.sum(n).over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (upto - n).cast("long").alias("first"), upto.cast("long").alias("after"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query("""select event_id, cast(json_object('id', event_id, 'kind', event_type, 'ok', value > 5, 'level', cast(floor(value) as bigint)) as varchar) as props_json from events""")
def jsonable_props(spark, sf_dir):
    """Properties of several types as one JSON object."""
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("value") > 5).alias("ok"), F.floor("value").alias("level"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(record).alias("props_json"))


_SETTINGS = ("width=12", "scale=2.5", "fast=true", "name=abc", "note=null")


@query("""with s as (select event_id, (['width=12', 'scale=2.5', 'fast=true', 'name=abc', 'note=null'])[event_id % 5 + 1] as setting from events), p as (select event_id, string_split(setting, '=')[1] as name, string_split(setting, '=')[2] as raw from s)
 select event_id, name, case when raw in ('true', 'false') then 'bool' when raw = 'null' then 'none' when regexp_full_match(raw, '-?[0-9]+') then 'int' when try_cast(raw as double) is not null then 'float' else 'str' end as kind, try_cast(raw as double) as number from p""")
def typed_settings(spark, sf_dir):
    """name=value settings with the type that their value reads as."""
    s = F.element_at(F.array(*[F.lit(x) for x in _SETTINGS]), (F.col("event_id") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "events").select("event_id", F.split(s, "=").alias("p")).select("event_id", F.col("p")[0].alias("name"), F.col("p")[1].alias("raw"))
    number = F.col("raw").try_cast("double")
    kind = F.when(F.col("raw").isin("true", "false"), "bool").when(F.col("raw") == "null", "none").when(F.col("raw").rlike("^-?[0-9]+$"), "int").when(number.isNotNull(), "float").otherwise("str")
    return p.select("event_id", "name", kind.alias("kind"), number.alias("number"))


@query("""with m as (select event_id, 1 + value / 100 as a, (event_id % 7) / 50.0::double as b, (event_id % 5) / 10.0::double as tx, value / 10 as ty from events),
 h as (select event_id, a * a - b * b as m00, -a * b - b * a as m01, a * tx - b * ty + tx as m02, b * a + a * b as m10, -b * b + a * a as m11, b * tx + a * ty + ty as m12 from m)
 select event_id, round(m00, 6) + 0.0 as m00, round(m01, 6) + 0.0 as m01, round(m02, 6) + 0.0 as m02, round(m00 * 3 + m01 * 2 + m02, 6) + 0.0 as x, round(m10 * 3 + m11 * 2 + m12, 6) + 0.0 as y from h""")
def composed_maps(spark, sf_dir):
    """Two plane maps as one 3 x 3 matrix, applied to a point."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", (1 + F.col("value") / 100).alias("a"), ((n % 7) / 50.0).alias("b"), ((n % 5) / 10.0).alias("tx"), (F.col("value") / 10).alias("ty"))
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = F.array(F.array("a", -F.col("b"), "tx"), F.array("b", "a", "ty"), F.array(zero, zero, one))
    times = lambda p, q: F.transform(p, lambda r: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.aggregate(F.zip_with(r, q, lambda x, row: x * row[j]), zero, lambda s, v: s + v)))
    m = e.withColumn("m", rows).withColumn("p", times(F.col("m"), F.col("m")))
    at = lambda i: F.col("p")[i][0] * 3 + F.col("p")[i][1] * 2 + F.col("p")[i][2]
    return m.select("event_id", *[r6(F.col("p")[0][j]).alias(f"m0{j}") for j in range(3)], r6(at(0)).alias("x"), r6(at(1)).alias("y"))


@query("""select event_id, round(case when event_id % 4 = 0 then 20.0 else least(20.0, sqrt(2) * value) end, 6) as widest, round(pow((event_id % 7) / 3.0, 2) + pow(ln(1 + value) / 0.35, 2) + pow(0.1 / 0.6, 2), 5) as penalty from events""")
def fit_penalties(spark, sf_dir):
    """The widest that an edge may get, and the price of leaving a reference."""
    v, n = F.col("value"), F.col("event_id")
    widest = F.when(n % 4 == 0, 20.0).otherwise(F.least(F.lit(20.0), math.sqrt(2) * v))
    penalty = F.pow((n % 7) / 3.0, F.lit(2)) + F.pow(F.log1p(v) / 0.35, F.lit(2)) + (0.1 / 0.6) ** 2
    return table(spark, sf_dir, "events").select("event_id", F.round(widest, 6).alias("widest"), F.round(penalty, 5).alias("penalty"))


@query("""with c as (select event_id, (event_id * 7) % 31 - 15 as dy, (event_id * 11) % 41 - 20 as dx from events) select event_id, greatest(0, dy) + 2 as y0, 100 + least(0, dy) - 2 as y1, greatest(0, dx) + 2 as x0, 160 + least(0, dx) - 2 as x1,
 round((100 + least(0, dy) - greatest(0, dy) - 4) * (160 + least(0, dx) - greatest(0, dx) - 4) / 16000.0::double, 6) as share from c""")
def covered_area(spark, sf_dir):
    """What a moved frame still covers, less a margin."""
    n, zero = F.col("event_id"), F.lit(0)
    c = table(spark, sf_dir, "events").select("event_id", ((n * 7) % 31 - 15).alias("dy"), ((n * 11) % 41 - 20).alias("dx"))
    c = c.select("event_id", (F.greatest(zero, "dy") + 2).alias("y0"), (100 + F.least(zero, F.col("dy")) - 2).alias("y1"), (F.greatest(zero, "dx") + 2).alias("x0"), (160 + F.least(zero, F.col("dx")) - 2).alias("x1"))
    return c.withColumn("share", F.round((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) / 16000.0, 6))
