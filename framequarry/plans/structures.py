"""Queries on points, curves and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, curves, graph, neighbours, spatial
from .registry import EVENTS, events, query, r6, table

_POINTS = "p as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, label from embeddings)"
_PAIRS = f"{_POINTS}, r as (select a.vec_id as a, b.vec_id as b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as dist from p a join p b on a.vec_id < b.vec_id where sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.03)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


@query(f"with {_PAIRS} select a, b, round(dist, 6) as dist from r")
def radius_join_grid(spark, sf_dir):
    """Pairs within a radius, by grid cells."""
    return spatial.radius_pairs(_points(spark, sf_dir), "vec_id", "x", "y", 0.03).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"""with {_POINTS} select a, b, round(dist, 6) as dist, rank from (select a.vec_id as a, b.vec_id as b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as dist,
 row_number() over (partition by a.vec_id order by sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.vec_id) as rank from p a join p b on a.vec_id <> b.vec_id) where rank <= 4""")
def knn_join(spark, sf_dir):
    """The four nearest of every point, however far (C11)."""
    n = neighbours.k_nearest(_points(spark, sf_dir), "vec_id", "x", "y", 4)
    return n.select("a", "b", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query("""with t as (select l_suppkey as node, 1 as i, 0 as o, cast(l_quantity as bigint) as q from lineitem union all select l_partkey, 0, 1, cast(l_quantity as bigint) from lineitem),
 b as (select node, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out, cast(sum(q * i) as bigint) as q_in, cast(sum(q * o) as bigint) as q_out from t group by 1)
 select *, case when n_in > 0 and n_out > 0 and greatest(q_in, q_out) > 0 then round((q_in - q_out) / greatest(q_in, q_out), 6) end as residual,
 case when n_in = 0 and n_out = 1 then 'inlet' when n_in = 1 and n_out = 0 then 'outlet' when n_in = 0 then 'source' when n_out = 0 then 'sink' when n_out > n_in then 'divergent' else 'convergent' end as kind from b""")
def flow_balance_nodes(spark, sf_dir):
    """Flow in and out of each node, its residual and kind."""
    e = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return graph.node_balance(e, "l_partkey", "l_suppkey", "q").withColumn("residual", r6("residual"))


_CURVE = f"{EVENTS}, c as (select user_id, event_id, value as x, cast((event_id * 37) % 101 as double) as y from e)"


@query(f"""with {_CURVE}, d as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from c window w as (partition by user_id order by event_id)),
 t as (select *, round(lag(dx) over w * dy - lag(dy) over w * dx, 6) as side, lag(dx) over w * dx + lag(dy) over w * dy as along from d window w as (partition by user_id order by event_id)),
 f as (select *, atan2(side, along) as turn, side * lag(side) over (partition by user_id order by event_id) < 0 as flip from t),
 g as (select user_id, count(*) as points, sum(coalesce(sqrt(pow(dx, 2) + pow(dy, 2)), 0)) as length, sum(abs(turn)) as turning, count(*) filter (flip) as inflections,
       sqrt(pow(arg_max(x, event_id) - arg_min(x, event_id), 2) + pow(arg_max(y, event_id) - arg_min(y, event_id), 2)) as chord from f group by 1)
 select user_id, points, round(length, 6) as length, round(chord, 6) as chord, round(turning, 6) as turning, inflections, round(case when chord > 0 then length / chord end, 6) as distance_metric from g""")
def tortuosity_metrics(spark, sf_dir):
    """Length, chord, turning and inflections of curves."""
    c = events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("x"), ((F.col("event_id") * 37) % 101).cast("double").alias("y"))
    t = curves.tortuosity(c, "user_id", "event_id", "x", "y")
    return t.select("user_id", "points", *[F.round(k, 6).alias(k) for k in ("length", "chord", "turning")], "inflections", F.round("distance_metric", 6).alias("distance_metric"))


@query(f"""with {EVENTS}, p as (select *, round(value / 10) as x from e), l as (select *, lag(x) over (partition by user_id order by event_id) as px from p)
 select user_id, event_id, cast(x as bigint) as x from l where px is null or px <> x""")
def dedupe_consecutive(spark, sf_dir):
    """Points that differ from the one before."""
    p = events(spark, sf_dir).withColumn("x", F.round(F.col("value") / 10)).withColumn("y", F.lit(0.0))
    return curves.without_repeats(p, "user_id", "event_id", "x", "y").select("user_id", "event_id", F.col("x").cast("long").alias("x"))


@query(f"""with {EVENTS}, s as (select user_id, event_id, cast(round(value) as bigint) as v from e)
 select event_id, cast((user_id + sum(v) over (partition by user_id order by event_id rows unbounded preceding)) % 45 as bigint) as position from s""")
def tracer_positions(spark, sf_dir):
    """Tracers that move by summed speed along a closed length."""
    from pyspark.sql import Window

    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events(spark, sf_dir).select("event_id", F.pmod(F.col("user_id") + F.sum(F.round("value").cast("long")).over(upto), F.lit(45)).alias("position"))


@query("""with s as (select l_partkey as edge, cast(sum(cast(l_quantity as bigint) * case when l_returnflag = 'A' then -1 else 1 end) as bigint) as net, count(*) as n from lineitem group by 1),
 k as (select l_partkey as edge, cast(sum(cast(l_quantity as bigint)) as bigint) as w, cast(sum(cast(l_quantity as bigint) * l_linenumber) as bigint) as vw
       from lineitem join s on s.edge = l_partkey where (case when l_returnflag = 'A' then -1 else 1 end) = sign(net) group by 1)
 select s.edge, net, n, round(vw / w * sign(net), 6) as flow, net * net > 40 * n as kept from s join k using (edge)""")
def dominant_flow(spark, sf_dir):
    """Weighted mean of the dominant sign, and the gain test that keeps an edge."""
    q = F.col("l_quantity").cast("long")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("edge"), q.alias("q"), F.when(F.col("l_returnflag") == "A", -1).otherwise(1).alias("sign"), "l_linenumber")
    s = li.groupBy("edge").agg(F.sum(F.col("q") * F.col("sign")).alias("net"), F.count(F.lit(1)).alias("n"))
    k = li.join(s, "edge").filter(F.col("sign") == F.signum("net")).groupBy("edge").agg(F.sum("q").alias("w"), F.sum(F.col("q") * F.col("l_linenumber")).alias("vw"))
    return s.join(k, "edge").select("edge", "net", "n", F.round(F.col("vw") / F.col("w") * F.signum("net"), 6).alias("flow"), (F.col("net") * F.col("net") > 40 * F.col("n")).alias("kept"))


_ORDERS = "g as (select distinct o_custkey as u, o_orderkey as v from orders)"


def _orders(spark, sf_dir):
    """The edges of all orders, from customer to order, with their own identifiers as nodes."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderkey").alias("v")).distinct()


def _measured(spark, sf_dir):
    """The same with a name u:v and a length."""
    return _orders(spark, sf_dir).withColumn("e", F.concat_ws(":", "u", "v")).withColumn("len", F.col("u") % 13 + F.col("v") % 7 + 1)


_MEASURED = f"{_ORDERS}, i as (select u || ':' || v as e, u, v, cast(u % 13 + v % 7 + 1 as bigint) as len from g)"


@query(f"""with {_ORDERS}, n as (select u as node from g union all select v from g), d as (select node, count(*) as degree from n group by 1)
 select node, degree, case degree when 1 then 'end' when 2 then 'link' when 3 then 'branch' else 'crossing' end as kind from d""")
def degree_node_kind(spark, sf_dir):
    """Kind of a node by its degree."""
    return graph.degree_kinds(_orders(spark, sf_dir), "u", "v")


_LINES = "g as (select distinct l_partkey as u, l_suppkey as v from lineitem), b as (select u as a, v as b from g union select v, u from g)"


@query(f"""with recursive {_LINES}, t(node, depth) using key (node) as (select min(a), 0 from b union select b.b, min(t.depth) + 1 from t join b on t.node = b.a left join recurring.t r on r.node = b.b where r.node is null group by b.b)
 select node, depth from t""")
def bfs_depth_orientation(spark, sf_dir):
    """Depth of all nodes that can be reached from the smallest one (M8)."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return graph.depths(e, "u", "v", e.agg(F.min(F.least("u", "v")).alias("node")))


@query(f"""with recursive {_LINES}, t(node, depth) using key (node) as (select min(a), 0 from b union select b.b, min(t.depth) + 1 from t join b on t.node = b.a left join recurring.t r on r.node = b.b where r.node is null group by b.b)
 select u, v, case when x.depth < y.depth then 1 when x.depth > y.depth then -1 when u < v then 1 else -1 end as direction, least(x.depth, y.depth) as level from g join t x on x.node = u join t y on y.node = v where u <> v""")
def structural_orientation(spark, sf_dir):
    """Each edge pointed away from the root by the depths of its ends (M8)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    e = lines.distinct()
    d = graph.depths(lines, "u", "v", lines.agg(F.min(F.least("u", "v")).alias("node")))
    at = lambda k: d.select(F.col("node").alias(k), F.col("depth").alias(f"d{k}"))
    rows = e.filter("u <> v").join(at("u"), "u").join(at("v"), "v")
    direction = F.when(F.col("du") < F.col("dv"), 1).when(F.col("du") > F.col("dv"), -1).when(F.col("u") < F.col("v"), 1).otherwise(-1)
    return rows.select("u", "v", direction.alias("direction"), F.least("du", "dv").alias("level"))


@query(f"""with recursive {_ORDERS}, b as (select u as a, v as b from g union select v, u from g),
 t(node, label) using key (node) as (select distinct a, a from b union select b.b, min(t.label) from t join b on t.node = b.a join recurring.t r on r.node = b.b where t.label < r.label group by b.b)
 select node, label from t""")
def graph_components(spark, sf_dir):
    """Connected components by smallest labels."""
    return graph.components(_orders(spark, sf_dir), "u", "v")


@query(f"""with {_MEASURED}, n as (select e, u as node, len from i union all select e, v, len from i)
 select node, min(e) as a, max(e) as b, cast(sum(len) as bigint) as length from n group by 1 having count(*) = 2 and min(e) <> max(e)""")
def merge_degree_two(spark, sf_dir):
    """Pairs of edges that a node of degree two makes one (M3)."""
    return graph.passed_through(_measured(spark, sf_dir), "e", "u", "v", "len")


@query()
def spur_pruning(spark, sf_dir):
    """Spur pruning until no spur is left (M3)."""
    return graph.without_spurs(_measured(spark, sf_dir), "u", "v", "len", 6, rounds=None).select(F.col("e").alias("edge"), F.col("len").alias("length"))


@query("""with px as (select distinct l_suppkey as o, l_partkey as p from lineitem) select a.o as a, b.o as b, count(*) as n from px a join px b on a.p = b.p and a.o < b.o group by 1, 2 having count(*) >= 2""")
def pixel_overlap_pairs(spark, sf_dir):
    """Owners that share pixels."""
    return spatial.shared_pixels(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 2)


@query("""with c as (select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, l_extendedprice as cost, l_orderkey, l_linenumber from lineitem),
 r as (select *, row_number() over (partition by a, b order by cost, l_orderkey, l_linenumber) as rn from c) select a, b, cost from r where rn = 1""")
def cheapest_pair(spark, sf_dir):
    """The cheapest candidate of each unordered pair."""
    c = table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_extendedprice").alias("cost"))
    return c.groupBy("a", "b").agg(F.min("cost").alias("cost"))


_LINKED = """o as (select o_orderkey as k, o_custkey % 50 as g, o_totalprice as cost, 2 * o_orderkey + o_orderkey % 2 as d, row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) as n, count(*) over (partition by o_custkey % 50) as m from orders),
 l as (select x.g, xor(x.d, 1) as a, y.d as b, x.cost from o x join o y on x.g = y.g and (y.n = x.n + 1 or (x.n = x.m and y.n = 1 and x.g % 3 = 0))),
 c as (select * from (select *, row_number() over (partition by g order by cost desc, least(a, b), greatest(a, b)) as r from l) where not (g % 3 = 0 and r = 1)),
 k as (select a as e, b as f from c union all select b, a from c)"""


@query(f"""with recursive {_LINKED}, f as (select xor(d, x) as head from o, (values (0), (1)) as t(x) where xor(d, x) not in (select e from k)),
 w(head, place, d) as (select head, 0, head from f union all select w.head, place + 1, k.f from w join k on k.e = xor(w.d, 1)),
 t as (select head, arg_max(xor(d, 1), place) as out from w group by 1)
 select w.head // 2 as chain, place, d // 2 as edge, d % 2 = 1 as reversed from w join t using (head) where w.head <= t.out and (w.head // 2) in (select e // 2 from k)""")
def ranked_chains(spark, sf_dir):
    """Orders linked end to end by date, 50 chains or rings: rings cut at their dearest link, the place of each."""
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("g"), F.col("o_totalprice").alias("cost"), (F.col("o_orderkey") * 2 + F.col("o_orderkey") % 2).alias("d"))
    first = F.first("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = F.coalesce(F.lead("d").over(w), F.when(F.col("g") % 3 == 0, first))
    links = o.select(F.col("d").bitwiseXOR(F.lit(1)).alias("a"), b.alias("b"), "cost").filter("b is not null")
    return chains.ranked_chains(links)


@query(f"""with {EVENTS}, s as (select event_id, user_id, event_type = 'error' and lag(event_id) over w is not null and lead(event_id) over w is not null as branch, lag(event_id) over w as before, event_type = 'error' or lag(event_id) over w is null or lead(event_id) over w is null as stop from e window w as (partition by user_id order by us, event_id)),
 g as (select *, sum(case when stop then 1 else 0 end) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as part from (select s.*, us from s join e using (event_id))),
 p as (select min(event_id) as least_edge, arg_min(before, us) as u, arg_max(event_id, us) as v, count(*) as edges, sum(event_id % 7 + 1) as length from g where before is not null group by user_id, part),
 a as (select least(u, v) as u, greatest(u, v) as v, edges, length from p union all select event_id, 1000000000 + event_id, 1, 1 from s where branch)
 select u, v, edges, cast(length as bigint) as length from a""")
def contracted_edges(spark, sf_dir):
    """Paths of a user's events, with a branch at each error inside: every node that joins just two edges is passed through (M3, M6)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("inner", F.lag("event_id").over(w).isNotNull() & F.lead("event_id").over(w).isNotNull())
    along = e.select((F.col("event_id") * 2).alias("edge"), F.lag("event_id").over(w).alias("u"), F.col("event_id").alias("v"), (F.col("event_id") % 7 + 1).alias("length")).filter("u is not null")
    away = e.filter("event_type = 'error' and inner").select((F.col("event_id") * 2 + 1).alias("edge"), F.col("event_id").alias("u"), (F.col("event_id") + 1_000_000_000).alias("v"), F.lit(1).cast("long").alias("length"))
    out = chains.contracted(along.unionByName(away), "edge", "u", "v", "length")
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "edges", "length")
