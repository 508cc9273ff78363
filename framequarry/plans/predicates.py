"""Queries on predicates, small joins, weighted aggregates and scalar formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import printed
from .registry import EVENTS, events, query, r6, table


@query("""select event_id, coalesce(k >= 20 and value > 2 and event_type <> 'error' and value < 30 and k <= 90, false) as good,
 concat_ws('/', case when value < 1 then 'mdl' end, case when k < 10 then 'density' end, case when value > 25 then 'blob' end) as why
 from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) e""")
def good_and_why(spark, sf_dir):
    """Five conditions, null is false; and the reasons to prune."""
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    v, k = F.col("value"), F.col("k")
    good = F.coalesce((k >= 20) & (v > 2) & (F.col("event_type") != "error") & (v < 30) & (k <= 90), F.lit(False))
    return e.select("event_id", good.alias("good"), F.concat_ws("/", F.when(v < 1, "mdl"), F.when(k < 10, "density"), F.when(v > 25, "blob")).alias("why"))


@query("""with m as (select o_custkey % 50 as g, median(o_totalprice) as med from orders group by 1),
 d as (select g, median(abs(o_totalprice - med)) as mad from orders join m on g = o_custkey % 50 group by 1)
 select o_orderkey, (o_totalprice - med) / nullif(1.4826 * mad, 0) < -1.2 and o_totalprice < med - 5000 as rejected from orders join m on g = o_custkey % 50 join d using (g)""")
def template_disagreement(spark, sf_dir):
    """Rejected where far below the others and by enough."""
    from ..functions.stats import median_mad

    o = table(spark, sf_dir, "orders").withColumn("g", F.col("o_custkey") % 50)
    s = median_mad(o.select("g", "o_totalprice"), ["g"], "o_totalprice")
    z = (F.col("o_totalprice") - F.col("med")) / F.nullif(F.col("mad") * 1.4826, F.lit(0.0))
    return o.join(s, "g").select("o_orderkey", ((z < -1.2) & (F.col("o_totalprice") < F.col("med") - 5000)).alias("rejected"))


@query("""select o_orderkey, len(list_filter([1.0::double, 2.0, 4.0, 8.0], lambda s: 4 * s <= o_custkey % 40)) as scales,
 coalesce(list_max(list_filter([1.0::double, 2.0, 4.0, 8.0], lambda s: 4 * s <= o_custkey % 40)), 1.0::double) as largest from orders""")
def usable_scales(spark, sf_dir):
    """Scales that fit a height, with a fall-back."""
    ok = F.filter(F.array(*[F.lit(x) for x in (1.0, 2.0, 4.0, 8.0)]), lambda s: s * 4 <= F.col("o_custkey") % 40)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(ok).cast("long").alias("scales"), F.coalesce(F.array_max(ok), F.lit(1.0)).alias("largest"))


@query("""with t as (select l_orderkey as idx, max(l_extendedprice) as ncc from lineitem where l_linenumber > 2 group by 1)
 select o_orderkey, o_custkey, round(ncc, 2) as ncc, t.idx is not null as registered from orders left join t on t.idx = o_orderkey""")
def keep_rows_add_score(spark, sf_dir):
    """All rows of one result with the score of another."""
    t = table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("idx")).agg(F.max("l_extendedprice").alias("ncc"))
    o = table(spark, sf_dir, "orders")
    return o.join(t, o.o_orderkey == t.idx, "left").select("o_orderkey", "o_custkey", F.round("ncc", 2).alias("ncc"), F.col("idx").isNotNull().alias("registered"))


@query(f"""with {EVENTS}, p as (select user_id, event_id, us from e where event_type = 'view'), o as (select user_id, event_id as off, us, value from e where event_type = 'click'),
 j as (select p.event_id, o.off, o.value, row_number() over (partition by p.event_id order by o.us desc, o.off desc) as rn from p join o on o.user_id = p.user_id and o.us <= p.us and o.us > p.us - 43200000000)
 select event_id, off, value from j where rn = 1""")
def newest_offset(spark, sf_dir):
    """Each preview with the newest offset that came within half a day before it (C14)."""
    e = events(spark, sf_dir)
    span = 43_200_000_000
    p = e.filter("event_type = 'view'").select("user_id", "event_id", "us", F.floor(F.col("us") / span).alias("cell"))
    o = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("off"), F.col("us").alias("at"), "value", F.explode(F.array(F.floor(F.col("us") / span), F.floor(F.col("us") / span) + 1)).alias("cell"))
    j = p.join(o, ["user_id", "cell"]).filter(F.col("at").between(F.col("us") - span + 1, F.col("us")))
    return j.groupBy("event_id").agg(F.max(F.struct("at", "off", "value")).alias("x")).select("event_id", "x.off", "x.value")


@query("""with k as (select * from (values (0, 1, 2, 3), (1, 2, 1, 3), (2, 3, 1, 2)) as t(pairing, a, b, c)),
 n as (select s_suppkey, s_acctbal, k.* from supplier, k), r as (select *, abs(sin(s_acctbal * a) - cos(s_acctbal * b)) as cost from n)
 select s_suppkey, cast(arg_min(pairing, round(cost, 9)) as int) as best, round(min(cost), 6) as cost from r group by 1""")
def best_pairing(spark, sf_dir):
    """The best of the three pairings of a crossing's ends."""
    k = F.array(*[F.struct(F.lit(p).alias("pairing"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in ((0, 1, 2), (1, 2, 1), (2, 3, 1))])
    n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(k).alias("k"))
    cost = F.abs(F.sin(F.col("s_acctbal") * F.col("k.a")) - F.cos(F.col("s_acctbal") * F.col("k.b")))
    n = n.withColumn("cost", cost)
    return n.groupBy("s_suppkey").agg(F.min_by("k.pairing", F.round("cost", 9)).alias("best"), F.round(F.min("cost"), 6).alias("cost"))


@query("""select l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as weighted, round(sum(l_extendedprice * (1 - l_discount)) / sum(1 - l_discount), 4) as tissue,
 round(stddev_pop(l_quantity) * sqrt(avg(l_extendedprice)), 4) as smear, round(sqrt(avg(l_quantity * l_quantity)), 6) as rms,
 round(1 - sum(pow(l_quantity - 25, 2)) / sum(pow(l_quantity, 2)), 6) as explained from lineitem group by 1 having sum(l_quantity) >= 1""")
def weighted_pictures(spark, sf_dir):
    """Weighted means, smear and residual size."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(q).alias("w"), F.round(F.sum(p * q) / F.sum(q), 4).alias("weighted"), F.round(F.sum(p * (1 - d)) / F.sum(1 - d), 4).alias("tissue"), F.round(F.stddev_pop(q) * F.sqrt(F.avg(p)), 4).alias("smear"), F.round(F.sqrt(F.avg(q * q)), 6).alias("rms"), F.round(1 - F.sum(F.pow(q - 25, 2)) / F.sum(F.pow(q, 2)), 6).alias("explained"))
    return g.filter("w >= 1").drop("w")


@query(f"""with {EVENTS}, b as (select event_id, user_id % 6 as block, event_id % 9 as frame, value from e), s as (select block, frame, avg(value) as shade from b where value < 15 group by 1, 2),
 c as (select block, frame, shade - avg(shade) over (partition by block) as shade from s) select event_id, round(value - shade, 6) + 0.0 as flat from b join c using (block, frame)""")
def shading_removed(spark, sf_dir):
    """Each frame less its shading on background, centred over frames."""
    b = events(spark, sf_dir).select("event_id", (F.col("user_id") % 6).alias("block"), (F.col("event_id") % 9).alias("frame"), "value")
    s = b.filter("value < 15").groupBy("block", "frame").agg(F.avg("value").alias("shade"))
    c = s.withColumn("shade", F.col("shade") - F.avg("shade").over(Window.partitionBy("block")))
    return b.join(c, ["block", "frame"]).select("event_id", r6(F.col("value") - F.col("shade")).alias("flat"))


@query("""select o_custkey, round(median(o_totalprice), 6) as median, round(avg(o_totalprice) / median(o_totalprice) - 1, 6) as error from orders group by 1""")
def per_vessel_median(spark, sf_dir):
    """Medians by group and a relative error."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.median("o_totalprice"), 6).alias("median"), F.round(F.avg("o_totalprice") / F.median("o_totalprice") - 1, 6).alias("error"))


@query(f"""with {EVENTS}, w as (select user_id, event_id, avg(value) over b as m, count(*) over b as n from e window b as (partition by user_id order by event_id rows between current row and 7 following)),
 p as (select *, row_number() over (partition by user_id order by event_id) - 1 as pos from w), r as (select *, row_number() over (partition by user_id order by round(m, 9) desc, event_id) as rn from p where n = 8 and pos % 3 = 0)
 select user_id, event_id as first, round(m, 6) as score from r where rn = 1""")
def best_block(spark, sf_dir):
    """The best run of eight frames, tried at every third."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ahead = w.rowsBetween(0, 7)
    p = events(spark, sf_dir).select("user_id", "event_id", F.avg("value").over(ahead).alias("m"), F.count(F.lit(1)).over(ahead).alias("n"), (F.row_number().over(w) - 1).alias("pos"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("m", 9)), "event_id"))
    return p.filter("n = 8 and pos % 3 = 0").withColumn("rn", rn).filter("rn = 1").select("user_id", F.col("event_id").alias("first"), F.round("m", 6).alias("score"))


@query(f"""with {EVENTS}, p as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as pos from e)
 select a.event_id, round(sum(b.value * exp(-0.5 * pow((b.pos - a.pos) / 1.5, 2))) / sum(exp(-0.5 * pow((b.pos - a.pos) / 1.5, 2))), 6) as smooth
 from p a join p b on a.user_id = b.user_id and abs(a.pos - b.pos) <= 6 group by 1""")
def gaussian_mean(spark, sf_dir):
    """Gaussian-weighted running mean, normalised at the ends: thirteen shifted columns, no self-join."""
    import math

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir)
    top, low = F.lit(0.0), F.lit(0.0)
    for k in range(-6, 7):
        at = F.lag("value", -k).over(w) if k else F.col("value")
        g = math.exp(-0.5 * (k / 1.5) ** 2)
        top, low = top + F.coalesce(at * g, F.lit(0.0)), low + F.when(at.isNotNull(), g).otherwise(0.0)
    return e.select("event_id", F.round(top / low, 6).alias("smooth"))


@query(f"""with {EVENTS}, h as (select user_id, row_number() over (partition by user_id order by event_id) % 2 as half, value from e),
 m as (select user_id, avg(value) filter (half = 0) as a, avg(value) filter (half = 1) as b from h group by 1)
 select user_id, a is not null and b is not null and abs(a - b) <= 0.35 * abs((a + b) / 2) + 0.3 as persistent from m""")
def split_half_persistence(spark, sf_dir):
    """Whether both halves agree."""
    h = events(spark, sf_dir).select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) % 2).alias("half"), "value")
    m = h.groupBy("user_id").agg(F.avg(F.when(F.col("half") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= F.abs((F.col("a") + F.col("b")) / 2) * 0.35 + 0.3
    return m.select("user_id", (F.col("a").isNotNull() & F.col("b").isNotNull() & F.coalesce(near, F.lit(False))).alias("persistent"))


@query("""select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber, l_partkey) as place,
 'V' || lpad(cast(dense_rank() over (order by l_orderkey) % 100 as varchar), 2, '0') as label from lineitem""")
def place_along_edge(spark, sf_dir):
    """Places of nodes along an edge, and numbered labels.

    Edges are numbered by ranges of their keys: each range counts its own and starts where those before it end.
    """
    li = table(spark, sf_dir, "lineitem")
    keys = cut(li.select("l_orderkey").distinct().repartitionByRange("l_orderkey").withColumn("part", F.spark_partition_id()))
    sizes = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("least"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.least") < F.col("x.least"), "left").groupBy("x.part").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("l_orderkey"))
    keys = keys.withColumn("own", own).join(before, "part").select("l_orderkey", (F.col("own") + F.col("before")).alias("d"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", "l_partkey"))
    return li.join(keys, "l_orderkey").select("l_orderkey", "l_linenumber", place.cast("long").alias("place"), F.concat(F.lit("V"), F.lpad((F.col("d") % 100).cast("string"), 2, "0")).alias("label"))


@query("""with x as (select o_custkey, list(o_orderpriority order by o_orderkey) as p from orders group by 1),
 d as (select o_custkey, min(o_orderkey) as first, o_orderpriority as p from orders group by 1, 3)
 select o_custkey, string_agg(p, '>' order by first) as through from d group by 1""")
def ordered_distinct(spark, sf_dir):
    """Distinct names in the order they first occur."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    return o.select("o_custkey", F.array_join(F.array_distinct(F.col("x.o_orderpriority")), ">").alias("through"))


@query("""select event_id, cast(coalesce(nullif(regexp_extract(event_type || '_' || cast(event_id % 3 * 4 + 8 as varchar) || 'p', '_([0-9]+)', 1), ''), '0') as int) as bits,
 round(value / 1.6 * pi() * pow(event_id % 7, 2) / 4, 6) as flow, case when value > 0 then round(1 / (value * value), 6) else 0 end as weight,
 round(0.9 * value - 0.1 * (event_id % 11) + 3, 6) as ax, round(0.1 * value + 0.9 * (event_id % 11) - 2, 6) as ay, coalesce(nullif(printf('%.2f', value), ''), 'n/a') as shown from events""")
def vessel_formulas(spark, sf_dir):
    """Bits of a format's name, volumetric flow, weights, an affine map, fixed digits."""
    import math

    v, y = F.col("value"), F.col("event_id") % 11
    name = F.concat("event_type", F.lit("_"), (F.col("event_id") % 3 * 4 + 8).cast("string"), F.lit("p"))
    bits = F.coalesce(F.nullif(F.regexp_extract(name, "_([0-9]+)", 1), F.lit("")), F.lit("0")).cast("int")
    flow = v / 1.6 * math.pi * F.pow(F.col("event_id") % 7, F.lit(2)) / 4
    return events(spark, sf_dir).select("event_id", bits.alias("bits"), F.round(flow, 6).alias("flow"), F.when(v > 0, F.round(1 / (v * v), 6)).otherwise(F.lit(0.0)).alias("weight"), F.round(0.9 * v - 0.1 * y + 3, 6).alias("ax"), F.round(0.1 * v + 0.9 * y - 2, 6).alias("ay"), F.coalesce(printed(v, 2), F.lit("n/a")).alias("shown"))
