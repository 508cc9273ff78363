"""Queries on models that are fitted as tables: joint fits of overlapping vessels, pruned maps, best blocks of frames."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import blocks, consensus, field_fit, pruning
from .images import _PX
from .registry import query, table


def r5(c):
    """Rounded to 5 digits, negative zero as zero."""
    return F.round(c, 5) + F.lit(0.0)


#: Across (0) or along (1) a picture, and where; a picture's label moves the first three by up to a pixel.
_VESSELS = ((0, 1.5, 1), (0, 2.2, 1), (1, 2.0, 1), (1, 3.5, 0))
_WIDTH, _REACH, _STEADY, _NEEDED = 0.9, 2.0, 0.05, 0.45
#: Pairs of vessels that count as touching, so that they are not dropped in one round: all but one.
_TOUCHING = [(a, b) for a in range(4) for b in range(4) if a != b and {a, b} != {2, 3}]


def _design():
    """shift, row, col, a: two coefficients a vessel, at its beginning and its end; below them one penalty a vessel on their difference."""
    out = []
    for s in range(3):
        for v, (kind, at, moves) in enumerate(_VESSELS):
            mine = []
            for i in range(64):
                across, along = (i // 8, i % 8) if kind == 0 else (i % 8, i // 8)
                d, t = across - (at + 0.5 * s * moves), along / 7.0
                if abs(d) <= _REACH:
                    p = math.exp(-d * d / (2 * _WIDTH * _WIDTH))
                    mine += [(s, i, 2 * v, p * (1 - t)), (s, i, 2 * v + 1, p * t)]
            w = math.sqrt(_STEADY * len(mine) / 2)
            out += mine + [(s, 1000 + v, 2 * v, -w), (s, 1000 + v, 2 * v + 1, w)]
    return out


def _settle_sql() -> str:
    rows = ", ".join(f"({v}, {kind}, {at}::double, {moves})" for v, (kind, at, moves) in enumerate(_VESSELS))
    out = f"""with recursive {_PX}, w(owner, kind, place, moves) as (values {rows}),
     q as (select s, i, owner, case when kind = 0 then i // 8 else i % 8 end - (place + 0.5::double * s * moves) as d, case when kind = 0 then i % 8 else i // 8 end / 7.0::double as t from w, range(3) a(s), range(64) b(i)),
     p as (select s, i, owner, exp(-d * d / (2 * {_WIDTH}::double * {_WIDTH}::double)) as p, t from q where abs(d) <= {_REACH}),
     e as (select s, i, owner, 2 * owner as col, p * (1 - t) as a from p union all select s, i, owner, 2 * owner + 1, p * t from p),
     n as (select s, owner, {_STEADY}::double * count(*) as w from p group by 1, 2),
     k as (select s, i, col, a from e union all select s, 1000 + owner, 2 * owner, -sqrt(w) from n union all select s, 1000 + owner, 2 * owner + 1, sqrt(w) from n),
     hs as (select x.s, x.col as i, y.col as j, sum(x.a * y.a) as h from k x join k y on x.s = y.s and x.i = y.i group by 1, 2, 3),
     hh as (select distinct vec_id, i, j, h from (select distinct vec_id, label % 3 as s from px) join hs using (s)),
     gg as (select vec_id, col as i, sum(a * v) as g from px join e on e.s = px.label % 3 and e.i = px.pix group by 1, 2),
     alive1 as (select distinct vec_id, owner from px, w)"""
    for r in range(1, 6):
        out += f""",
     base{r} as (select hh.vec_id, i, j, h as v from hh join alive{r} x on x.vec_id = hh.vec_id and x.owner = i // 2 join alive{r} y on y.vec_id = hh.vec_id and y.owner = j // 2
               union all select vec_id, i, 100 + j, case when i = j then 1.0::double else 0.0::double end from (select vec_id, 2 * owner + c as i from alive{r}, range(2) u(c)) join (select vec_id, 2 * owner + c as j from alive{r}, range(2) u(c)) using (vec_id)
               union all select gg.vec_id, i, 1000, g from gg join alive{r} x on x.vec_id = gg.vec_id and x.owner = i // 2),
     gj{r}(step, vec_id, i, j, v) as (select 0, * from base{r} union all
        select step + 1, vec_id, i, j, case when piv is null then v when i = step then v / piv else v - vik * vkj / piv end
        from (select *, max(v) filter (i = step and j = step) over (partition by vec_id) as piv, max(v) filter (j = step) over (partition by vec_id, i) as vik, max(v) filter (i = step) over (partition by vec_id, j) as vkj from gj{r}) where step < 8),
     inv{r} as (select vec_id, i, j, v from gj{r} where step = 8),
     x{r} as (select vec_id, i, v as x from inv{r} where j = 1000),
     en{r} as (select vec_id, owner, sum(m * m) as energy from (select px.vec_id, owner, pix, sum(a * x) as m from px join e on e.s = px.label % 3 and e.i = px.pix join x{r} x on x.vec_id = px.vec_id and x.i = e.col group by 1, 2, 3) group by 1, 2),
     bl{r} as (select vec_id, i // 2 as owner, max(v) filter (i % 2 = 0 and j = 100 + i) as m00, max(v) filter (i % 2 = 1 and j = 100 + i) as m11, max(v) filter (i % 2 = 0 and j = 101 + i) as m01,
               max(v) filter (i % 2 = 0 and j = 1000) as b0, max(v) filter (i % 2 = 1 and j = 1000) as b1 from inv{r} group by 1, 2),
     sc{r} as (select vec_id, owner, (b0 * b0 * m11 - 2 * b0 * b1 * m01 + b1 * b1 * m00) / (m00 * m11 - m01 * m01) / greatest(energy, 1e-12) as score, b0, b1 from bl{r} join en{r} using (vec_id, owner)),
     wk{r} as (select *, row_number() over (partition by vec_id order by score, owner) as rank, arg_min(owner, score) over (partition by vec_id) as first from sc{r} where score < {_NEEDED}),
     gone{r} as (select vec_id, owner from wk{r} where rank = 1 or (first in (2, 3) and owner = 5 - first)),
     alive{r + 1} as (select vec_id, owner from alive{r} where vec_id in (select vec_id from gone{r}) and (vec_id, owner) not in (select (vec_id, owner) from gone{r}))"""
    rounds = " union all ".join(
        f"""select vec_id, owner, score, case when (vec_id, owner) in (select (vec_id, owner) from gone{r}) then {r} end as dropped_in, b0, b1 from sc{r}
            where (vec_id, owner) in (select (vec_id, owner) from gone{r}) or vec_id not in (select vec_id from gone{r})"""
        for r in range(1, 6)
    )
    return f"""{out} select vec_id, owner as vessel, round(score, 5) as score, dropped_in, case when dropped_in is null then round(b0, 5) + 0.0 end as first, case when dropped_in is null then round(b1, 5) + 0.0 end as last from ({rounds})"""


@query(_settle_sql())
def settled_vessels(spark, sf_dir):
    """All vessels of each picture fitted at once; those that others can explain are dropped a few at a time and the rest is fitted again."""
    px = consensus.pixels(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select(F.col("vec_id").alias("system"), F.col("pix").cast("long").alias("row"), "v", (F.col("label") % 3).alias("shift"))
    design = F.broadcast(spark.createDataFrame(_design(), "shift int, row long, col long, a double"))  # of fixed size
    systems = px.select("system", "shift").distinct()
    entries = systems.join(design, "shift").select("system", "row", "col", "a")
    targets = px.select("system", "row", F.col("v").alias("d"))
    owners = spark.createDataFrame([(c, c // 2) for c in range(8)], "col long, owner long")
    pairs = F.broadcast(spark.createDataFrame(_TOUCHING, "owner long, other long"))
    touching = systems.select("system", F.lit(1).alias("one")).join(pairs.withColumn("one", F.lit(1)), "one").select("system", "owner", "other")
    fate, fits = field_fit.settle(entries, targets, owners, touching, _NEEDED)
    ends = fits.withColumn("owner", F.floor(F.col("col") / 2)).groupBy("system", "owner").agg(F.min_by("x", "col").alias("first"), F.max_by("x", "col").alias("last"))
    out = fate.join(ends.hint("merge"), ["system", "owner"], "left")  # grows with the table: not broadcast
    fit = lambda c: F.when(F.col("dropped_in").isNull(), F.round(c, 5) + F.lit(0.0))
    return out.select(F.col("system").alias("vec_id"), F.col("owner").alias("vessel"), F.round("score", 5).alias("score"), "dropped_in", fit("first").alias("first"), fit("last").alias("last"))


@query("""with recursive c as (select l_partkey as edge, l_orderkey as pixel, sum(l_discount * 10 - 0.4) as c from lineitem group by 1, 2), d as (select o_orderkey as pixel, (o_totalprice % 100) / 60.0 as d from orders),
 p as (select edge, 0.1 * ln(count(*) + 1) * (2 + edge % 3) as price, edge % 11 = 0 as protected from c group by 1),
 t(round, edge, pixel, c, d, price, protected) as (select 0, edge, pixel, c, d, price, protected from c join d using (pixel) join p using (edge) union all
   select round + 1, edge, pixel, c, d, price, protected from (select *, count(*) filter (case when protected then gain <= 0 else gain < price end) over () as goes from
     (select *, sum(2 * (d - m) * c + c * c) over (partition by edge) as gain from (select *, sum(c) over (partition by pixel) as m from t))) where goes > 0 and not (case when protected then gain <= 0 else gain < price end)),
 g as (select round, edge, count(*) as pixels, sum(2 * (d - m) * c + c * c) as gain from (select *, sum(c) over (partition by round, pixel) as m from t) group by 1, 2),
 l as (select edge, max(round) as last from t group by 1), z as (select max(round) as z from t)
 select l.edge, round(gain, 5) + 0.0 as gain, pixels, case when last < z or (case when protected then gain <= 0 else gain < price end) then last + 1 end as removed_in from l join z on true join g on g.edge = l.edge and g.round = l.last join p on p.edge = l.edge""")
def pruned_map(spark, sf_dir):
    """Edges that gain less than their price go, round by round, and only what they touched is scored again."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("edge"), F.col("l_orderkey").alias("pixel")).agg(F.sum(F.col("l_discount") * 10 - 0.4).alias("c"))
    li = cut(li)  # read by every round
    data = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pixel"), ((F.col("o_totalprice") % 100) / 60.0).alias("d"))
    edges = li.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).select("edge", (0.1 * F.log(F.col("n") + 1) * (2 + F.col("edge") % 3)).alias("price"), (F.col("edge") % 11 == 0).alias("protected"))
    out, _ = pruning.pruned(li, data, edges, summed=True)
    return out.select("edge", r5("gain").alias("gain"), "pixels", "removed_in")


@query(f"""with {_PX}, f as (select label, vec_id, dense_rank() over (partition by label order by vec_id) - 1 as k, pix, v from px), n as (select label, max(k) + 1 as n from f group by 1),
 s as (select label, unnest(range(0, n - 11, 3)) as first from n), b as (select s.label, s.first, f.k, f.pix, f.v from s join f on f.label = s.label and f.k between s.first and s.first + 11),
 m as (select label, first, pix, avg(v) as m from b group by 1, 2, 3), zm as (select label, first, pix, (m - avg(m) over w) / (stddev_pop(m) over w + 1e-12) as zm from m window w as (partition by label, first)),
 zb as (select label, first, k, pix, (v - avg(v) over w) / (stddev_pop(v) over w + 1e-12) as zb from b window w as (partition by label, first, k)),
 c as (select label, first, sum(zb * zm) / (64 * 12) as score from zb join zm using (label, first, pix) group by 1, 2)
 select label, cast(arg_max(first, round(score, 9) * 1e6 - first * 1e-6) as bigint) as first, round(max(score), 6) as score from c group by 1""")
def best_block_of_frames(spark, sf_dir):
    """The twelve consecutive pictures of a label that agree best with their mean, of blocks that begin at every third."""
    e = table(spark, sf_dir, "embeddings")
    index = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    frames = e.select(F.col("label").alias("burst"), index.alias("index"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return blocks.best_blocks(frames, 12).select(F.col("burst").alias("label"), "first", F.round("score", 6).alias("score"))
