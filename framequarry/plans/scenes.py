"""Queries that cut frames into tiles: kymographs of all curves in one pass, components of one large picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles
from .pictures import PX
from .registry import query, r6, table

#: Curves of a recording: four, of 16 places, three samples across each; where they run stands in the label's mean vector.
_CURVES = """m as (select label, k, avg(cast(embedding[k] as double)) as m from embeddings, unnest(range(1, 65)) as u(k) group by 1, 2),
 c as (select label, (k - 1) // 16 as vessel, (k - 1) % 16 as s, w, 3.5 + 3.2::double * tanh(6 * m) + 0.8::double * w as y, ((k - 1) % 16) * 7 / 15.0::double as x from m, (values (-1), (0), (1)) as t(w))"""


@query(f"""with {PX}, {_CURVES}, g as (select vec_id, median(v + 3) as level from px group by 1),
 f as (select e.vec_id, c.label, vessel, s, x + 0.02::double * y + embedding[2]::double as fx, y - 0.02::double * x + embedding[1]::double as fy from embeddings e join c using (label)),
 i as (select *, floor(fy) as iy, floor(fx) as ix from f where fx between 0 and 7 and fy between 0 and 7),
 b as (select i.*, fy - iy as py, fx - ix as qx from i),
 n as (select b.*, p00.v + 3 as v00, p01.v + 3 as v01, p10.v + 3 as v10, p11.v + 3 as v11 from b
       join px p00 on p00.vec_id = b.vec_id and p00.y = iy and p00.x = ix join px p01 on p01.vec_id = b.vec_id and p01.y = iy and p01.x = least(ix + 1, 7)
       join px p10 on p10.vec_id = b.vec_id and p10.y = least(iy + 1, 7) and p10.x = ix join px p11 on p11.vec_id = b.vec_id and p11.y = least(iy + 1, 7) and p11.x = least(ix + 1, 7)),
 w as (select *, case when py >= 0.5 and qx >= 0.5 then v11 when py >= 0.5 then v10 when qx >= 0.5 then v01 else v00 end as near, (v00 * (1 - qx) + v01 * qx) * (1 - py) + (v10 * (1 - qx) + v11 * qx) * py as v from n),
 k as (select label, vessel, vec_id, s, avg(v / level) filter (near <= 4.5) as value, count(*) filter (near <= 4.5) as n from w join g using (vec_id) group by all)
 select vec_id, vessel, count(value) as places, cast(sum(n) as bigint) as samples, round(sum(value), 6) as total, round(sum(value * s), 6) as placed from k group by 1, 2""")
def kymographs_in_one_pass(spark, sf_dir):
    """Kymographs of all curves of a recording over all of its frames, from tiles of 3 pixels (K2)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    one, small = F.lit(1.0), F.lit(0.02)
    frames = e.select(F.col("label").alias("burst"), F.col("vec_id").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("e", lambda x: x * 8 + 3).alias("v"), F.array(one, small, F.col("e")[1], -small, one, F.col("e")[0]).alias("map"))
    mean = e.select("label", F.posexplode("e").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    across = mean.select("label", "k", "m", F.explode(F.array(*[F.lit(w) for w in (-1, 0, 1)])).alias("w"))
    points = across.select(F.col("label").alias("burst"), F.floor(F.col("k") / 16).alias("vessel"), (F.col("k") % 16).alias("s"), "w", (3.5 + 3.2 * F.tanh(6 * F.col("m")) + 0.8 * F.col("w")).alias("y"), ((F.col("k") % 16) * 7 / 15.0).alias("x"))
    k = tiles.kymographs(frames, points, side=3, bright=4.5)
    seen = k.filter("n > 0").groupBy(F.col("id").alias("vec_id"), "vessel")
    got = seen.agg(F.count("value").alias("places"), F.sum("n").alias("samples"), r6(F.sum("value")).alias("total"), r6(F.sum(F.col("value") * F.col("s"))).alias("placed"))
    return got


#: Pictures side by side, 32 in a row, each at the place of its identifier: one picture as large as the table.
_MOSAIC = f"""{PX},
 g as (select (vec_id // 32) * 8 + y as gy, (vec_id % 32) * 8 + x as gx from px where v > 1.1),
 b as (select a.gy * 256 + a.gx as a, c.gy * 256 + c.gx as b from g a join g c on c.gy between a.gy - 1 and a.gy + 1 and c.gx between a.gx - 1 and a.gx + 1)"""


@query(f"""with recursive {_MOSAIC}, t(node, label) using key (node) as (select distinct a, a from b union select b.b, min(t.label) from t join b on t.node = b.a join recurring.t r on r.node = b.b where t.label < r.label group by b.b)
 select cast(label as bigint) as spot, count(*) as area, round(avg(node // 256), 6) as cy, round(avg(node % 256), 6) as cx from t group by 1""")
def spots_of_a_large_scene(spark, sf_dir):
    """Bright components of one mosaic of all pictures, found in tiles and joined across their borders."""
    e = table(spark, sf_dir, "embeddings")
    row, column = F.floor(F.col("vec_id") / 32), F.col("vec_id") % 32
    cells = e.select(F.lit("mosaic").alias("id"), F.lit(256).alias("width"), (row * 8).alias("y0"), (column * 8).alias("x0"), F.lit(8).alias("th"), F.lit(8).alias("tw"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("tile"))
    return tiles.spots_of_tiles(cells, 1.1).select("spot", "area", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))
