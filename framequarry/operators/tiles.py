"""Work on frames of any size by tiles: samples at points of many curves in one pass, and components across tile borders.

A tile repeats the row and the column behind it, so every point between pixels lies in one tile. No task holds a frame
once it is cut, and what is joined are tiles with the points, or the border pixels, that lie in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .graph import components
from .pictures import labelled


def tiled(frames: DataFrame, side: int, halo: int = 1) -> DataFrame:
    """id, width, ty, tx, y0, x0, th, tw, tile of frames (id, height, width, v: pixels by row): squares of ``side`` and a halo below and to the right."""
    if side < 1:
        raise ValueError("tiles have a side of 1 at least")
    steps = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / side).cast("int"))
    rows = frames.filter("height > 0 and width > 0").select("*", F.explode(steps("height")).alias("ty")).select("*", F.explode(steps("width")).alias("tx"))
    rows = rows.withColumn("y0", F.col("ty") * side).withColumn("x0", F.col("tx") * side)
    rows = rows.withColumn("th", F.least(F.lit(side + halo), F.col("height") - F.col("y0"))).withColumn("tw", F.least(F.lit(side + halo), F.col("width") - F.col("x0")))
    part = F.flatten(F.transform(F.sequence(F.lit(0), F.col("th") - 1), lambda k: F.slice("v", (F.col("y0") + k) * F.col("width") + F.col("x0") + 1, F.col("tw"))))
    return rows.select("id", "width", "ty", "tx", "y0", "x0", "th", "tw", part.alias("tile"))


def kymographs(frames: DataFrame, points: DataFrame, side: int = 256, bright: float | None = None, normalize: bool = True) -> DataFrame:
    """burst, vessel, id, s, value, n: for all vessels of a recording in all of its frames, the mean of the samples across each place.

    ``frames``: burst, id, height, width, v, map (a, b, c, d, e, f: a point (x, y) of the recording is at (ax + by + c,
    dx + ey + f) of the frame). ``points``: burst, vessel, s (place along), w (place across), y, x. Samples are
    bilinear; outside of the frame, or where the nearest pixel is over ``bright``, there is none. With ``normalize`` a
    frame is divided by its median. A place without any sample has a null value and n = 0.
    """
    middle = F.array_sort("v")
    median = (F.get(middle, F.floor((F.size("v") - 1) / 2).cast("int")) + F.get(middle, F.floor(F.size("v") / 2).cast("int"))) / 2
    head = frames.select("burst", "id", "height", "width", "map", (median if normalize else F.lit(1.0)).alias("level"))
    m = lambda k: F.col("map")[k]
    asked = head.join(points, "burst").withColumn("fx", m(0) * F.col("x") + m(1) * F.col("y") + m(2)).withColumn("fy", m(3) * F.col("x") + m(4) * F.col("y") + m(5))
    inside = (F.col("fx") >= 0) & (F.col("fy") >= 0) & (F.col("fx") <= F.col("width") - 1) & (F.col("fy") <= F.col("height") - 1)
    asked = asked.select("burst", "id", "vessel", "s", "level", F.when(inside, F.col("fx")).alias("fx"), F.when(inside, F.col("fy")).alias("fy"))
    place = lambda c: F.floor(F.col(c) / side).cast("int")
    seen = asked.filter("fx is not null").withColumn("ty", place("fy")).withColumn("tx", place("fx")).join(tiled(frames.select("id", "height", "width", "v"), side).drop("width"), ["id", "ty", "tx"])
    ly, lx = F.col("fy") - F.col("y0"), F.col("fx") - F.col("x0")
    iy, ix = F.floor(ly).cast("int"), F.floor(lx).cast("int")
    py, px = ly - iy, lx - ix
    at = lambda y, x: F.get("tile", (F.least(y, F.col("th") - 1) * F.col("tw") + F.least(x, F.col("tw") - 1)).cast("int"))
    value = (at(iy, ix) * (1 - px) + at(iy, ix + 1) * px) * (1 - py) + (at(iy + 1, ix) * (1 - px) + at(iy + 1, ix + 1) * px) * py
    nearest = at(iy + F.when(py >= 0.5, 1).otherwise(0), ix + F.when(px >= 0.5, 1).otherwise(0))
    value = value if bright is None else F.when(nearest <= bright, value)
    sampled = seen.select("burst", "id", "vessel", "s", (value / F.col("level")).alias("value"))
    both = sampled.unionByName(asked.filter("fx is null").select("burst", "id", "vessel", "s", F.lit(None).cast("double").alias("value")))
    return both.groupBy("burst", "vessel", "id", "s").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def spots_of_tiles(cells: DataFrame, level: float, write=cut) -> DataFrame:
    """id, spot, area, cy, cx: components of 8 neighbours of pixels over ``level``, whatever tiles they cross; spot is the first pixel's place.

    ``cells``: id, width (of the whole picture), y0, x0, th, tw, tile; tiles do not overlap. A place is y * width + x.
    Each tile numbers its own components by their first pixel in the picture; pixels along borders tell which of them
    are one, and that is a graph far smaller than the picture. Areas and centres are sums over tiles. Null is no pixel.
    """

    def run(batches):
        for batch in batches:
            out = []
            for ident, width, y0, x0, th, tw, tile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.array([np.nan if v is None else v for v in tile], float).reshape(th, tw)
                spot = labelled((a > level)[None])[0].astype(np.int64)
                ys, xs = np.nonzero(spot)
                _, first, at = np.unique(spot[ys, xs], return_index=True, return_inverse=True)
                edge = (ys == 0) | (ys == th - 1) | (xs == 0) | (xs == tw - 1)
                place = (ys + y0) * width + xs + x0
                rim = np.split(place[edge][np.argsort(at[edge], kind="stable")], np.cumsum(np.bincount(at[edge], minlength=len(first)))[:-1]) if len(first) else []
                area, sy, sx = (np.bincount(at, w, minlength=len(first)) for w in (None, ys + y0, xs + x0))
                out += [(ident, width, int(place[first[k]]), int(area[k]), int(sy[k]), int(sx[k]), rim[k].tolist()) for k in range(len(first))]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["id", "width", "first", "area", "sy", "sx", "edge"])

    kind = dict(cells.dtypes)["id"]
    long = [F.col(c).cast("long").alias(c) for c in ("width", "y0", "x0", "th", "tw")]
    parts = write(cells.select("id", *long, "tile").mapInArrow(run, f"id {kind}, width long, `first` long, area long, sy long, sx long, edge array<long>"))
    border = parts.select("id", "width", "first", F.explode("edge").alias("p"))
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    around = border.select("id", "first", "width", "p", F.explode(steps).alias("dy")).select("*", F.explode(steps).alias("dx")).filter("(dy <> 0 or dx <> 0) and p % width + dx between 0 and width - 1")
    around = around.select("id", (F.col("p") + F.col("dy") * F.col("width") + F.col("dx")).alias("p"), F.col("first").alias("a"))
    met = around.join(border.select("id", "p", F.col("first").alias("b")), ["id", "p"]).filter("a < b")
    node = lambda c: F.struct("id", F.col(c).alias("first"))
    labels = components(write(met.select(node("a").alias("u"), node("b").alias("v")).distinct()), "u", "v", write)
    named = parts.withColumn("node", node("first")).join(labels, "node", "left").withColumn("spot", F.coalesce("label", "node")["first"])
    by = named.groupBy("id", "spot").agg(F.sum("area").alias("area"), F.sum("sy").alias("sy"), F.sum("sx").alias("sx"))
    return by.select("id", "spot", "area", (F.col("sy") / F.col("area")).alias("cy"), (F.col("sx") / F.col("area")).alias("cx"))


def spots_across(frames: DataFrame, level: float, side: int = 512, write=cut) -> DataFrame:
    """id, spot, area, cy, cx of frames (id, height, width, v) that are cut into tiles first."""
    cells = tiled(frames.select("id", "height", "width", "v"), side, halo=0)
    return spots_of_tiles(cells, level, write)
