"""Exact k nearest neighbours without a radius: a tree of cells of bounded load, searched level by level.

Points at one place are one site with as many identifiers as can matter, so no cell is full of equal points. Cells with
more than LOAD sites are split into 16, level by level, until none is left. All queries then go down the tree together:
a cell with enough sites bounds the distance that a query has to look, and cells beyond the bound are left out. What a
query keeps at a level are the few cells around it, also beside a dense cluster; leaves hold LOAD sites at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

LOAD = 16
#: Bits of a place along each axis, and bits that a level takes.
BITS, STEP = 48, 2
#: Against rounding: cells this much beyond the bound are still looked into.
SLACK = 1 + 1e-9


def _cell(c: str, level: int):
    return F.shiftright(c, BITS - STEP * level)


def _tree(sites: DataFrame, write) -> tuple[list[DataFrame], DataFrame]:
    """Cells of each level (px, py, cx, cy, n, bounds, leaf), and sites with their leaf (level, cx, cy)."""
    tables, placed, left, level = [], None, sites, 0
    while True:
        last = level == BITS // STEP
        at = left.withColumn("cx", _cell("ix", level)).withColumn("cy", _cell("iy", level))
        cells = at.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"))
        cells = write(cells.withColumn("leaf", F.lit(last) | (F.col("n") <= LOAD)).withColumn("px", F.shiftright("cx", STEP)).withColumn("py", F.shiftright("cy", STEP)))
        tables.append(cells)
        known = at.join(cells.select("cx", "cy", "leaf"), ["cx", "cy"])
        settled = known.filter("leaf").select(F.lit(level).alias("level"), "cx", "cy", "sx", "sy", "ids")
        placed = settled if placed is None else placed.unionByName(settled)
        if cells.filter("not leaf").isEmpty():
            return tables, write(placed)
        left, level = write(known.filter("not leaf").drop("cx", "cy", "leaf")), level + 1


def k_nearest(targets: DataFrame, ident: str, x: str, y: str, k: int, queries: DataFrame | None = None, write=cut) -> DataFrame:
    """a, b, dist, rank: the ``k`` nearest targets b of each query a, by distance and then by identifier; fewer only if there are fewer.

    Without ``queries`` (same columns) each target looks for the others. Points without finite coordinates have no
    neighbours and are none.
    """
    real = lambda df: df.select(F.col(ident).alias("id"), F.col(x).cast("double").alias("sx"), F.col(y).cast("double").alias("sy")).filter("abs(sx) < double('infinity') and abs(sy) < double('infinity')")
    points = real(targets)
    need = k if queries is not None else k + 1
    first = F.row_number().over(Window.partitionBy("sx", "sy").orderBy("id"))
    sites = points.withColumn("n", first).filter(F.col("n") <= need).groupBy("sx", "sy").agg(F.collect_list("id").alias("ids"))
    box = points.agg(F.min("sx").alias("x"), F.min("sy").alias("y"), F.greatest(F.max("sx") / 2 - F.min("sx") / 2, F.max("sy") / 2 - F.min("sy") / 2).alias("half")).first()
    if box.x is None:
        return points.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).limit(0)
    scale = float(1 << BITS)
    place = lambda c, low: F.least(F.floor((F.col(c) / 2 - low / 2) / (box.half or 1.0) * scale).cast("long"), F.lit((1 << BITS) - 1))
    tables, leaves = _tree(write(sites.withColumn("ix", place("sx", box.x)).withColumn("iy", place("sy", box.y))), write)

    asked = (points if queries is None else real(queries)).select(F.col("id").alias("q"), F.col("sx").alias("qx"), F.col("sy").alias("qy"))
    asked = asked.distinct()
    gap = lambda lo, hi, at: F.greatest(F.col(lo) - F.col(at), F.col(at) - F.col(hi), F.lit(0.0))
    far = lambda lo, hi, at: F.greatest(F.abs(F.col(at) - F.col(lo)), F.abs(F.col(hi) - F.col(at)))
    square = lambda f: f("x0", "x1", "qx") * f("x0", "x1", "qx") + f("y0", "y1", "qy") * f("y0", "y1", "qy")
    bound = F.min(F.when(F.col("n") >= need, F.col("most"))).over(Window.partitionBy("q", "qx", "qy"))
    names = ["q", "qx", "qy", "level", "cx", "cy", "leaf", "n", "least", "most"]

    front = asked.select("*", F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"))
    kept = None
    for level, cells in enumerate(tables):
        new = front.join(cells, ["px", "py"]).withColumn("level", F.lit(level)).withColumn("least", square(gap)).withColumn("most", square(far)).select(*names)
        every = new if kept is None else kept.unionByName(new)
        near = every.withColumn("bound", bound).filter(F.col("bound").isNull() | (F.col("least") <= F.col("bound") * SLACK))
        near = write(near.select(*names))
        # leaves wait; the children of the others are looked up at the next level
        kept = near.filter("leaf")
        front = near.filter("not leaf").select("q", "qx", "qy", F.col("cx").alias("px"), F.col("cy").alias("py"))
    dist = F.sqrt(F.pow(F.col("qx") - F.col("sx"), F.lit(2)) + F.pow(F.col("qy") - F.col("sy"), F.lit(2)))
    pairs = kept.join(leaves, ["level", "cx", "cy"]).select("q", "qx", "qy", dist.alias("dist"), F.explode("ids").alias("b"))
    if queries is None:
        pairs = pairs.filter("q <> b")
    rank = F.row_number().over(Window.partitionBy("q", "qx", "qy").orderBy("dist", "b"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias("a"), "b", "dist", "rank")
