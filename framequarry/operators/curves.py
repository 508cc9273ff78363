"""Curves as ordered points: arc length, tortuosity, turning, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import steady_sum


def steps(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """df with step (from the point before, 0 for the first) and arc (running sum)."""
    by = Window.partitionBy(key).orderBy(order)
    step = F.coalesce(F.sqrt(F.pow(F.col(x) - F.lag(x).over(by), 2) + F.pow(F.col(y) - F.lag(y).over(by), 2)), F.lit(0.0))
    df = df.withColumn("step", step)
    return df.withColumn("arc", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def without_repeats(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Points that differ from the one before."""
    by = Window.partitionBy(key).orderBy(order)
    same = (F.col(x) == F.lag(x).over(by)) & (F.col(y) == F.lag(y).over(by))
    return df.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same").drop("_same")


def tortuosity(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """key, points, length, chord, distance_metric (length / chord), turning (sum of angles), inflections."""
    by = Window.partitionBy(key).orderBy(order)
    rows = steps(df, key, order, x, y)
    dx, dy = F.col(x) - F.lag(x).over(by), F.col(y) - F.lag(y).over(by)
    rows = rows.withColumn("dx", dx).withColumn("dy", dy)
    pdx, pdy = F.lag("dx").over(by), F.lag("dy").over(by)
    rows = rows.withColumn("side", F.round(pdx * F.col("dy") - pdy * F.col("dx"), 6)).withColumn("turn", F.atan2("side", pdx * F.col("dx") + pdy * F.col("dy")))
    rows = rows.withColumn("flip", F.col("side") * F.lag("side").over(by) < 0)
    ends = lambda c: (F.max_by(c, order) - F.min_by(c, order))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("points"), steady_sum(F.col("step")).alias("length"), F.sqrt(F.pow(ends(x), 2) + F.pow(ends(y), 2)).alias("chord"), steady_sum(F.abs("turn")).alias("turning"), F.count_if("flip").alias("inflections"))
    return out.withColumn("distance_metric", F.when(F.col("chord") > 0, F.col("length") / F.col("chord")))
