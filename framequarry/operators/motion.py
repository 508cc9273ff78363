"""Motion of a recording from its trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import grouped_quantiles, large_groups
from ..functions.stats import islands, median_mad, robust_threshold


def speeds(df: DataFrame, key: str, order: str, seconds: str, x: str, y: str) -> DataFrame:
    """df with speed: distance per second from the row before; null for the first row and where time stands still."""
    by = Window.partitionBy(key).orderBy(order)
    dt = F.col(seconds) - F.lag(seconds).over(by)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(by), 2) + F.pow(F.col(y) - F.lag(y).over(by), 2))
    return df.withColumn("speed", F.when(dt > 0, step / dt))


def motion_metrics(df: DataFrame, key: str, order: str, seconds: str, x: str, y: str, mad_k: float = 6.0) -> DataFrame:
    """One row a recording of three rows or more: displacement, range, speed, jitter, saccades and drift."""
    large = large_groups(df, [key])
    centre = grouped_quantiles(df, [key], {"cx": (x, 0.5), "cy": (y, 0.5)}, large)
    moved = df.join(centre, key).withColumn("disp", F.sqrt(F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2)))
    place = moved.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("disp").alias("displacement_max"),
        (F.max(x) - F.min(x)).alias("range_x"),
        (F.max(y) - F.min(y)).alias("range_y"),
        F.sqrt(F.pow(F.regr_slope(x, seconds), 2) + F.pow(F.regr_slope(y, seconds), 2)).alias("drift"),
    )
    place = place.join(grouped_quantiles(moved, [key], {"displacement_median": ("disp", 0.5), "displacement_p95": ("disp", 0.95)}, large), key)
    fast = speeds(df, key, order, seconds, x, y).filter("speed is not null").select(key, "speed")
    limit = median_mad(fast, [key], "speed").select(key, F.col("med").alias("speed_median"), robust_threshold(F.col("med"), F.col("mad"), mad_k).alias("saccade_threshold"))
    jumps = fast.join(limit, key).withColumn("jump", F.col("speed") > F.col("saccade_threshold"))
    rate = jumps.groupBy(key).agg(F.first("speed_median").alias("speed_median"), F.first("saccade_threshold").alias("saccade_threshold"), F.count_if("jump").alias("saccades"), F.sqrt(F.avg(F.when(~F.col("jump"), F.col("speed") * F.col("speed")))).alias("jitter_rms"))
    return place.filter("frames >= 3").join(rate, key, "left")


def fixations(df: DataFrame, key: str, order: str, step: str, limit: str) -> DataFrame:
    """df with fixation: 0, 1, .. in order; a step over the limit begins the next one."""
    return df.withColumn("fixation", islands(F.coalesce(F.col(step) > F.col(limit), F.lit(False)), Window.partitionBy(key).orderBy(order)))


def good_runs(df: DataFrame, key: str, order: str, good: str, least: int = 1) -> DataFrame:
    """key, first, last, length of maximal runs of true ``good``, by consecutive positions."""
    by = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("pos", F.row_number().over(by)).filter(F.col(good))
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(by))
    return rows.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("run")


def trajectory(df: DataFrame, key: str, order: str, steps: list[str]) -> DataFrame:
    """df with <step>_sum: running sums of the steps, centred on their median."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in steps:
        df = df.withColumn(f"{s}_run", F.sum(s).over(upto))
    mid = grouped_quantiles(df, [key], {f"{s}_mid": (f"{s}_run", 0.5) for s in steps}, large_groups(df, [key]))
    df = df.join(mid, key)
    for s in steps:
        df = df.withColumn(f"{s}_sum", F.col(f"{s}_run") - F.col(f"{s}_mid")).drop(f"{s}_run", f"{s}_mid")
    return df
