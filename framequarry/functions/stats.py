"""Robust statistics of groups and ordered series, as DataFrame operations.

NULL means "no data" everywhere; NaN is turned into NULL on the way in (``clean``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .quantiles import grouped_quantiles, large_groups

#: Of a normal distribution: standard deviation / median absolute deviation.
MAD_TO_SD = 1.4826
#: A deviation this small counts as none.
NO_SPREAD = 1e-12


def clean(c: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(c, F.lit(None).cast("double"))


def medians_mads(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and, for each value, <value>_med and <value>_mad: two selections of ranks; the median of deviations cannot nest in one.

    Groups may have any size. Keys that are null make no group.
    """
    df = df.select(*keys, *values)
    large = large_groups(df, keys)
    med = grouped_quantiles(df, keys, {f"{v}_med": (v, 0.5) for v in values}, large)
    far = df.join(med, keys).select(*keys, *[F.abs(F.col(v) - F.col(f"{v}_med")).alias(v) for v in values])
    mad = grouped_quantiles(far, keys, {f"{v}_mad": (v, 0.5) for v in values}, large)
    return med.join(mad, keys)


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, med, mad."""
    return medians_mads(df, keys, [value]).select(*keys, F.col(f"{value}_med").alias("med"), F.col(f"{value}_mad").alias("mad"))


def robust_z(value: Column, med: Column, mad: Column) -> Column:
    """(x - median) / (1.4826 MAD); 0 where there is no spread."""
    return F.when(mad <= NO_SPREAD, F.lit(0.0)).otherwise((value - med) / (mad * MAD_TO_SD))


def robust_threshold(med: Column, mad: Column, k: float) -> Column:
    return med + mad * (k * MAD_TO_SD)


def standardized(value: Column, by: WindowSpec) -> Column:
    """Population standard score over a window; the small constant avoids division by nothing."""
    return (value - F.avg(value).over(by)) / (F.stddev_pop(value).over(by) + 1e-12)


def islands(flag: Column, by: WindowSpec) -> Column:
    """Number of the stretch a row belongs to; a true ``flag`` begins a new one."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def evenly_spaced(n: Column, k: int) -> Column:
    """Indices 0..n-1 of k evenly spaced picks, ends included, rounded down."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(k - 1)).cast("long"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """keys, weighted_median: the first value, in order, at which half of the weight is reached."""
    order = Window.partitionBy(*keys).orderBy(value, tie)
    w = df.withColumn("upto", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    w = w.withColumn("whole", F.sum(weight).over(Window.partitionBy(*keys)))
    return w.filter(F.col("upto") * 2 >= F.col("whole")).groupBy(*keys).agg(F.min_by(value, F.struct("upto", value, tie)).alias("weighted_median"))


def histogram_mode(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """keys, mode_bin, mode_count: the fullest bin of the given width, the lowest of equals."""
    bins = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("bin")).alias("neg"))).alias("x")
    return bins.groupBy(*keys).agg(best).select(*keys, (-F.col("x.neg")).alias("mode_bin"), F.col("x.n").alias("mode_count"))


def best_stretch(df: DataFrame, keys: list[str], order: str, gain: str) -> DataFrame:
    """keys, best_sum, first, last: the contiguous stretch of largest sum (ties: earliest end, longest)."""
    by = Window.partitionBy(*keys).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = df.withColumn("p", F.sum(gain).over(upto)).withColumn("p0", F.col("p") - F.col(gain))
    # the lowest prefix so far and where it stood first
    p = p.withColumn("low", F.min(F.struct(F.col("p0"), F.col(order).alias("at"))).over(upto))
    p = p.withColumn("s", F.col("p") - F.col("low.p0"))
    best = F.max(F.struct("s", (-F.col(order)).alias("neg"), F.col("low.at").alias("at"))).alias("x")
    return p.groupBy(*keys).agg(best).select(*keys, F.col("x.s").alias("best_sum"), F.col("x.at").alias("first"), (-F.col("x.neg")).alias("last"))


def change_point(df: DataFrame, keys: list[str], order: str, value: str, least: int) -> DataFrame:
    """keys, split_after, sse: the split in two levels with the least squared error; each side has ``least`` rows."""
    by = Window.partitionBy(*keys).orderBy(order)
    upto, whole = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    x, n, n_all = F.col(value), F.count(F.lit(1)).over(upto), F.count(F.lit(1)).over(whole)
    s, q, s_all, q_all = F.sum(x).over(upto), F.sum(x * x).over(upto), F.sum(x).over(whole), F.sum(x * x).over(whole)
    rows = df.select(*keys, order, n.alias("n"), n_all.alias("m"), s.alias("s"), q.alias("q"), s_all.alias("sa"), q_all.alias("qa"))
    rows = rows.filter((F.col("n") >= least) & (F.col("m") - F.col("n") >= least))
    sse = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) + ((F.col("qa") - F.col("q")) - (F.col("sa") - F.col("s")) * (F.col("sa") - F.col("s")) / (F.col("m") - F.col("n")))
    rows = rows.withColumn("sse", F.round(sse, 6))
    return rows.groupBy(*keys).agg(F.min(F.struct("sse", order)).alias("x")).select(*keys, F.col(f"x.{order}").alias("split_after"), F.col("x.sse").alias("sse"))
