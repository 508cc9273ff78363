"""Windows over ordered series: running means, bins, split halves, lags, kymographs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centred_mean(df: DataFrame, keys: list[str], order: str, value: str, each_side: int) -> DataFrame:
    """Rows with a whole window only, with running_mean over each_side rows before and after."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(-each_side, each_side)
    rows = df.withColumn("running_mean", F.avg(value).over(by)).withColumn("rows_in", F.count(F.lit(1)).over(by))
    return rows.filter(F.col("rows_in") == 2 * each_side + 1).drop("rows_in")


def edge_shifted_mean(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """running_mean over ``width`` rows whose window is shifted, not cut, at both ends."""
    whole = Window.partitionBy(*keys)
    by, half = whole.orderBy(order), width // 2
    here = by.rowsBetween(-half, width - 1 - half)
    rows = df.withColumn("pos", F.row_number().over(by) - 1).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("own", F.avg(value).over(here))
    # the first and the last whole window stand for the rows before and after them
    rows = rows.withColumn("first", F.max(F.when(F.col("pos") == half, F.col("own"))).over(whole)).withColumn("last", F.max(F.when(F.col("pos") == F.col("n") - width + half, F.col("own"))).over(whole)).withColumn("all", F.avg(value).over(whole))
    mean = F.when(F.col("n") <= width, F.col("all")).when(F.col("pos") < half, F.col("first")).when(F.col("pos") > F.col("n") - width + half, F.col("last")).otherwise(F.col("own"))
    return rows.withColumn("running_mean", mean).drop("pos", "n", "own", "first", "last", "all")


def bins_of_k(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """keys, bin, mean of each k consecutive rows; an incomplete last bin is dropped."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = df.withColumn("bin", F.floor(pos / k))
    return rows.groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")


def split_half(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, var_all, var_even, var_odd (sample variances) by position."""
    rows = df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    half = lambda r: F.var_samp(F.when(F.col("pos") % 2 == r, F.col(value)))
    return rows.groupBy(*keys).agg(F.var_samp(value).alias("var_all"), half(0).alias("var_even"), half(1).alias("var_odd"))


def double_centred(df: DataFrame, key: str, t: str, s: str, k: str) -> DataFrame:
    """df with centred: less the mean of its row and of its column, plus the mean of all; null cells stay null."""
    mean = lambda *by: F.avg(k).over(Window.partitionBy(*by))
    return df.withColumn("centred", F.col(k) - mean(key, t) - mean(key, s) + mean(key))


def lag_correlation(df: DataFrame, key: str, t: str, s: str, k: str, lags: list[int]) -> DataFrame:
    """key, lag, corr, pairs: correlation of each place's value with its own ``lag`` rows later."""
    by = Window.partitionBy(key, s).orderBy(t)
    parts = F.array(*[F.struct(F.lit(n).alias("lag"), F.lead(k, n).over(by).alias("later")) for n in lags])
    rows = df.withColumn("x", parts).select(key, k, F.explode("x").alias("x")).filter(F.col("x.later").isNotNull() & F.col(k).isNotNull())
    return rows.groupBy(key, F.col("x.lag").alias("lag")).agg(F.corr(k, "x.later").alias("corr"), F.count(F.lit(1)).alias("pairs"))


def interpolated(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with filled: null values blended linearly from the known ones before and after, by ``order``; ends are held."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("at"), F.col(value).alias("v")))
    by = Window.partitionBy(*keys).orderBy(order)
    a = F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = F.first(known, ignorenulls=True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("_a", a).withColumn("_b", b)
    span = F.col("_b.at") - F.col("_a.at")
    blend = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.at")) / span
    filled: Column = F.when(span > 0, blend).otherwise(F.coalesce("_a.v", "_b.v"))
    return df.withColumn("filled", filled).drop("_a", "_b")
