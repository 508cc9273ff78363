"""Agreement of aligned pictures, pixel by pixel, in long form (frame, pixel, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixels(df: DataFrame, key: str, frame: str, array: str) -> DataFrame:
    """key, frame, pix, v: one row a pixel."""
    return df.select(key, frame, F.posexplode(array).alias("pix", "v")).withColumn("v", F.col("v").cast("double"))


def projections(px: DataFrame, key: str, least_share: float = 0.5) -> DataFrame:
    """key, pix, mean, sd, n: null where fewer than ``least_share`` of the frames have the pixel."""
    frames = px.groupBy(key).agg(F.count_distinct("frame").alias("frames"))
    by = px.groupBy(key, "pix").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n")).join(frames, key)
    seen = F.col("n") >= F.col("frames") * least_share
    return by.select(key, "pix", F.when(seen, F.col("mean")).alias("mean"), F.when(seen, F.col("sd")).alias("sd"), "n")


def mask_overlap(px: DataFrame, key: str) -> DataFrame:
    """key, overlap: of all pairs of frames that show a masked pixel in the first, the share that has it in both.

    ``px`` has key, pix, m (boolean; null: not observed).
    """
    by = px.groupBy(key, "pix").agg(F.count_if("m").alias("k"), F.count("m").alias("n"))
    return by.groupBy(key).agg((F.sum(F.col("k") * (F.col("k") - 1)) / F.nullif(F.sum(F.col("k") * (F.col("n") - 1)), F.lit(0))).alias("overlap"))


def dice(px: DataFrame, key: str, frame: str) -> DataFrame:
    """key, dice: mean over frames of the overlap with the majority mask of all frames."""
    major = px.groupBy(key, "pix").agg((F.count_if("m") * 2 > F.count("m")).alias("major"))
    rows = px.join(major, [key, "pix"]).filter("m is not null")
    one = rows.groupBy(key, frame).agg((2 * F.count_if(F.col("m") & F.col("major")) / F.nullif(F.count_if("m") + F.count_if("major"), F.lit(0))).alias("d"))
    return one.groupBy(key).agg(F.avg("d").alias("dice"))
