"""Quality gate of frames: unusual within their recording and physically different."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import medians_mads, robust_z


@dataclass(frozen=True)
class GateParams:
    """The gate's defaults."""

    sharpness_min_z: float = -4.0
    sharpness_min_ratio: float = 0.6
    brightness_max_abs_z: float = 5.0
    brightness_max_rel_change: float = 0.25


def gate(df: DataFrame, key: str, log_sharpness: str, brightness: str, params: GateParams | None = None) -> DataFrame:
    """df with sharpness_z, brightness_z, keep, reason.

    A frame goes only if its z score and its ratio to the recording's median are both beyond their limits; null values
    are no reason to reject.
    """
    p = params or GateParams()
    pairs = {"sharpness": log_sharpness, "brightness": brightness}
    stats = medians_mads(df, [key], list(pairs.values()))
    df = df.join(stats.select(key, *[F.col(f"{c}_{s}").alias(f"{name}_{s}") for name, c in pairs.items() for s in ("med", "mad")]), key)
    for name, column in pairs.items():
        df = df.withColumn(f"{name}_z", robust_z(F.col(column), F.col(f"{name}_med"), F.col(f"{name}_mad")))
    ratio = F.exp(F.col(log_sharpness) - F.col("sharpness_med"))
    change = F.abs(F.col(brightness) / F.greatest(F.col("brightness_med"), F.lit(1e-9)) - 1)
    blurred = F.coalesce((F.col("sharpness_z") < p.sharpness_min_z) & (ratio < p.sharpness_min_ratio), F.lit(False))
    lighting = F.coalesce((F.abs("brightness_z") > p.brightness_max_abs_z) & (change > p.brightness_max_rel_change), F.lit(False))
    reason = F.concat_ws("+", F.when(blurred, F.lit("blink/blur")), F.when(lighting, F.lit("brightness")))
    return df.withColumn("keep", ~(blurred | lighting)).withColumn("reason", reason).drop("sharpness_med", "sharpness_mad", "brightness_med", "brightness_mad")


def rejected_counts(gated: DataFrame, key: str) -> DataFrame:
    """key, reason, n of rejected frames."""
    return gated.filter("not keep").groupBy(key, "reason").agg(F.count(F.lit(1)).alias("n"))
