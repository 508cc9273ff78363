"""Manifests against what is there, duplicates, precedence, currency of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verify(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, problem of two tables (key, bytes, sha256): missing, unexpected, size or hash; rows in order are left out."""
    m = manifest.select(F.col(key), F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"), F.lit(True).alias("wanted"))
    f = found.select(F.col(key), F.col("bytes").alias("got_bytes"), F.col("sha256").alias("got_sha"), F.lit(True).alias("there"))
    problem = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("want_bytes") != F.col("got_bytes"), "size")
        .when(F.col("want_sha") != F.col("got_sha"), "hash")
    )
    return m.join(f, key, "full_outer").select(key, problem.alias("problem")).filter("problem is not null")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_wins(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def stale(sources: DataFrame, results: DataFrame, key: str, version: str, params_hash: str) -> DataFrame:
    """Sources without a result that is ok, of this version and these parameters, and newer than the source."""
    r = results.filter((F.col("status") == "ok") & (F.col("version") == version) & (F.col("params_hash") == params_hash)).select(F.col(key).alias("_k"), F.col("mtime").alias("_m"))
    return sources.join(r, (sources[key] == r["_k"]) & (r["_m"] >= sources["mtime"]), "left_anti")


def safe_member(path: Column, folder: Column) -> Column:
    """Whether a path is relative, below ``folder`` and without '.' or '..' parts."""
    parts = F.split(path, "/")
    plain = F.forall(parts, lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.coalesce(plain & (F.element_at(parts, 1) == folder) & (F.size(parts) > 1) & ~path.contains("\\"), F.lit(False))
