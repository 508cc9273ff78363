"""Places in one order over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def ranked(df: DataFrame, order: list[Column], name: str, write=cut) -> DataFrame:
    """df with ``name``: places from 1 in the order of ``order``, which must tell all rows apart.

    Rows are dealt to ranges of the order and written with their range; each range counts its own rows and begins where
    those before it end. One row a range is broadcast.
    """
    parts = write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")
