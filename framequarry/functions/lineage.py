"""Cutting lineage between the rounds of a loop, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own only for local masters."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


#: Bytes of a row group: what is read back is split at these, so a file that one task wrote is not one task again.
ROW_GROUP = 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fq-cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
