"""Queries by name, each with SQL on views named like the tables, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a recording (the user), with the clock in microseconds and in seconds."""
    df = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return df.withColumn("us", us).withColumn("seconds", F.col("us") / 1e6)


#: The same in SQL: e has us and s (seconds).
EVENTS = "e as (select *, epoch_us(ts) as us, epoch_us(ts) / 1e6 as s from events)"


def r6(c: Column | str) -> Column:
    """Rounded to 6 digits, negative zero as zero: sums of doubles depend on their order."""
    return F.round(c, 6) + F.lit(0.0)
