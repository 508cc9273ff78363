import random

import pytest
from pyspark.sql import functions as F

from framequarry.functions import quantiles
from framequarry.functions.stats import median_mad

WANTED = {"low": ("x", 0.0), "mid": ("x", 0.5), "p90": ("x", 0.9), "high": ("x", 1.0), "mid_y": ("y", 0.5)}


def both(df, keys, small):
    """What narrowing gives, and what ``percentile`` gives."""
    large = quantiles.large_groups(df, keys, small)
    got = quantiles.grouped_quantiles(df, keys, WANTED, large, small)
    clean = df.select(*keys, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("x", "y")])
    want = clean.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in WANTED.items()])
    rows = lambda d: sorted((tuple(str(r[c]) for c in (*keys, *WANTED)) for r in d.collect()))
    return large, rows(got), rows(want)


@pytest.mark.parametrize("small", [1, 20])
def test_quantiles_are_those_of_percentile(spark, small, monkeypatch):
    """Ties, wide ranges, infinite and missing values, one group of half the rows; few buckets make many rounds."""
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rng = random.Random(2)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(3)), lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), lambda: rng.choice([float("inf"), float("-inf"), 0.0, 5.0, 1.7e308, -1.7e308])]
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice(kinds)(), None if rng.random() < 0.2 else rng.choice([float("nan"), rng.expovariate(1)])) for _ in range(400)]
    rows += [(4, None, None)] * 30 + [(5, 1.0, 2.0)] + [(6, 7.5, -0.5)] * 50
    large, got, want = both(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], small)
    assert large is not None and got == want


def test_hot_group_of_events(spark, sf):
    """Half of all events are of one user."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    df = e.select(F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("user_id")).alias("k"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    large, got, want = both(df, ["k"], 100)
    assert [r.k for r in large.collect()] == [-1] and got == want
    assert median_mad(df, ["k"], "x").count() == df.select("k").distinct().count()


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, x double, y double")
    assert quantiles.large_groups(df, ["k"]) is None
    assert quantiles.grouped_quantiles(df, ["k"], WANTED, None).collect() == []
