"""Exact quantiles of groups of any size.

Spark's exact ``percentile`` holds all distinct values of a group in one buffer. Groups of more than SMALL rows are
therefore narrowed down first: a round counts the values of each group's interval in BUCKETS buckets, with their least
and largest value, and keeps the bucket that holds the wanted rank. Partial counts are summed where the rows are, so a
group of half of all rows costs as many rows to shuffle as it has buckets. The values are those of ``percentile``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Groups up to this size are left to ``percentile``: its buffer then has some megabytes at most.
SMALL = 100_000
BUCKETS = 4096
#: So many wanted ranks are broadcast (under 20 MB); more are joined by a shuffle.
MOST_BROADCAST = 100_000


def large_groups(df: DataFrame, keys: list[str], small: int = SMALL) -> DataFrame | None:
    """keys of groups with more than ``small`` rows; None if there are none."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).select(*keys)
    return None if large.isEmpty() else cut(large)


def grouped_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], large: DataFrame | None, small: int = SMALL, write=cut) -> DataFrame:
    """keys and, by name, the quantile of a column: {name: (column, q)}, interpolated between neighbours; null without values.

    ``large`` comes from ``large_groups`` of the same rows. NULL and NaN are no values. Keys that are null make no group.
    """
    columns = sorted({c for c, _ in wanted.values()})
    clean = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]).dropna(subset=keys)
    plain = [F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in wanted.items()]
    if large is None:
        return clean.groupBy(*keys).agg(*plain)
    few = clean.join(large, keys, "left_anti").groupBy(*keys).agg(*plain)
    return few.unionByName(_of_large(clean.join(large, keys, "left_semi"), keys, wanted, columns, small, write))


def _of_large(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], columns: list[str], small: int, write) -> DataFrame:
    inf = float("inf")
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")).select(*keys, "x.*").filter("v is not null")
    every = df.select(*keys).distinct()
    by = [*keys, "c"]
    ends = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("of"), F.lit(float(q)).alias("q")) for name, (c, q) in wanted.items()])
    goals = ends.select("*", F.explode(asked).alias("w")).filter("w.of = c").withColumn("pos", F.col("w.q") * (F.col("n") - 1))
    goals = write(goals.select(*by, "w.name", "pos", "n", "lo", "hi"))
    ranks = goals.select(*by, F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank"), "n", "lo", "hi").distinct()
    state = write(ranks.select(*by, "rank", F.lit(0).cast("long").alias("below"), "n", "lo", "hi"))

    def inside(s: DataFrame) -> DataFrame:
        s = F.broadcast(s) if s.count() <= MOST_BROADCAST else s
        return long.join(s, by).filter("v between lo and hi")

    ready = None
    while True:
        enough = (F.col("n") <= small) | (F.col("lo") == F.col("hi"))
        now = state.filter(enough)
        ready = now if ready is None else ready.unionByName(now)
        state = state.filter(~enough)
        if state.isEmpty():
            break
        # rising with v, whatever is lost in rounding; halves, so that no difference overflows; infinite values stand apart
        lo, hi = F.greatest("lo", F.lit(-1.7976931348623157e308)), F.least("hi", F.lit(1.7976931348623157e308))
        share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
        bucket = F.when(F.col("v") == -inf, -1).when(F.col("v") == inf, BUCKETS).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).cast("int")
        counts = inside(state).groupBy(*by, "rank", "below", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("before", F.col("below") + upto - F.col("n"))
        held = counts.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        state = write(held.select(*by, "rank", F.col("before").alias("below"), "n", "lo", "hi"))
    ready = write(ready)
    same = ready.filter("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
    left = inside(ready.filter("lo < hi").select(*by, "rank", "below", "lo", "hi"))
    place = F.row_number().over(Window.partitionBy(*by, "rank").orderBy("v")) - 1
    found = left.withColumn("place", place).filter(F.col("place") == F.col("rank") - F.col("below")).select(*by, "rank", F.col("v").alias("value"))
    values = write(same.unionByName(found))
    at = lambda r, name: values.select(*by, F.col("rank").alias(r), F.col("value").alias(name))
    goals = goals.withColumn("r0", F.floor("pos")).withColumn("r1", F.ceil("pos")).join(at("r0", "v0"), [*by, "r0"]).join(at("r1", "v1"), [*by, "r1"])
    value = F.when((F.col("r0") == F.col("r1")) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise((F.col("r1") - F.col("pos")) * F.col("v0") + (F.col("pos") - F.col("r0")) * F.col("v1"))
    out = goals.select(*keys, "name", value.alias("value")).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])
    return every.join(out, keys, "left")
