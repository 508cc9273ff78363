"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source size copies. Those expectations are summed up along the source, one
random offset is added, and a document is emitted once for every integer that its stretch of the sum crosses. Documents
are ordered by size, so that a source's taken words stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, partitions

#: Documents of a source are numbered in bands of size (eight to each doubling) and in parts of a band of about so many.
ROWS_PER_PART = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], total: float, most: float) -> DataFrame:
    """source, n (size), target: ``total`` x all sizes, shared by ``weights`` in the sources' order, capped at ``most`` x size.

    The excess of full sources is shared again by weight until none is above its cap; each round is one aggregate. Sources
    are ranked by ranges, so there may be very many.
    """
    spark = sizes.sparkSession
    ranges = sizes.withColumn("last", F.col("source").isNull()).repartitionByRange(partitions(spark), "last", "source")
    ranges = materialise(ranges.withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("m")).select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranges.join(F.broadcast(starts), "range").select("source", "n", weight.alias("w"), (F.col("n") * F.lit(float(most))).alias("cap"))
    ranked = materialise(ranked, "ranked")
    discard(ranges)
    # a source is full if the level among the open ones reaches its cap for its weight
    level, full = 0.0, F.lit(False)
    while True:
        got = ranked.agg(F.sum("n").alias("n"), F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if not got.open or not got.n:
            break
        rest = (float(got.n) * total - (got.full or 0.0)) / got.open
        if rest <= level:
            break
        level, full = rest, F.col("w") * F.lit(rest) >= F.col("cap")
    return ranked.select("source", "n", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.least("cap", F.col("w") * F.lit(level))).alias("target"))


def mix(
    df: DataFrame,
    weights: list[float],
    total: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken [, row: all input columns].

    Sizes are words; a null text has none. Sources are ordered by code point, null last, and weigh ``weights``,
    repeating. No document is taken more than ``ceil(most)`` times. Sources of size 0 and empty texts take nothing.
    The same rows and seed give the same copies; rows that repeat count as documents of their own, also those without
    identifier. Texts are counted whole, however long. Other columns, whatever their names, only travel in ``row``.
    Empty input gives no rows.
    """
    base = df.select(df[id_col].cast("long").alias("i"), df[source_col].cast("string").alias("source"), word_count(df[text_col].cast("string")).alias("size"), *([F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")] if carry else []))
    slim = materialise(base.drop("row"), "mix")
    sums = slim.groupBy("source").agg(F.sum("size").alias("n"))
    targets = source_targets(sums, weights, total, most)
    band = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8)).otherwise(-1).cast("int")
    crowd = slim.groupBy("source", band).count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 + crowd // ROWS_PER_PART * 4)).cast("int")
    keys = ["source", "band", "part"]
    counts = slim.groupBy("source", band.alias("band"), part.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy("source").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("m").over(run), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts.source.eqNullSafe(targets.source)).select(starts.source.alias("s2"), F.col("band").alias("b2"), F.col("part").alias("p2"), "start", "n", "target")
    numbered = (base if carry else slim).select("*", band.alias("band"), part.alias("part"))
    numbered = numbered.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("size", "i")))
    rows = numbered.join(starts, numbered.source.eqNullSafe(starts.s2) & (numbered.band == starts.b2) & (numbered.part == starts.p2))
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    named = F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), F.lit(str(seed))))
    offset = F.conv(F.substring(named, 1, 8), 16, 10).cast("double") / float(1 << 32)
    upto = lambda k: F.floor(k * rate + offset)
    place = F.col("start") + F.col("at")
    copies = F.when(F.col("size") > 0, upto(place) - upto(place - 1)).otherwise(0)
    return rows.select(F.col("i").alias(id_col), "size", numbered.source.alias(source_col), F.col("n").alias("source_size"), "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if carry else []))
