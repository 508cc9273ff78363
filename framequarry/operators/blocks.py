"""The stretch of consecutive frames that agree best with their own mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def best_blocks(frames: DataFrame, k: int, stride: int = 3, write=cut) -> DataFrame:
    """burst, first, score: of the blocks of ``k`` frames that begin at every ``stride``-th one, that with the largest mean correlation of its frames with their mean.

    ``frames``: burst, index (0, 1, ...), v (pixels). The mean of a block is a sum of its frames, so all correlations
    follow from the products of frames less than ``k`` apart: each pair is multiplied once, and blocks are differences
    of sums along each distance. Recordings shorter than ``k`` are one block; the first of equal blocks wins.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = frames.select("burst", "index", "v", (total("v") / F.size("v")).alias("m"))
    z = write(mean.select("burst", "index", F.transform("v", lambda x: x - F.col("m")).alias("z")))
    sd = F.sqrt(total(F.transform("z", lambda x: x * x)) / F.size("z"))
    unit = z.select("burst", "index", "z", sd.alias("sd"))
    apart = unit.select("burst", F.col("index").alias("i"), F.col("z").alias("zi"), F.col("sd").alias("si"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("d"))
    apart = apart.withColumn("index", F.col("i") + F.col("d")).join(unit.withColumnRenamed("z", "zj").withColumnRenamed("sd", "sj"), ["burst", "index"])
    dot = total(F.zip_with("zi", "zj", lambda x, y: x * y)) / F.size("zi")
    # b: product of the frames; a: that over one frame's own spread, from both sides
    per = lambda s: dot / (F.col(s) + 1e-12)
    both = F.when(F.col("d") == 0, 1.0).otherwise(2.0)
    pairs = write(apart.select("burst", "i", "d", (dot * both).alias("b"), F.when(F.col("d") == 0, per("si")).otherwise(per("si") + per("sj")).alias("a")))
    upto = Window.partitionBy("burst", "d").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = write(pairs.select("burst", "i", "d", F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b")))

    n = frames.groupBy("burst").agg(F.count(F.lit(1)).alias("n"))
    starts = n.withColumn("k", F.least("n", F.lit(k))).select("burst", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("k"), F.lit(stride).cast("long"))).alias("first"))
    asked = starts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("d"))
    ends = asked.select("burst", "k", "first", "d", (F.col("first") + F.col("k") - 1 - F.col("d")).alias("i"), F.lit(1).alias("sign")).unionByName(asked.select("burst", "k", "first", "d", (F.col("first") - 1).alias("i"), F.lit(-1).alias("sign")).filter("i >= 0"))
    got = ends.join(sums.withColumn("d", F.col("d").cast("long")), ["burst", "d", "i"]).groupBy("burst", "k", "first").agg(F.sum(F.col("a") * F.col("sign")).alias("a"), F.sum(F.col("b") * F.col("sign")).alias("b"))
    # sum of <z_j, mean> over the frames, by the spread of the mean: both with 1 / k from the mean
    score = (F.col("a") / F.col("k")) / (F.sqrt(F.greatest("b", F.lit(0.0))) / F.col("k") + 1e-12) / F.col("k")
    return got.withColumn("score", score).groupBy("burst").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("first")).alias("neg"))).alias("x")).select("burst", (-F.col("x.neg")).alias("first"), F.col("x.score").alias("score"))
