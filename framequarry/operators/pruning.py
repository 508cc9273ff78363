"""Edges of a map pruned to a fix point: only what a removal touches is scored again.

A map says of every pixel the sum of what its edges put there. An edge's gain is how much worse the squares of the
residual get without it. Edges that gain less than their price go, all of a round together; that changes the residual
of their pixels, and with it the gains of the edges that share these pixels, and of no others.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

log = logging.getLogger(__name__)


def _gains(cover: DataFrame, residual: DataFrame) -> DataFrame:
    """edge, gain, pixels: the sum of (r + c)^2 - r^2 over an edge's pixels."""
    rows = cover.join(residual, "pixel")
    return rows.groupBy("edge").agg(F.sum(2 * F.col("r") * F.col("c") + F.col("c") * F.col("c")).alias("gain"), F.count(F.lit(1)).alias("pixels"))


def pruned(cover: DataFrame, data: DataFrame, edges: DataFrame, most: int = 1000, write=cut, summed: bool = False) -> tuple[DataFrame, list[int]]:
    """(edge, gain, pixels, removed_in) of all edges, and how many rows of ``cover`` each round read for scoring.

    ``cover``: edge, pixel, c; ``data``: pixel, d; ``edges``: edge, price, protected. An edge goes if its gain is below
    its price, a protected one only if it gains nothing; ``removed_in`` is the round, from 1, and null for those that
    stay. Gains are the last ones before an edge went, or those at the end. Edges without pixels gain nothing. Raises if
    ``most`` rounds do not end it. Of a ``cover`` that is ``summed``, with one row for each edge and pixel and written
    already, no pair is looked for again.
    """
    if not summed:
        cover = write(cover.groupBy("edge", "pixel").agg(F.sum("c").alias("c")))
    model = cover.groupBy("pixel").agg(F.sum("c").alias("m"))
    residual = write(data.join(model, "pixel").select("pixel", (F.col("d") - F.col("m")).alias("r")))
    price = write(edges.select("edge", "price", F.coalesce("protected", F.lit(False)).alias("protected")))
    zero = F.lit(0.0)
    gains = price.join(_gains(cover, residual), "edge", "left").select("edge", F.coalesce("gain", zero).alias("gain"), F.coalesce("pixels", F.lit(0)).alias("pixels"))
    gains, gone, touched = write(gains), None, [cover.count()]
    for k in range(1, most + 1):
        low = F.when(F.col("protected"), F.col("gain") <= 0).otherwise(F.col("gain") < F.col("price"))
        out = write(gains.join(price, "edge").filter(low).select("edge", "gain", "pixels", F.lit(k).alias("removed_in")))
        gone = out if gone is None else gone.unionByName(out)
        if out.isEmpty():
            log.info("pruning: %d rounds, rows scored %s", k - 1, touched)
            return gone.unionByName(gains.withColumn("removed_in", F.lit(None).cast("int"))), touched
        mine = cover.join(out.select("edge"), "edge", "left_semi")
        freed = write(mine.groupBy("pixel").agg(F.sum("c").alias("m")))
        cover = cover.join(out.select("edge"), "edge", "left_anti")
        changed = residual.join(freed, "pixel").select("pixel", (F.col("r") + F.col("m")).alias("r"))
        residual = write(residual.join(freed.select("pixel"), "pixel", "left_anti").unionByName(changed))
        near = write(cover.join(freed.select("pixel"), "pixel", "left_semi").select("edge").distinct())
        again = cover.join(near, "edge", "left_semi")
        scored = write(_gains(again, residual))
        touched.append(scored.agg(F.sum("pixels")).first()[0] or 0)
        left = gains.join(out.select("edge"), "edge", "left_anti").join(near, "edge", "left_anti")
        gains = write(left.unionByName(scored.select("edge", "gain", "pixels")))
        if k % 8 == 0:
            cover, gone = write(cover), write(gone)
    raise ArithmeticError(f"not pruned in {most} rounds")
