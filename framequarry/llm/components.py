"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, look_up, materialise


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of all ids in ``links`` (a, b: bigint, neither null); order does not matter.

    Each round takes the smallest label among a node and its neighbours, then follows labels twice, so paths shrink
    geometrically; every round is written to the shared folder. A node's links are reduced before the shuffle; labels of
    hubs and labels that very many nodes have are looked up in broadcasts of at most 1000 rows. No links give no rows.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct().filter("a <> b"), "links")
    hubs = hot_keys(both, ["b"])
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = look_up(both, labels.select(F.col("id").alias("b"), "label"), ["b"], hubs).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        met = labels.join(near, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        met = materialise(met, "met")
        over = met.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = materialise(look_up(met, over, ["label"]).select("id", F.col("next").alias("label"), "was"), "labels")
        discard(labels, met)
        labels = jumped
        if labels.filter("label <> was").isEmpty():
            discard(both)
            out = labels.select("id", "label")
            out._fq_path = labels._fq_path
            return out


def settle(members: DataFrame, nodes: DataFrame, labels: DataFrame, crowded: list) -> DataFrame:
    """``members`` (row, id, node, ...) with component and kept.

    ``nodes`` (id, doc: smallest identifier of its members, row: first of those without one), ``labels`` of linked nodes.
    The component is the smallest identifier of all; of a component without any, the first row is kept. ``crowded``
    lists the nodes with very many members. A null node stands alone.
    """
    linked = nodes.select("id", "doc", "row").join(labels, "id")
    least = linked.groupBy("label").agg(F.min("doc").alias("component"), F.min("row").alias("least"))
    linked = look_up(materialise(linked.select("id", "label"), "linked"), least, ["label"]).select(F.col("id").alias("node"), "component", "least")
    alone = nodes.join(labels, "id", "left_anti").select(F.col("id").alias("node"), F.col("doc").alias("component"), F.col("row").alias("least"))
    out = look_up(members.filter("node is not null"), linked.union(alone), ["node"], crowded)
    out = out.unionByName(members.filter("node is null").select("*", F.col("id").alias("component"), F.col("row").alias("least")))
    kept = F.when(F.col("id").isNotNull(), F.col("id") == F.col("component")).otherwise(F.col("component").isNull() & (F.col("row") == F.col("least")))
    return out.withColumn("kept", kept).drop("least")
