"""A Merkle manifest of a table: one leaf a row, one tree a group, one root over all groups.

Leaves are numbered within their group; ``fanout ** levels`` consecutive ones are a superblock, which one Python call
reduces by ``levels`` levels. The roots of the superblocks are reduced in the same way until one node a group is left,
and the groups' nodes likewise until one root is left. On the way back each superblock's own part of a proof (lower) is
followed by the part of its root (upper). Only digests and identifiers are shuffled, and no task sees more than one
superblock at a time, whatever a group's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The fields that a document's leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that repeat in full are expanded in runs of so many.
RUN = 1 << 16

_NODES = "g string, index long, n long, item long, node string, probe string"
_PATHS = "g string, index long, item long, node string, probe string, lefts array<string>, rights array<string>, subroot string, root string"


def digest_of(*fields: Column) -> Column:
    """sha256 in hex of the fields one after another, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_levels(nodes: list[str], n: int, fanout: int, levels: int) -> Iterator[list[str]]:
    """The nodes of a superblock in a group of ``n`` nodes, level by level, up to its root: ``levels`` steps, or those to one node if the group ends before."""
    yield nodes
    for _ in range(levels):
        if n <= 1:
            return
        n = -(-n // fanout)
        nodes = [_hash("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        yield nodes


def paths(nodes: list[str], n: int, fanout: int, levels: int) -> tuple[list[list[str]], list[list[str]]]:
    """Of each node, level by level, what stands to its left and to its right in its run."""
    rows = list(tree_levels(nodes, n, fanout, levels))[:-1]
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    for k, row in enumerate(rows):
        left = ["".join(row[j // fanout * fanout : j]) for j in range(len(row))]
        right = ["".join(row[j + 1 : j // fanout * fanout + fanout]) for j in range(len(row))]
        for i in range(len(nodes)):
            lefts[i].append(left[i // fanout**k])
            rights[i].append(right[i // fanout**k])
    return lefts, rights


def _numbered(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """g, index, n, item, node, probe: places 0, 1, ... within g in the order of ``by``, nulls first. rows: g, item, node, probe, copies.

    Pieces by range, places within a piece by a window, pieces in front by a sum over pieces: no group is one task.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    placed = rows.repartitionByRange("g", *order).withColumn("piece", F.spark_partition_id())
    placed = materialise(placed, tag)
    sizes = placed.groupBy("g", "piece").agg(F.sum("copies").alias("size"))
    pieces = Window.partitionBy("g")
    before = F.sum("size").over(pieces.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    sizes = sizes.select("g", "piece", before.alias("before"), F.sum("size").over(pieces).alias("n"))
    within = Window.partitionBy("g", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum("copies").over(within) - F.col("copies")
    out = placed.withColumn("first", first).join(sizes, ["g", "piece"]).withColumn("first", F.col("first") + F.col("before"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN)))
    out = out.select("g", "n", "item", "node", "probe", "first", "copies", runs.alias("run"))
    one = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1))
    return out.select("g", "n", "item", "node", "probe", "first", one.alias("copy")).select("g", (F.col("first") + F.col("copy")).alias("index"), "n", "item", "node", "probe")


def _climb(leaves: DataFrame, fanout: int, levels: int, tag: str) -> list[DataFrame]:
    """Tables of nodes: the leaves, the roots of their superblocks, and so on, up to one node a group."""
    size = fanout**levels

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        n, at = int(pdf["n"].iloc[0]), int(pdf["index"].iloc[0]) // size
        root = list(tree_levels(pdf["node"].tolist(), n, fanout, levels))[-1]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "index": [at], "n": [-(-n // size)], "item": pd.array([None], "Int64"), "node": root, "probe": [None]})

    out = [materialise(leaves, tag)]
    while True:
        block = F.floor(F.col("index") / size)
        out.append(materialise(out[-1].groupBy("g", block.alias("block")).applyInPandas(collapse, _NODES), tag))
        if (out[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return out


def _descend(tables: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The paths of the first table's nodes; ``top`` has the paths of the last one's."""
    size = fanout**levels

    def prove(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        lower = lower.sort_values("index")
        up = upper.iloc[0]
        nodes = lower["node"].tolist()
        lefts, rights = paths(nodes, int(lower["n"].iloc[0]), fanout, levels)
        above, behind = list(up["lefts"]), list(up["rights"])
        return pd.DataFrame({"g": lower["g"], "index": lower["index"], "item": lower["item"].astype("Int64"), "node": lower["node"], "probe": lower["probe"], "lefts": [x + above for x in lefts], "rights": [x + behind for x in rights], "subroot": up["subroot"], "root": up["root"]})

    for nodes in reversed(tables[:-1]):
        lower = nodes.withColumn("block", F.floor(F.col("index") / size)).groupBy("g", "block")
        upper = top.withColumn("block", F.col("index")).groupBy("g", "block")
        top = lower.cogroup(upper).applyInPandas(prove, _PATHS)
    return top


def merkle_manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = 8, levels: int = 3, tampered: Column | None = None) -> DataFrame:
    """One row per input row: id, leaf, probe, proof (array of left, right), subroot, root.

    The leaf is ``digest_of`` the fields; ``probe`` is the digest ``tampered`` or null. A group's leaves ascend by
    identifier; groups ascend by value as UTF-8 bytes, a null one first. A run of ``fanout`` nodes, or what is left of
    them, becomes the digest of their hex texts; a group of one row has its leaf as subroot, a table of one group its
    subroot as root. ``proof`` has the siblings of the leaf and of the nodes above it, up to the root.

    A null identifier sorts first, rows of one identifier by leaf, and a null field counts as ``-``, which an empty
    text does not. Rows that repeat in full are leaves of their own, with equal digests; they are counted before they
    are shuffled. No rows give no rows. Other columns are not read, whatever their names.
    """
    group = df[group_col].cast("string")
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),
        df[id_col].cast("long").alias("item"),
        digest_of(*[df[f] for f in fields]).alias("node"),
        (F.lit(None) if tampered is None else tampered).cast("string").alias("probe"),
    )
    rows = materialise(rows.groupBy("g", "item", "node", "probe").agg(F.count(F.lit(1)).alias("copies")), "leaves")
    tables = _climb(_numbered(rows, ["item", "node"], "placed"), fanout, levels, "nodes")

    # the groups' roots are the leaves of one more tree, in which a group's place is that of its name
    names = tables[-1].select(F.lit("").alias("g"), F.lit(None).cast("long").alias("item"), "node", F.col("g").alias("probe"), F.lit(1).cast("long").alias("copies"))
    over = _numbered(names, ["probe"], "names")
    upper = _climb(over, fanout, levels, "groups")
    nothing = F.array().cast("array<string>")
    last = upper[-1].select("g", "index", "item", "node", "probe", nothing.alias("lefts"), nothing.alias("rights"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    named = _descend(upper, last, fanout, levels)
    top = named.select(F.col("probe").alias("g"), F.lit(0).cast("long").alias("index"), "item", "node", F.lit(None).cast("string").alias("probe"), "lefts", "rights", F.col("node").alias("subroot"), "root")
    out = _descend(tables, top, fanout, levels)
    proof = F.zip_with("lefts", "rights", lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return out.select(F.col("item").alias(id_col), F.col("node").alias("leaf"), "probe", proof.alias("proof"), "subroot", "root")


def siblings_digest(proof: Column) -> Column:
    """sha256 in hex of all siblings of a proof, in its order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
