"""Exact duplicates by content sort.

Sampled splitters deal the rows out by (leading characters, digest, identifier); each piece is sorted externally, so
that equal texts stand side by side, and neighbours are compared in full. Because the identifier is part of the key, a
group of copies of any size spreads over several pieces. Only a text that a splitter falls into can lie in more than
one piece; for those, at most one per splitter, the whole group's size and kept row are counted beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, range_bucket, sortable_id, splitters_of

#: Leading characters in the sort key; longer common beginnings are told apart by the digest.
LEAD = 48


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] | None = None,
    pieces: int | None = None,
    sample_rows: int | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 [, row: all input columns].

    ``normalise`` maps the text column before comparison (default: no change); null counts as empty. ``keep`` is
    "largest" or "smallest" identifier. Exactly one row of each group is kept, also where identical rows repeat; a null
    identifier loses to any other. ``pieces`` (default: the shuffle partitions) and ``sample_rows`` (default: 64 per
    piece) bound what the driver holds: ``sample_rows`` keys of under 400 bytes. Empty input gives no rows. Other
    columns, whatever their names, only travel in ``row``.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = df.sparkSession
    pieces = pieces or partitions(spark)
    sample_rows = sample_rows or 64 * pieces
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    base = df.select(df[id_col].cast("long").alias("i"), text.alias("t"), *([F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")] if carry else []))
    base = base.withColumn("h", F.sha2(F.col("t"), 256))
    key = F.concat(F.substring("t", 1, LEAD), F.col("h"), sortable_id(F.col("i")))

    rows = df.select(F.lit(1)).count()
    share = min(1.0, 1.2 * sample_rows / max(rows, 1))
    sample = [r[0] for r in base.select(key.alias("k"), "i", "t").sample(share, 17).select("k").collect()] if rows and pieces > 1 else []
    splitters = splitters_of(sample, pieces)
    piece = range_bucket(key, splitters)

    # a group that lies in several pieces contains a splitter
    cut = sorted({s[-80:-16] for s in splitters})
    first = F.col("i").desc_nulls_last() if keep == "largest" else F.col("i").asc_nulls_last()
    best = F.max if keep == "largest" else F.min
    of_cut = base.filter(F.col("h").isin(cut)).groupBy("h").agg(F.count(F.lit(1)).alias("cn"), best("i").alias("ck"), F.max(F.when(F.col("i").isNotNull(), piece)).alias("hi"), F.min(F.when(F.col("i").isNotNull(), piece)).alias("lo"), F.max(piece).alias("any"))
    of_cut = of_cut.select(F.col("h").alias("ch"), "cn", "ck", F.coalesce(F.col("hi" if keep == "largest" else "lo"), F.col("any")).alias("cp"))

    placed = base.withColumn("p", piece.cast("int")).repartitionById(pieces, "p")
    run = Window.partitionBy("p", "t")
    runs = placed.select("*", F.row_number().over(run.orderBy(first)).alias("rn"), F.count(F.lit(1)).over(run).alias("n"), best("i").over(run).alias("k"))
    if cut:  # at most two rows a splitter
        runs = runs.join(F.broadcast(of_cut), F.col("h") == F.col("ch"), "left")
    else:
        runs = runs.select("*", F.lit(None).cast("string").alias("ch"), F.lit(None).cast("long").alias("cn"), F.lit(None).cast("long").alias("ck"), F.lit(None).cast("int").alias("cp"))
    whole = F.col("ch").isNull()
    return runs.select(
        F.col("i").alias(id_col),
        F.when(whole, F.col("k")).otherwise(F.col("ck")).alias("keep_id"),
        F.when(whole, F.col("n")).otherwise(F.col("cn")).alias("group_size"),
        ((F.col("rn") == 1) & (whole | (F.col("p") == F.col("cp")))).alias("kept"),
        F.col("h").alias("text_sha256"),
        *(["row"] if carry else []),
    )
