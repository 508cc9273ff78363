"""Shards of near equal size by histogram sort.

Rows are ordered by (hash of the text, identifier). The bytes below candidate boundaries are counted exactly, over all
partitions, in rounds: each round splits the interval that holds a target into equal probes and keeps the probe that
the target falls into, until a boundary is within the tolerance. Only then do rows move, once. A boundary stays between
groups of equal texts where the tolerance allows it; a group too large for that is cut by identifier, so no hot text
can unbalance the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, range_bucket, sortable_id

#: Probes in an interval and round; the driver gets this many counts for each boundary still open.
FANOUT = 512
#: Rows that one task orders when it numbers the slots of a shard.
ROWS_PER_PART = 500_000


def text_key(text: Column) -> Column:
    """62 bits of the text's hash, not negative; null hashes as itself."""
    return F.shiftrightunsigned(F.xxhash64(text), 2)


def shard_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _refine(slim: DataFrame, targets: list[int], slack: float) -> list[str]:
    """For each target the key below which the weights sum up to it: hash and identifier as sortable hex.

    ``slim`` has k (62 bits), i (identifier, never null) and w (weight).
    """
    found: dict[int, str] = {}
    code = lambda k, i=None: f"{k ^ (1 << 63):016X}" + ("" if i is None else f"{(i + (1 << 63)):016X}")
    todo = dict.fromkeys(range(len(targets)), (0, (1 << 62) - 1, 0))  # hash interval, weight below it
    inside: dict[int, tuple[int, int, int, int]] = {}  # within one hash: hash, identifier interval, weight below it
    while todo or inside:
        spans = sorted({v[:2] for v in todo.values()})
        deep = sorted({v[:3] for v in inside.values()})
        span, probe, hit = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
        for n, (lo, hi) in enumerate(spans):
            here = F.col("k").between(lo, hi)
            span, hit = F.when(here, F.lit(n)).otherwise(span), hit | here
            probe = F.when(here, F.expr(f"(k - {lo}L) div {(hi - lo) // FANOUT + 1}L")).otherwise(probe)
        for n, (k, lo, hi) in enumerate(deep):
            here = (F.col("k") == k) & F.col("i").between(lo, hi)
            span, hit = F.when(here, F.lit(len(spans) + n)).otherwise(span), hit | here
            # the whole range of identifiers has more than 63 bits; halves tell wide intervals apart
            at = f"(i - {lo}L) div {(hi - lo) // FANOUT + 1}L" if hi - lo < 1 << 62 else f"(shiftright(i, 1) - {lo >> 1}L) div {((hi >> 1) - (lo >> 1)) // FANOUT + 1}L"
            probe = F.when(here, F.expr(at)).otherwise(probe)
        got = slim.filter(hit).groupBy(span.alias("s"), probe.alias("p")).agg(F.sum("w").alias("w"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("i").alias("i0"), F.max("i").alias("i1")).collect()
        bins: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r.s, r.p)):
            bins.setdefault(r.s, []).append(r)

        def crossing(rows: list, below: int, target: int):
            for r in rows:
                if below + r.w > target:
                    return r, below
                below += r.w
            return rows[-1], below - rows[-1].w

        new_inside: dict[int, tuple[int, int, int, int]] = {}
        for t, (lo, hi, below) in list(todo.items()):
            r, below = crossing(bins[spans.index((lo, hi))], below, targets[t])
            before, after = targets[t] - below, below + r.w - targets[t]
            if min(before, after) <= slack:
                found[t] = code(r.k0) if before <= after else code(r.k1 + 1)
                del todo[t]
            elif r.k0 < r.k1:
                todo[t] = (r.k0, r.k1, below)
            else:
                del todo[t]
                new_inside[t] = (r.k0, r.i0, r.i1, below)
        for t, (k, lo, hi, below) in inside.items():
            r, below = crossing(bins[len(spans) + deep.index((k, lo, hi))], below, targets[t])
            before, after = targets[t] - below, below + r.w - targets[t]
            if r.i0 == r.i1 or min(before, after) == 0:  # rows of one hash and identifier stay together
                found[t] = code(k, r.i0) if before <= after else (code(k, r.i1 + 1) if r.i1 < (1 << 63) - 1 else code(k + 1))
            else:
                new_inside[t] = (k, r.i0, r.i1, below)
        inside = new_inside
    return [found[t] for t in range(len(targets))]


def histogram_shards(
    df: DataFrame,
    shards: int = 24,
    law: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.0005,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard [, row: all input columns].

    law "bytes": each boundary lies within ``tolerance`` of a shard's share, or else (texts of that size) at the nearest
    row; law "rows": counts at most one apart where identifiers are unique; law "key": the identifier and the number of
    shards decide, by highest random weight, and ``grown_shard`` is the shard with one more, else null. Size is the
    text's UTF-8 bytes (null: none) plus 8. Slots count from 0 without gaps. Null identifiers order first, like the
    smallest integer; rows of equal text and identifier share a shard. Empty input gives no rows.
    """
    if law not in ("bytes", "rows", "key"):
        raise ValueError("law is 'bytes', 'rows' or 'key'")
    ident, text = df[id_col].cast("long"), df[text_col].cast("string")
    base = df.select(ident.alias("i0"), F.coalesce(ident, F.lit(-(1 << 63))).alias("i"), text_key(text).alias("k"), shard_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), *([F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")] if carry else []))
    slim = materialise(base.drop("row"), "shard")
    rows, total = slim.agg(F.count(F.lit(1)), F.sum("size" if law == "bytes" else F.lit(1))).first()
    total = int(total or 0)
    grown = F.lit(None).cast("int")
    if law == "key":
        pick = lambda n: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(F.xxhash64(F.col("i0"), s).alias("h"), s.alias("s"))))["s"]
        shard, grown = pick(shards), pick(shards + 1)
    elif not rows:
        shard = F.lit(0)
    else:
        weighed = slim.select("k", "i", (F.col("size") if law == "bytes" else F.lit(1).cast("long")).alias("w"))
        cuts = _refine(weighed, [total * n // shards for n in range(1, shards)], tolerance * total / shards if law == "bytes" else 0)
        shard = range_bucket(F.concat(sortable_id(F.col("k")), sortable_id(F.col("i"))), cuts)

    parts = max(1, -(-int(rows) // (shards * ROWS_PER_PART)))
    part = F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int")
    counts = slim.groupBy(shard.cast("int").alias("shard"), part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = (base if carry else slim).select("*", shard.cast("int").alias("shard"), part.alias("part"), grown.cast("int").alias("grown_shard"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("k", "i", "crc", "size"))
    return placed.withColumn("at", at).join(starts, ["shard", "part"]).select(F.col("i0").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"), "grown_shard", *(["row"] if carry else []))


def write_shards(df: DataFrame, path: str, files: int | None = None, **options) -> None:
    """Write the input rows as Parquet, one folder a shard, in slot order over the files of a shard in their names' order.

    Rows move to ``files`` ranges of (shard, slot) (default: the shuffle partitions), so a shard is not one task. Input
    columns travel as fields of ``row``, whatever their names.
    """
    out = histogram_shards(df, carry=True, **options).select("shard", "slot", "row")
    files = files or partitions(df.sparkSession)
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
