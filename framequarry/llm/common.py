"""What the training-data operators share: the shared folder, written tables, range look-up in arrays."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage counts it.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than this share of a table's rows is hot, if these are more than so many; parts that rows of a hot
#: key are dealt to where its partner cannot be broadcast.
HOT, LEAST_HOT, SALTS = 1 / 1000, 1000, 32

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and the master is local."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


@contextmanager
def releasing(spark: SparkSession):
    """Shuffle files of what is executed herein go when its execution ends, not when the driver next collects garbage.

    Each execution of a DataFrame plans shuffles of its own, so none that is needed later is lost.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fq-{tag}-{uuid.uuid4().hex}"
    with releasing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fq_path = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_fq_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def hot_keys(df: DataFrame, on: list[str], counts: DataFrame | None = None, total: int | None = None) -> list:
    """Values of ``on`` that hold more than HOT of df's rows: 1 / HOT at most, whatever the size.

    ``counts`` (on, n) saves the counting where it is known already.
    """
    total = df.count() if total is None else total
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    return counts.filter(F.col("n") > max(total * HOT, LEAST_HOT)).select(*on).collect()


def look_up(left: DataFrame, right: DataFrame, on: list[str], hot: list | None = None, how: str = "left", small: bool = True) -> DataFrame:
    """``left`` joined with ``right``, which has one row at most for each value of ``on``; no key of ``on`` is null.

    Rows of hot keys (``hot``, else counted here) do not move: their few rows of ``right`` are broadcast, or, where
    those are not ``small``, dealt out SALTS times.
    """
    hot = hot_keys(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    if len(on) == 1:
        is_hot = F.col(on[0]).isin([r[0] for r in hot])
        few, many, rest = right.filter(is_hot), left.filter(is_hot), left.filter(~is_hot)
    else:
        keys = F.broadcast(left.sparkSession.createDataFrame(hot, right.select(*on).schema))
        few, many, rest = right.join(keys, on, "left_semi"), left.join(keys, on, "left_semi"), left.join(keys, on, "left_anti")
    if small:
        many = many.join(F.broadcast(few), on, how)
    else:
        salt = F.floor(F.rand(7) * SALTS).cast("int")
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        many = many.withColumn("_salt", salt).join(few, [*on, "_salt"], how).drop("_salt")
    return many.unionByName(rest.join(right, on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sortable_id(c: Column) -> Column:
    """A 64-bit integer as 16 hex digits that sort as the integer does; null sorts first, as the smallest integer."""
    return F.coalesce(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("0" * 16))


def range_bucket(key: Column, splitters: list) -> Column:
    """How many of the sorted ``splitters`` are at or below ``key``: two array look-ups of about sqrt(n) entries each."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    count = lambda xs: F.size(F.filter(xs, lambda s: s <= key))
    # heads: the first splitter of each block; a key below the first head is in bucket 0
    block = count(F.array(*[F.lit(b[0]) for b in blocks]))
    table = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + count(F.element_at(table, F.greatest(block, F.lit(1)))))


def splitters_of(sample: list, pieces: int) -> list:
    """At most ``pieces - 1`` distinct splitters, evenly spaced in the sorted sample."""
    sample = sorted(x for x in sample if x is not None)
    if not sample:
        return []
    picked = [sample[min(len(sample) - 1, len(sample) * k // pieces)] for k in range(1, pieces)]
    out: list = []
    for x in picked:
        if bisect_left(out, x) == len(out):
            out.append(x)
    return out
