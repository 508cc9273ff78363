"""Release of text tables: parts of files, a manifest with sizes and checksums, and a read-back before it counts.

Every text has a kind (its table), a part and an identifier. A part's sizes and checksum are compared with the manifest
of the release that is there; parts that are new or have changed are written again, the others are left as they are.
What was written is read back and summed up anew; only if it is what the tables hold is the manifest replaced. Parts
that the tables no longer have leave the manifest, which decides what belongs to the release.

    OUT/texts/kind=.../part=...   ident, text, bytes, sha256
    OUT/parts/kind=...            the manifest: texts, copies, bytes, longest, checksum of each part
    OUT/next                      the manifest to be, of this run

A run that is cut short leaves the old manifest, so that the next run writes the same parts again. Null texts count as
empty, parts without a name as "none"; texts that repeat are kept and counted as copies within their part.

    python -m jobs.text_release TABLES OUT [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.operators.integrity import verify

log = logging.getLogger("jobs.text_release")

CONFIG = os.path.join(os.path.dirname(__file__), "text_release.json")
PARTS = "part string, texts long, copies long, bytes long, longest long, checksum string, kind string"
TEXTS = "ident string, text string, bytes long, sha256 string, kind string, part string"
KEY = ["kind", "part"]


def load_config(path: str | None = None) -> dict:
    with open(path or CONFIG) as f:
        return json.load(f)


def texts_of(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    """kind, part, ident, text of all tables of the configuration."""

    def one(t: dict) -> DataFrame:
        df = spark.read.parquet(f"{tables}/{t['kind']}.parquet")
        part = F.coalesce(F.nullif(F.expr(t["part"]).cast("string"), F.lit("")), F.lit("none"))
        return df.select(F.lit(t["kind"]).alias("kind"), part.alias("part"), F.expr(t["ident"]).alias("ident"), F.coalesce(F.expr(t["text"]), F.lit("")).alias("text"))

    return reduce(DataFrame.unionByName, [one(t) for t in config["tables"]])


def checked(texts: DataFrame) -> DataFrame:
    """texts with bytes and sha256."""
    return texts.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("sha256", F.sha2("text", 256))


def manifest(files: DataFrame) -> DataFrame:
    """A row a part of files (kind, part, ident, bytes, sha256). The checksum adds up digests of names and contents, in any order."""
    digit = F.conv(F.substring(F.sha2(F.concat_ws(":", F.coalesce("ident", F.lit("")), "sha256"), 256), 1, 15), 16, 10).cast("decimal(19,0)")
    # first by content: a part of any size is summed up in many tasks
    same = files.groupBy(*KEY, "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("m"), F.sum(digit).cast("decimal(38,0)").alias("d"))
    by = same.groupBy(*KEY).agg(F.sum("n").alias("texts"), F.sum(F.col("n") - 1).alias("copies"), F.sum("b").alias("bytes"), F.max("m").alias("longest"), F.sum("d").cast("string").alias("checksum"))
    return by.select("part", "texts", "copies", "bytes", "longest", "checksum", "kind")


def problems_text(rows: list, n: int) -> str:
    first = "; ".join(f"{r.file.kind}/{r.file.part}: {r.problem}" for r in rows)
    return first + (f"; and {n - len(rows)} more" if n > len(rows) else "")


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Bring the release in ``out`` up to date with ``tables``; its manifest."""
    config = load_config() if config is None else config
    texts = texts_of(spark, tables, config)
    manifest(checked(texts)).write.mode("overwrite").parquet(f"{out}/next")
    after = spark.read.schema(PARTS).parquet(f"{out}/next")
    total = after.agg(F.count(F.lit(1)), F.sum("texts"), F.sum("bytes")).first()
    log.info("read %d texts, %d bytes from %s", total[1] or 0, total[2] or 0, tables)

    spark.createDataFrame([], PARTS).write.mode("append").partitionBy("kind").parquet(f"{out}/parts")
    before = spark.read.schema(PARTS).parquet(f"{out}/parts")
    told = F.struct("texts", "bytes", "checksum")
    both = after.select(*KEY, told.alias("new")).join(before.select(*KEY, told.alias("old")), KEY, "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed").otherwise("current")
    states = both.select(*KEY, state.alias("state"))
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    log.info("parts: %s", ", ".join(f"{counts[k]} {k}" for k in sorted(counts)) or "none")

    # parts of one text and parts of a third of all texts are written in files of like size
    todo = states.filter("state in ('new', 'changed')").select(*KEY)
    files = checked(texts).join(todo, KEY, "left_semi").select("ident", "text", "bytes", "sha256", *KEY)
    if counts.get("new") or counts.get("changed"):
        files.hint("rebalance", *KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(f"{out}/texts")
        log.info("wrote %d texts to %s/texts", after.join(todo, KEY, "left_semi").agg(F.sum("texts")).first()[0], out)

    there = spark.createDataFrame([], TEXTS) if not counts else spark.read.schema(TEXTS).parquet(f"{out}/texts")
    ask = after.select(*KEY) if config["verify_all"] else todo
    back = manifest(checked(there.join(ask, KEY, "left_semi").select(*KEY, "ident", "text")))
    named = lambda m: m.select(F.struct(*KEY).alias("file"), "bytes", F.col("checksum").alias("sha256"))
    wrong = verify(named(after.join(ask, KEY, "left_semi")), named(back), "file")
    first = wrong.orderBy("file").limit(5).collect()
    if first:
        raise RuntimeError(f"the release is not what the tables hold: {problems_text(first, wrong.count())}")

    after.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/parts")
    log.info("read back %s parts, wrote %d parts to %s/parts", "all" if config["verify_all"] else "the written", total[0], out)
    return spark.read.schema(PARTS).parquet(f"{out}/parts")


def released(spark: SparkSession, out: str) -> DataFrame:
    """The texts of a release: those of the parts in its manifest."""
    parts = spark.read.schema(PARTS).parquet(f"{out}/parts")
    return spark.read.schema(TEXTS).parquet(f"{out}/texts").join(parts.select(*KEY), KEY, "left_semi")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.text_release", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("--config")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_release").getOrCreate()
    try:
        run(spark, a.tables, a.out, load_config(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
