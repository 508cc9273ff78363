"""Commands: list (methods and segmenters), stabilize FOLDER OUT, segment FOLDER OUT NAME, checksums FOLDER OUT. Settings as name=value."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import plugins, registration
from .sources import bursts, results


def inside(target: str, folder: str) -> bool:
    """Whether ``target`` is ``folder`` or below it."""
    return target.rstrip("/") == folder.rstrip("/") or target.startswith(folder.rstrip("/") + "/")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="framequarry", description=__doc__)
    p.add_argument("command", choices=["list", "stabilize", "segment", "checksums"])
    p.add_argument("paths", nargs="*")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--force", action="store_true", help="do again what is there already")
    a = p.parse_args(argv)
    if a.command == "list":
        for name, params in config.METHODS.items():
            print(f"method {name} {config.fingerprint(params)} {params}")
        for e in plugins.default_registry().listed():
            print(f"segmenter {e.ident} {e.label}")
        return 0
    if len(a.paths) < (3 if a.command == "segment" else 2):
        p.error("paths are missing")
    source, target = a.paths[:2]
    if inside(target, source):
        p.error("results may not be written into the recordings")
    spark = SparkSession.builder.getOrCreate()
    if results.exists(spark, f"{target}/_SUCCESS") and not a.force:
        print("nothing to do")
        return 0
    if a.command == "stabilize":
        params = config.overridden(config.METHODS["translation"], a.set)
        out = registration.stabilize(bursts.frames(spark, source), params.most_rounds, params.tolerance, params.least_ncc, params.height)
    elif a.command == "segment":
        out = plugins.segment(bursts.frames(spark, source), plugins.default_registry(), a.paths[2])
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
        out = raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out.write.mode("overwrite").parquet(target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
