"""Results on disk: fields and registrations as Parquet, networks as JSON and GraphML, overlays, summaries, records of methods.

Paths are those of Spark's file systems. What is one file of fixed name is written under another name and renamed, so a
reader never sees half of it.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small
from . import schemas


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def put_lines(spark: SparkSession, path: str, lines) -> None:
    """Write one text file line by line, under another name first."""
    where, fs = _file_system(spark, path)
    part, _ = _file_system(spark, f"{path}.part")
    out = spark._jvm.java.io.PrintWriter(spark._jvm.java.io.OutputStreamWriter(fs.create(part, True), "UTF-8"))
    try:
        for line in lines:
            out.write(line + "\n")
    finally:
        out.close()
    fs.delete(where, True)
    if not fs.rename(part, where):
        raise OSError(f"cannot rename {path}.part")


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return bool(fs.exists(where))


def space_left(spark: SparkSession, path: str) -> int:
    """Bytes that the file system of ``path`` has left."""
    _, fs = _file_system(spark, path)
    return int(fs.getStatus().getRemaining())


def enough_space(spark: SparkSession, path: str, needed: int) -> bool:
    """Whether the file system of ``path`` has ``needed`` bytes left."""
    return space_left(spark, path) >= needed


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; where there is none, what ``make`` gives is written first. Unfinished tables do not count."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in columns of numbers and of arrays of numbers."""
    def clean(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return F.when(~F.isnan(c), c).alias(name)
        if kind in ("array<double>", "array<float>"):
            return F.transform(c, lambda x: F.when(~F.isnan(x), x)).alias(name)
        return c

    return df.select(*[clean(n, k) for n, k in df.dtypes])


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes.json and edges.json below ``path``, a record a line; NaN is null and nulls are written."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df = without_nan(df)
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}.json")


def read_network(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the schemas that were written; a record that does not fit fails the read."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}.json")
    return read("nodes", nodes), read("edges", edges)


def graphml(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """value: the lines of a GraphML document between its head and its end, nodes first; other columns become data."""
    def text(c: Column) -> Column:
        c = F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))

    def data(df: DataFrame, keys: list[str]) -> Column:
        return F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<data key="{c}">'), text(F.col(c)), F.lit("</data>")), F.lit("")) for c in df.columns if c not in keys])

    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), text(F.col(node)), F.lit('">'), data(nodes, [node]), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), text(F.col(source)), F.lit('" target="'), text(F.col(target)), F.lit('">'), data(edges, [source, target]), F.lit("</edge>")).alias("value"))
    return n.union(e)


def write_overlay(spark: SparkSession, path: str, record: dict) -> None:
    """One overlay record as JSON, as ``bursts.overlays`` reads it."""
    if record.get("version") != 1 or not record.get("format"):
        raise ValueError("an overlay has a format and version 1")
    put_lines(spark, path, [json.dumps(record, sort_keys=True)])


def staleness(overlay: DataFrame, version: Column, params: Column, source_time: Column) -> DataFrame:
    """overlay with stale: why it no longer fits, or null. Columns: segmenter_version, params_hash, made."""
    why = F.when(F.col("segmenter_version") != version, "version").when(F.col("params_hash") != params, "parameters").when(F.col("made") < source_time, "source")
    return overlay.withColumn("stale", why)


def method_records(spark: SparkSession, root: str, schema: str, pattern: str = "metrics.json") -> DataFrame:
    """burst and the record of each recording's file below ``root``; files that cannot be read as such are left out.

    The recording is the file's folder, by its name or as burst=name.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    record = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select(F.regexp_extract("_metadata.file_path", r"(?:burst=)?([^/=]+)/[^/]+$", 1).alias("burst"), record.alias("r"))
    return rows.filter("r is not null and r._bad is null").select("burst", "r.*").drop("_bad")


def write_summary(df: DataFrame, path: str, title: str) -> None:
    """summary.csv (a folder) and summary.html below ``path``; the page is written row by row, in the frame's order."""
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/summary.csv")
    show = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)

    def page():
        yield f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table>"
        yield "<tr>" + "".join(f"<th>{html.escape(c)}" for c in df.columns)
        for row in df.toLocalIterator():
            yield "<tr>" + "".join(f"<td>{html.escape(show(x))}" for x in row)
        yield "</table>"

    put_lines(df.sparkSession, f"{path}/summary.html", page())


def result_lookup(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """frames with used, dy, dx and why a frame is not used: from a result's rows (burst, index, keep, reason, registered, dy, dx)."""
    t = transforms.select("burst", "index", "keep", F.col("reason").alias("_reason"), "registered", "dy", "dx")
    why = F.when(F.col("registered").isNull(), "not in the result").when(~F.col("keep"), F.col("_reason")).when(~F.col("registered"), "not registered")
    return frames.join(t, ["burst", "index"], "left").withColumn("used", F.coalesce("registered", F.lit(False))).withColumn("why", why).drop("_reason", "keep", "registered")


def stabilized(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """The used frames, moved back by their shifts: what a segmenter gets."""
    import numpy as np
    import pyarrow as pa

    from ..operators.synthetic import shifted

    used = result_lookup(frames, transforms).filter("used").select("burst", "index", "height", "width", "bit_depth", "pixels", "dy", "dx")

    def run(batches):
        for batch in small(batches):
            out = []
            for h, w, bits, raw, dy, dx in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                kind = "<u2" if bits > 8 else np.uint8
                a = shifted(np.frombuffer(raw, kind).reshape(h, w).astype(float), -dy, -dx)
                out.append(np.clip(np.rint(a), 0, (1 << bits) - 1).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(out, pa.binary())], names=["burst", "index", "height", "width", "bit_depth", "pixels"])

    return used.mapInArrow(run, schemas.FRAMES)
