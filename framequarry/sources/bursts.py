"""Recordings on disk: folders burst_* with frame_*.tif, frames.csv and manifest.json; and the sinks that write them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import small
from ..functions.lineage import cut
from . import schemas, tiff

#: Frames per second where a manifest says nothing.
DEFAULT_FPS = 30.0
BURST = r"(burst_[^/]+)/[^/]+$"


def _burst(path: str = "path") -> Column:
    return F.regexp_extract(path, BURST, 1)


#: Files in a batch of names, bytes of contents in a batch and in a task.
NAMES, PIECE, SHARE = 4096, 32 << 20, 64 << 20


def _opened(root: str):
    """The file system of a root and the folder in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root if ":" in root else f"file://{root}")


def _begins(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """What paths begin with outside of the root's file system, and its folder; None where tasks cannot list it: only Spark reads it, or it is a pattern."""
    from pyarrow.fs import FileType

    local = (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    if set("*?[]{}") & set(root) or not (":" in root or local):
        return None
    try:
        store, top = _opened(root)
        if store.get_file_info(top).type != FileType.Directory:
            return None
    except (OSError, ValueError):
        return None
    top, uri = top.rstrip("/"), (root if ":" in root else f"file://{root}").rstrip("/")
    return (uri[: -len(top)], top) if top and uri.endswith(top) else None


def _dealt(df: DataFrame, parts: int = 0) -> DataFrame:
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("path"))


def _listed(spark: SparkSession, root: str, top: str, pattern: str, write) -> DataFrame:
    """path, length, modificationTime of the files below ``top``; a folder is listed by a task, a level of folders after the other."""

    def children(batches):
        from fnmatch import fnmatchcase

        from pyarrow.fs import FileSelector, FileType

        store, _ = _opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = []
                for x in store.get_file_info(FileSelector(folder)):
                    name, inner = x.base_name, x.type == FileType.Directory
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                    if not hidden and (inner or fnmatchcase(name, pattern)):
                        found.append((x.path, inner, x.size or 0, (x.mtime_ns or 0) // 1_000_000 * 1000))  # Spark has milliseconds
                for at in range(0, len(found), NAMES):
                    rows = found[at : at + NAMES]
                    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "folder", "length", "modificationTime"])

    folders, out = spark.createDataFrame([(top,)], "path string"), None
    while True:
        found = write(_dealt(folders).mapInArrow(children, "path string, folder boolean, length long, modificationTime timestamp"))
        files = found.filter("not folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        folders = found.filter("folder").select("path")
        if folders.isEmpty():
            return out


def binary(spark: SparkSession, root: str, pattern: str, content: bool = True, write=cut) -> DataFrame:
    """path, modificationTime, length (and content) of the files below ``root`` whose names match, as Spark's binaryFile gives them.

    That reader keeps the names of all files in the driver, of a recording one for each frame; here tasks list folders and
    open files. Where tasks cannot reach ``root``, Spark's reader is left.
    """
    where = _begins(spark, root)
    if where is None:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        return raw if content else raw.drop("content")
    begin, top = where
    names = _listed(spark, root, top, pattern, write)
    whole = F.concat(F.lit(begin), "path").alias("path")
    if not content:
        return names.select(whole, "modificationTime", "length")

    def read(batches):
        store, _ = _opened(root)

        def piece(rows, data):
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], names=["path", "modificationTime", "length", "content"])

        for batch in small(batches):
            at, size, data = 0, 0, []
            for k, (path, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if data and size + length > PIECE:
                    yield piece(batch.slice(at, k - at), data)
                    at, size, data = k, 0, []
                with store.open_input_file(path) as f:
                    data.append(f.read())
                size += length
            if data:
                yield piece(batch.slice(at, len(data)), data)

    total = names.agg(F.sum("length")).first()[0] or 0
    raw = _dealt(names, total // SHARE).select("path", "modificationTime", "length").mapInArrow(read, "path string, modificationTime timestamp, length long, content binary")
    return raw.select(whole, "modificationTime", "length", "content")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """burst, filename, path, bytes, modified of all frames below root; contents are not read."""
    files = binary(spark, root, "frame_*.tif", content=False)
    return files.select(_burst().alias("burst"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).filter("burst <> ''")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """burst and the manifest's record, with fps and bit depth by the chain of fall-backs."""
    raw = binary(spark, root, "manifest.json").filter("length > 0")
    m = raw.select(_burst().alias("burst"), F.from_json(F.col("content").cast("string"), schemas.MANIFEST).alias("m")).select("burst", "m.*")
    fps = F.coalesce(F.when(F.col("capture.effective_fps") > 0, F.col("capture.effective_fps")), F.when(F.col("acquisition_requested.requested_fps") > 0, F.col("acquisition_requested.requested_fps")), F.lit(DEFAULT_FPS))
    bits = F.coalesce("pixel_values.bit_depth", "acquisition_requested.bit_depth", F.when(F.col("pixel_values.dtype") == "uint8", 8).otherwise(12))
    return m.withColumn("fps", fps).withColumn("bit_depth", bits)


def frames_meta(spark: SparkSession, root: str) -> DataFrame:
    """burst and the columns of frames.csv by their names in each file's header; what a file lacks or leaves empty is null.

    Recordings of different cameras have different columns, which a CSV reader with one schema cannot take. Fields hold
    no quotes or commas.
    """
    text = binary(spark, root, "frames.csv").select("path", F.col("content").cast("string").alias("value"))
    lines = text.select(_burst().alias("burst"), F.split("value", r"\r?\n").alias("lines"))
    head = lines.select("burst", F.split(F.element_at("lines", 1), ",").alias("head"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).filter("line <> ''")
    fields = F.slice(F.concat(F.split("line", ",", -1), F.array_repeat(F.lit(""), F.size("head"))), F.lit(1), F.size("head"))
    rows = head.select("burst", F.map_from_arrays("head", fields).alias("m"))
    columns = [c.strip().rsplit(" ", 1) for c in schemas.FRAMES_META.split(",")]
    value = lambda name: F.try_element_at("m", F.lit(name))
    return rows.select("burst", *[F.when(value(n.strip("`")) != "", value(n.strip("`"))).cast(kind).alias(n.strip("`")) for n, kind in columns])


def frame_times(files: DataFrame, meta: DataFrame, bursts: DataFrame) -> DataFrame:
    """burst, index, filename, time_s: the camera's clock from the first frame where every file has a stamp, else index / fps."""
    w = Window.partitionBy("burst")
    rows = files.select("burst", "filename").withColumn("index", F.row_number().over(w.orderBy("filename")) - 1)
    rows = rows.join(meta.select("burst", "filename", "camera_timestamp_ns"), ["burst", "filename"], "left").join(bursts.select("burst", "fps"), "burst", "left")
    whole = F.bool_and(F.col("camera_timestamp_ns").isNotNull()).over(w)
    stamp = (F.col("camera_timestamp_ns") - F.min("camera_timestamp_ns").over(w)) / 1e9
    return rows.select("burst", "index", "filename", F.when(whole, stamp).otherwise(F.col("index") / F.coalesce("fps", F.lit(DEFAULT_FPS))).alias("time_s"))


def frames(spark: SparkSession, root: str) -> DataFrame:
    """schemas.FRAMES: the pixels of every frame, little-endian; files that cannot be decoded have null pixels."""
    raw = binary(spark, root, "frame_*.tif")
    number = F.regexp_extract("path", r"frame_(\d+)\.tif$", 1).cast("int")

    def run(batches):
        for batch in small(batches):
            out = []
            for content in batch.column(2).to_pylist():
                try:
                    a = tiff.decode(content)
                    out.append((a.shape[0], a.shape[1], a.dtype.itemsize * 8, a.astype("<u2").tobytes() if a.dtype == np.uint16 else a.tobytes()))
                except (ValueError, KeyError, IndexError):
                    out.append((None, None, None, None))
            kinds = [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([o[k] for o in out], kinds[k]) for k in range(4)]], names=["burst", "index", "height", "width", "bit_depth", "pixels"])

    return raw.select(_burst().alias("burst"), number.alias("index"), "content").mapInArrow(run, schemas.FRAMES)


def write_frames(df: DataFrame, root: str) -> DataFrame:
    """Write schemas.FRAMES as TIFF files below root (a folder that all executors share, local or remote); burst, index, path, bytes written.

    Files appear under their names only when they are whole.
    """

    def run(batches):
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(root if ":" in root else f"file://{root}")
        made = set()
        for batch in small(batches):
            out = []
            for burst, index, h, w, bits, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{top.rstrip('/')}/{burst}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                path = f"{folder}/frame_{index:06d}.tif"
                data = tiff.encode(np.frombuffer(raw, "<u2" if bits > 8 else np.uint8).reshape(h, w))
                part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, path)
                out.append((burst, index, path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["burst", "index", "path", "bytes"])

    return df.select("burst", "index", "height", "width", "bit_depth", "pixels").mapInArrow(run, "burst string, `index` int, path string, bytes long")


def has_image_data(frames_: DataFrame) -> DataFrame:
    """burst, has_data: whether any frame has a pixel over 0."""
    blank = F.regexp_replace(F.hex("pixels"), "0", "") == ""
    return frames_.groupBy("burst").agg(F.max(F.coalesce(~blank, F.lit(False))).alias("has_data"))


def write_transforms(df: DataFrame, path: str) -> None:
    """transforms.csv with fixed numbers of digits."""
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double")).alias(c)
    numbers = {k for k, t in df.dtypes if t in ("double", "float")}
    flags = {k for k, t in df.dtypes if t == "boolean"}
    df.select(*[four(c) if c in numbers else F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in df.columns]).write.option("header", "true").csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """metrics.json: one record a recording."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def release_files(spark: SparkSession, path: str) -> DataFrame:
    """burst, path, bytes, sha256 of a release manifest."""
    m = spark.read.schema(schemas.RELEASE).option("multiLine", "true").json(path)
    return m.select(F.explode("bursts").alias("b")).select("b.burst", F.explode("b.files").alias("f")).select("burst", "f.*")


def overlays(spark: SparkSession, path: str) -> DataFrame:
    """Overlay records; an unknown format or version fails the read."""
    o = spark.read.schema(schemas.OVERLAY).option("multiLine", "true").json(path)
    known = F.when((F.col("version") == 1), F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unknown overlay version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))).cast("int"))
    return o.withColumn("version", known)
