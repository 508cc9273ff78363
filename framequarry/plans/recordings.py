"""Queries over recordings on disk, and over results that are written and read back.

Recordings are made of a table's vectors, with the motion that stands in them, and written to the shared folder as TIFF
files, tables and manifests, so the sources read what a camera would leave. Tables that go through a sink
and a reader must come back as they were, which SQL on the table says.
"""

from __future__ import annotations

import json
import uuid
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small
from ..functions.lineage import cut, shared_folder
from ..functions.text import exact_sum, printed
from ..operators import plugins, ranks, registration, synthetic
from ..operators import pictures as P
from ..sources import bursts, results
from .pictures import PX, pictures
from .registry import events, query, r6, table
from .table_frames import numbers, patterns, recorded, turning


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/fq-{name}-{uuid.uuid4().hex}"


def _recordings(spark, sf_dir) -> tuple[str, DataFrame]:
    """The recordings of a table as files, and one more of black frames; where they are, and their truth."""
    root = _folder(spark, "recordings")
    drawn = cut(recorded(spark, sf_dir))
    black = spark.range(0, 6, 1, 2).select(F.lit("burst_zblack").alias("burst"), F.col("id").cast("int").alias("index"), F.lit(16).alias("height"), F.lit(24).alias("width"), F.lit(12).alias("bit_depth"), F.to_binary(F.repeat(F.lit("00"), 768), F.lit("hex")).alias("pixels"))
    written = bursts.write_frames(drawn.select(*black.columns).union(black), root)
    files = cut(written.select("burst", "index", "bytes"))
    for row in files.groupBy("burst").agg(F.max("index").alias("last")).collect():  # a row a recording
        stamps = row.burst != "burst_01"  # one has no camera clock, so its times come from the manifest
        head = "index,filename,camera_timestamp_ns" if stamps else "index,filename"
        line = lambda k, stamps=stamps: f"{k},frame_{k:06d}.tif" + (f",{5_000_000_000 + k * 31_250_000}" if stamps else "")
        n = row["last"] + 1
        pieces = ("\n".join(map(line, range(k, min(k + 1024, n)))) for k in range(0, n, 1024))  # many lines a call, never all of them
        results.put_lines(spark, f"{root}/{row.burst}/frames.csv", chain([head], pieces))
        manifest = {"acquisition_requested": {"pixel_format": "Mono12", "requested_fps": 32.0}, "capture": {"effective_fps": 32.0 if row.burst != "burst_02" else None}, "pixel_values": {"bit_depth": 12, "dtype": "uint16"}}
        results.put_lines(spark, f"{root}/{row.burst}/manifest.json", [json.dumps(manifest)])
    return root, drawn


@query()
def recorded_bursts(spark, sf_dir):
    """Every recording found: frames, bytes, its rate by the chain of fall-backs, times, and whether it has any light."""
    root, _ = _recordings(spark, sf_dir)
    files = bursts.discover(spark, root)
    times = bursts.frame_times(files, bursts.frames_meta(spark, root), bursts.manifests(spark, root))
    data = bursts.has_image_data(bursts.frames(spark, root))
    size = files.groupBy("burst").agg(F.count(F.lit(1)).alias("frames"), F.sum("bytes").alias("bytes"))
    span = times.groupBy("burst").agg(F.round(F.max("time_s"), 6).alias("seconds"))
    m = bursts.manifests(spark, root).select("burst", "fps", "bit_depth")
    out = size.join(span, "burst").join(m, "burst").join(data, "burst")
    return ranks.ranked(out, [F.col("burst")], "place")


_PLACED = "f as (select 'burst_' || lpad(label::varchar, 2, '0') as burst, cast(row_number() over (partition by label order by vec_id) - 1 as int) as index, embedding[3] > 0.28 as blink from embeddings)"


@query(f"with {_PLACED} select burst, index, 64 as height, 96 as width, true as same from f")
def decoded_frames(spark, sf_dir):
    """Frames read from TIFF files against what was drawn: size, range, and the same pixels."""
    root, drawn = _recordings(spark, sf_dir)
    got = bursts.frames(spark, root).select("burst", "index", "height", "width", F.xxhash64("pixels").alias("h"))
    want = drawn.select("burst", "index", F.xxhash64("pixels").alias("w"))
    return got.join(want, ["burst", "index"]).select("burst", "index", "height", "width", (F.col("h") == F.col("w")).alias("same"))


@query()
def file_checksums(spark, sf_dir):
    """Size and digest of every file of every recording, against the digest of what was written."""
    root, drawn = _recordings(spark, sf_dir)
    raw = bursts.binary(spark, root, "frame_*.tif")
    got = raw.select(F.regexp_extract("path", bursts.BURST, 1).alias("burst"), F.regexp_extract("path", r"frame_(\d+)", 1).cast("int").alias("index"), "length", F.sha2("content", 256).alias("sha256"))
    again = bursts.write_frames(drawn.select("burst", "index", "height", "width", "bit_depth", "pixels"), _folder(spark, "copy"))
    state = F.when(F.col("bytes").isNull(), "unexpected").when(F.col("bytes") != F.col("length"), "size").otherwise("verified")
    return got.join(again.select("burst", "index", "bytes"), ["burst", "index"], "left").select("burst", "index", "length", "sha256", state.alias("state"))


@query()
def stabilized_recordings(spark, sf_dir):
    """From files to transforms: discovery, times, scores, gate, groupwise registration; with the error against the known motion."""
    root, drawn = _recordings(spark, sf_dir)
    frames = bursts.frames(spark, root).filter("burst <> 'burst_zblack'")
    t = cut(registration.stabilize(frames))
    times = bursts.frame_times(bursts.discover(spark, root), bursts.frames_meta(spark, root), bursts.manifests(spark, root))
    path = _folder(spark, "transforms")
    bursts.write_transforms(t.join(times.select("burst", "index", "filename", "time_s"), ["burst", "index"]).select("burst", "index", "filename", "time_s", "dx", "dy", "response", "ncc", "keep", "reason", "registered"), path)
    back = spark.read.option("header", "true").schema("burst string, `index` int, filename string, time_s double, dx double, dy double, response double, ncc double, keep int, reason string, registered int").csv(path)
    j = back.join(drawn.select("burst", "index", "true_dy", "true_dx", "blink"), ["burst", "index"]).withColumn("ey", F.col("dy") - F.col("true_dy")).withColumn("ex", F.col("dx") - F.col("true_dx"))
    mid = j.groupBy("burst").agg(F.median("ey").alias("my"), F.median("ex").alias("mx"))
    error = F.hypot(F.col("ey") - F.col("my"), F.col("ex") - F.col("mx"))
    return j.join(mid, "burst").select("burst", "index", "time_s", (F.col("keep") == 1).alias("keep"), "reason", (F.col("registered") == 1).alias("registered"), F.round("dy", 2).alias("dy"), F.round("dx", 2).alias("dx"), "blink", F.round(error, 3).alias("error"))


@query(f"with {_PLACED} select burst, index, blink, not blink as keep, not blink as registered, case when not blink then true end as recovered from f")
def recovered_motion(spark, sf_dir):
    """Whether the motion that stands in the table is found to a tenth of a pixel, and blinks and nothing else are left out."""
    t = stabilized_recordings(spark, sf_dir)
    return t.select("burst", "index", "blink", "keep", "registered", F.when(F.col("registered"), F.col("error") < 0.1).alias("recovered"))


def _warped_overlap(frames: DataFrame, shift: DataFrame) -> DataFrame:
    """burst, overlap of dark masks of all frames, moved back by a method's shifts (burst, index, dy, dx)."""
    import pyarrow as pa

    rows = frames.join(shift, ["burst", "index"]).select("burst", "height", "width", "bit_depth", "pixels", F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx"))

    def run(batches):
        for batch in batches:
            sums: dict = {}
            for piece in small([batch]):
                for burst, h, w, bits, raw, dy, dx in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    a = synthetic.shifted(np.frombuffer(raw, "<u2").reshape(h, w) / float((1 << bits) - 1), -(dy or 0), -(dx or 0))
                    m = (a < np.median(a) - 0.6 * a.std())[10:-10, 10:-10].astype(np.int64)
                    n, total = sums.get(burst, (0, 0))
                    sums[burst] = (n + 1, total + m)
            out = [(b, n, t.astype("<i8").tobytes()) for b, (n, t) in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["burst", "n", "total"])

    def merge(table):
        n = sum(table.column("n").to_pylist())
        k = sum(np.frombuffer(x, "<i8") for x in table.column("total").to_pylist())
        share = float((k * (k - 1)).sum() / max((k * (n - 1)).sum(), 1))
        return pa.table({"burst": pa.array([table.column("burst")[0].as_py()]), "overlap": pa.array([share])})

    return rows.mapInArrow(run, "burst string, n long, total binary").groupBy("burst").applyInArrow(merge, "burst string, overlap double")


@query()
def warp_methods(spark, sf_dir):
    """Overlap of all frames under three methods that are scored alike: none, registered, and the true motion as ceiling."""
    frames = cut(recorded(spark, sf_dir).filter("not blink"))
    still = frames.select("burst", "index", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    found = registration.stabilize(frames).select("burst", "index", "dy", "dx").filter("dy is not null")
    truth = frames.select("burst", "index", F.col("true_dy").alias("dy"), F.col("true_dx").alias("dx"))
    methods = {"none": still, "registered": found, "ceiling": truth}
    out = None
    for name, shift in methods.items():
        one = _warped_overlap(frames, shift).select("burst", F.lit(name).alias("method"), F.round("overlap", 4).alias("overlap"))
        out = one if out is None else out.union(one)
    return out


@query()
def stabilized_for_segmenter(spark, sf_dir):
    """Used frames moved back, as a segmenter gets them, and what one plug-in makes of them."""
    frames = cut(recorded(spark, sf_dir))
    t = cut(registration.stabilize(frames))
    used = results.stabilized(frames, t)
    return plugins.segment(used, plugins.default_registry(), "dark").select("burst", "index", "segmenter", "area")


@query()
def frame_lookup(spark, sf_dir):
    """Every frame with its shift, or why it has none."""
    frames = cut(recorded(spark, sf_dir))
    t = cut(registration.stabilize(frames))
    frames = frames.drop("pixels")
    return results.result_lookup(frames, t).select("burst", "index", "used", "why", F.round("dy", 2).alias("dy"), F.round("dx", 2).alias("dx"))


@query("select l_partkey as u, l_suppkey as v, count(*) as n, round(avg(l_extendedprice), 4) as flow, case when count(*) > 1 then round(stddev_samp(l_quantity), 6) end as spread from lineitem group by 1, 2")
def network_round_trip(spark, sf_dir):
    """A network written as JSON, NaN as null, and read back."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("flow"), F.round(F.coalesce(F.stddev_samp("l_quantity"), F.lit(float("nan"))), 6).alias("spread"))
    path = _folder(spark, "network")
    results.write_network(e.select(F.col("u").alias("node")).distinct(), e, path)
    return results.read_network(spark, path, "node bigint", "u bigint, v bigint, n bigint, flow double, spread double")[1]


@query("""select '<edge source="' || o_custkey || '" target="' || o_orderkey || '"><data key="status">' || o_orderstatus || '</data><data key="priority">' || replace(o_orderpriority, '&', '&amp;') || '</data></edge>' as value from orders""")
def network_graphml(spark, sf_dir):
    """Edges as GraphML elements."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return results.graphml(o.select(F.col("u").alias("node")).distinct(), o, "node", "u", "v").filter("part = 1").select("value")


@query("select user_id, event_id, round(value, 6) as dy, case when event_type <> 'error' then round(value / 3, 6) end as dx from events")
def fields_round_trip(spark, sf_dir):
    """Displacement fields and registrations as arrays in Parquet, written once, read later."""
    e = events(spark, sf_dir).select("user_id", "event_id", F.round("value", 6).alias("dy"), F.when(F.col("event_type") != "error", F.round(F.col("value") / 3, 6)).alias("dx"))
    path = _folder(spark, "fields")
    make = lambda: e.withColumn("part", F.floor(F.col("event_id") / 64)).groupBy("user_id", "part").agg(F.collect_list(F.struct("event_id", "dy", "dx")).alias("field"))
    results.once(spark, path, make)
    again = results.once(spark, path, lambda: e.limit(0))  # what is there is not made again
    return again.select("user_id", F.explode("field").alias("f")).select("user_id", "f.*")


@query("select cast(user_id as varchar) as burst, count(*) as frames, round(avg(value), 3) as score from events where user_id % 7 <> 3 group by 1")
def method_summary(spark, sf_dir):
    """metrics.json of each recording, unreadable ones left out, and the summary that is written from them."""
    root = _folder(spark, "metrics")
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("value"), 3).alias("score"))
    good = F.to_json(F.struct(F.struct("frames", "score").alias("quality"), F.lit("ok").alias("status")))
    text = F.when(F.col("user_id") % 7 == 3, F.lit("{broken")).otherwise(good)
    one = rows.select(F.col("user_id").alias("burst"), text.alias("value")).repartition("burst")
    one.write.partitionBy("burst").text(root)  # one file a recording
    found = cut(results.method_records(spark, root, "quality struct<frames: bigint, score: double>, status string", "part-*").select("burst", "quality.frames", "quality.score"))
    results.write_summary(found.orderBy(F.desc("score"), "burst"), f"{root}/summary", "Recordings")
    return spark.read.option("header", "true").schema("burst string, frames bigint, score double").csv(f"{root}/summary/summary.csv")


@query("""select cast(user_id as varchar) as id, case when user_id % 5 = 0 then 'version' when user_id % 5 = 1 then 'parameters' when user_id % 5 = 2 then 'source' end as stale from (select distinct user_id from events)""")
def overlay_staleness(spark, sf_dir):
    """Overlays written and read with their format checked, and why one no longer fits its source."""
    users = events(spark, sf_dir).select("user_id").distinct()
    u = F.col("user_id") % 5
    made = users.select(F.col("user_id").cast("string").alias("id"), F.when(u == 0, "old").otherwise("v1").alias("segmenter_version"), F.when(u == 1, "00").otherwise("ab").alias("params_hash"), F.when(u == 2, F.lit(1)).otherwise(F.lit(9)).alias("made"), F.lit(1).alias("version"))
    path = _folder(spark, "overlays")
    made.select(F.to_json(F.struct(*made.columns)).alias("value")).write.text(path)
    read = spark.read.schema("id string, segmenter_version string, params_hash string, made int, version int").option("mode", "FAILFAST").json(path)
    return results.staleness(read.filter("version = 1"), F.lit("v1"), F.lit("ab"), F.lit(5)).select("id", "stale")


@query("""with k as (select doc_id, sha256(coalesce(lang, '') || '|' || cast(n_chars as varchar) || '|v2') as key from documents) select doc_id, key, doc_id % 3 = 0 as cached from k""")
def content_keyed_cache(spark, sf_dir):
    """Steps keyed by what they depend on; only those without a result are to do."""
    key = F.sha2(F.concat_ws("|", F.coalesce("lang", F.lit("")), F.col("n_chars").cast("string"), F.lit("v2")), 256)
    k = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    have = cut(k.filter("doc_id % 3 = 0").select("doc_id", F.col("key").alias("have")))
    return k.join(have, "doc_id", "left").select("doc_id", "key", F.coalesce(F.col("have") == F.col("key"), F.lit(False)).alias("cached"))


@query("""select o_custkey, 'burst_' || o_custkey || '  ' || lpad(cast(count(*) as varchar), 5, ' ') || ' frames  ' || lpad(printf('%.1f', sum(o_totalprice) / 1000), 10, ' ') || ' kB' as line from orders group by 1""")
def release_notes(spark, sf_dir):
    """Lines of a release's table in fixed columns."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("o_totalprice")).alias("s"))
    line = F.concat(F.lit("burst_"), F.col("o_custkey").cast("string"), F.lit("  "), F.lpad(F.col("n").cast("string"), 5, " "), F.lit(" frames  "), F.lpad(printed(F.col("s") / 1000, 1), 10, " "), F.lit(" kB"))
    return g.select("o_custkey", line.alias("line"))


@query("""with b as (select *, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events) select event_id, 'frame ' || k || ' / ' || n as title, strftime(ts, '%Y-%m-%d %H:%M:%S') as taken, printf('%.2f', value) || ' ms' as exposure from b""")
def burst_review(spark, sf_dir):
    """Rows that a reviewer reads: place, time and exposure as text (A10, H8)."""
    w = Window.partitionBy("user_id")
    b = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    title = F.concat(F.lit("frame "), F.col("k").cast("string"), F.lit(" / "), F.col("n").cast("string"))
    return b.select("event_id", title.alias("title"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("taken"), F.concat(printed(F.col("value"), 2), F.lit(" ms")).alias("exposure"))


@query(f"with {PX}, m as (select vec_id, avg(v) filter (v > -1) as m from px group by 1) select vec_id, count(*) filter (v > -1) as valid, round(sum(case when v > -1 then v else m end), 6) + 0.0 as total from px join m using (vec_id) group by 1")
def reference_image(spark, sf_dir):
    """A reference picture with gaps filled by its mean, and which pixels are valid."""
    some = F.filter("v", lambda x: x > -1)
    mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)
    p = pictures(spark, sf_dir).withColumn("m", mean)
    filled = F.transform("v", lambda x: F.when(x > -1, x).otherwise(F.col("m")))
    return p.select(F.col("id").alias("vec_id"), F.size(some).cast("long").alias("valid"), r6(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"with {PX}, m as (select vec_id, median(v) - 0.8 * stddev_pop(v) as t from px group by 1) select vec_id, 'dark' as segmenter, count(*) filter (v < t) as area from px join m using (vec_id) group by 1")
def segmented_pictures(spark, sf_dir):
    """A plug-in's contract: a picture in, a mask out, checked for its shape."""

    def work(a):
        mask = a < np.median(a, axis=(1, 2), keepdims=True) - 0.8 * a.std(axis=(1, 2), keepdims=True)
        if mask.shape != a.shape or mask.dtype != bool:
            raise ValueError("a segmenter gives a mask of the picture's shape")
        return {"area": mask.sum(axis=(1, 2))}

    return P.run(pictures(spark, sf_dir), work, "area long").select(F.col("id").alias("vec_id"), F.lit("dark").alias("segmenter"), "area")


@query(f"""with {PX}, m as (select vec_id, median(v) as med, avg(v) as mean, stddev_pop(v) as sd from px group by 1)
 select 'dark' as ident, 'Dark pixels' as label, cast(0 as bigint) as folder, count(*) filter (v < med - 0.8 * sd) as area from px join m using (vec_id)
 union all select 'mine', 'Above zero', 1, count(*) filter (v > 0) from px union all select 'bright', 'Bright pixels', 0, count(*) filter (v > mean + sd) from px join m using (vec_id)""")
def segmenter_listing(spark, sf_dir):
    """The registry, by label, where the first folder wins, and what each segmenter marks on all pictures."""
    registry = plugins.Registry()
    registry.add(plugins.Entry("mine", "Above zero", lambda a: a > 0, folder_rank=1))
    registry.add(plugins.Entry("dark", "Other dark pixels", lambda a: a > 0, folder_rank=1))
    registry.add(plugins.Entry("dark", "Dark pixels", lambda a: a < np.median(a) - 0.8 * a.std()))
    registry.add(plugins.Entry("bright", "Bright pixels", lambda a: a > a.mean() + a.std()))
    registry.add(plugins.Entry("bright", "Other bright pixels", lambda a: a < 0, folder_rank=1))
    listed = registry.listed()
    work = lambda stack: {e.ident: np.array([e.run(a).sum() for a in stack]) for e in listed}
    areas = P.run(pictures(spark, sf_dir), work, ", ".join(f"{e.ident} long" for e in listed))
    entry = lambda e: F.struct(F.lit(e.ident).alias("ident"), F.lit(e.label).alias("label"), F.lit(e.folder_rank).cast("long").alias("folder"), F.coalesce(F.sum(e.ident), F.lit(0)).alias("area"))
    return areas.agg(F.array(*[entry(e) for e in listed]).alias("x")).select(F.inline("x"))


@query()
def vessel_scenes(spark, sf_dir):
    """A scene of branching vessels for each block of vectors, whose numbers decide their ways: how many paths, their length, how dark, and how much of them a ridge filter finds."""
    import pyarrow as pa

    def task(batches):
        for batch in small(batches):
            rows = []
            for i, _, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, paths = synthetic.vessel_tree(numbers(e))
                strength = P.ridges(a[None], ((1.5, 6), (3.0, 12)), np.array([0.02]))[0]
                on = [strength[int(y), int(x)] > 0.3 for path, _ in paths for y, x in path if 8 <= y < a.shape[0] - 8 and 8 <= x < a.shape[1] - 8]
                rows.append((i, len(paths), int(sum(len(p) for p, _ in paths)), float(a.min()), float(np.mean(on)) if on else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["scene", "paths", "points", "darkest", "found"])

    return patterns(spark, sf_dir).mapInArrow(task, "scene long, paths long, points long, darkest double, found double")


@query()
def nonrigid_recording(spark, sf_dir):
    """Frames that turn: patch shifts, robust affine and local fields over the translation result; the angle found, written and read back."""
    from ..operators import fields

    frames = cut(turning(spark, sf_dir))
    t = cut(registration.stabilize(frames, least_ncc=0.3))
    path = _folder(spark, "fields")
    f = results.once(spark, path, lambda: fields.refine(frames, t))
    angle = F.degrees(F.atan2(F.col("affine")[3] - F.col("affine")[1], F.col("affine")[0] + F.col("affine")[4] + 2))
    j = f.join(frames.select("burst", "index", "angle"), ["burst", "index"])
    w = Window.partitionBy("burst")
    # the template is at the mean angle, and a field undoes a frame's own turn
    found = -(angle - F.avg(angle).over(w))
    return j.select("burst", "index", F.round(F.col("angle") - F.avg("angle").over(w), 3).alias("true_angle"), F.round(found, 3).alias("angle"), F.round("update", 3).alias("update"), F.round("ncc", 4).alias("ncc"), "rejected")


@query()
def tile_residuals(spark, sf_dir):
    """How far tiles of a recording still move against the mean: after translation, and after the non-rigid fields."""
    from ..operators import fields

    frames = cut(turning(spark, sf_dir))
    t = cut(registration.stabilize(frames, least_ncc=0.3))
    f = cut(fields.refine(frames, t))
    h, w = frames.select("height", "width").first() or (0, 0)  # all frames are of one size
    still = F.array_repeat(F.lit(0.0), 2 * len(fields.Grid(h, w).y) * len(fields.Grid(h, w).x))
    none = t.select("burst", "index", F.array(F.lit(0.0), F.lit(0.0), "dx", F.lit(0.0), F.lit(0.0), "dy").alias("affine"), still.alias("local"))
    both = none.withColumn("method", F.lit("translation")).union(f.select("burst", "index", "affine", "local").withColumn("method", F.lit("nonrigid")))
    rows = frames.join(both, ["burst", "index"]).select(F.concat_ws("/", "burst", "method").alias("burst"), "index", "height", "width", "bit_depth", "pixels", "affine", "local")
    rows = cut(rows)
    moves = fields.tile_moves(rows, fields.templates(rows, 64, 32), 2, 3)
    spread = moves.groupBy("burst", "tile").agg(F.sqrt(F.var_pop("dy") + F.var_pop("dx")).alias("s"))
    got = spread.groupBy(F.col("burst").alias("key")).agg(F.max("s").alias("largest"), F.median("s").alias("middle"))  # six tiles
    return got.select("key", F.round("largest", 3).alias("largest"), F.round("middle", 3).alias("middle"))


@query()
def feature_registration(spark, sf_dir):
    """Each frame matched with the first by corner patches, a similarity that most agree on, and the model kept by its misfit."""
    import pyarrow as pa

    from ..operators import fields

    frames = cut(turning(spark, sf_dir))
    first = frames.filter("index = 0").select("burst", F.col("pixels").alias("reference"))

    def run(batches):
        kept: dict[bytes, tuple] = {}  # frames of all recordings come mixed
        for batch in small(batches):
            rows = []
            for index, h, w, raw, ref in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if ref not in kept:
                    corners = fields.corner_patches(np.frombuffer(ref, "<u2").reshape(h, w) / 4095.0)
                    kept = {ref: corners} if len(kept) > 64 else kept | {ref: corners}
                p, dp = kept[ref]
                q, dq = fields.corner_patches(np.frombuffer(raw, "<u2").reshape(h, w) / 4095.0)
                m = fields.matched(dp, dq)
                s, good = fields.consensus(p[m[:, 0]], q[m[:, 1]], seed=index)
                if s is None:
                    rows.append((index, len(m), 0, None, None, None, None))
                    continue
                name, _, misfit = fields.chosen_model(p[m[good, 0]], q[m[good, 1]])
                rows.append((index, len(m), int(good.sum()), float(np.hypot(s[0, 0], s[1, 0])), float(np.degrees(np.arctan2(s[1, 0], s[0, 0]))), name, misfit))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["burst", "index", "matches", "inliers", "scale", "turn", "model", "misfit"])

    rows = registration.beside(frames, first, ["burst"], "reference").select("burst", "index", "height", "width", "pixels", "reference")
    got = rows.mapInArrow(run, "burst string, `index` int, matches long, inliers long, scale double, turn double, model string, misfit double")
    return got.select("burst", "index", "matches", "inliers", F.round("scale", 4).alias("scale"), F.round("turn", 3).alias("turn"), "model", F.round("misfit", 3).alias("misfit"), (F.col("inliers") >= 10).alias("good"))


@query()
def consecutive_steps(spark, sf_dir):
    """Steps between neighbouring frames and the way they add up to, with thumbnails of what is aligned."""
    import pyarrow as pa

    from ..operators.kernels import phase_shift_2d

    frames = cut(recorded(spark, sf_dir).filter("not blink"))
    w = Window.partitionBy("burst").orderBy("index")
    # pictures are met by their places; a recording's window sees numbers only
    before = frames.select("burst", (F.col("place") + 1).alias("place"), F.col("pixels").alias("before"))
    pairs = frames.select("burst", "place", "index", "height", "width", "pixels", "true_dy", "true_dx").join(before, ["burst", "place"], "left")
    pairs = pairs.select("burst", "index", "height", "width", "pixels", "true_dy", "true_dx", "before")

    def run(batches):
        for batch in small(batches):
            rows = []
            for h, wd, raw, ref in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 7)), strict=True):
                a = np.frombuffer(raw, "<u2").reshape(h, wd) / 4095.0
                dy, dx = (0.0, 0.0) if ref is None else phase_shift_2d(np.frombuffer(ref, "<u2").reshape(h, wd) / 4095.0, a)[:2]
                rows.append((dy, dx, float(a[::4, ::4].mean())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), batch.column(6), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], names=["burst", "index", "true_dy", "true_dx", "sy", "sx", "thumbnail"])

    s = pairs.mapInArrow(run, "burst string, `index` int, true_dy double, true_dx double, sy double, sx double, thumbnail double")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("burst", "index", F.round("sy", 2).alias("step_y"), F.round("sx", 2).alias("step_x"), F.round(F.sum("sy").over(upto) - F.col("true_dy") + F.first("true_dy").over(upto), 2).alias("drift_y"), F.round(F.sum("sx").over(upto) - F.col("true_dx") + F.first("true_dx").over(upto), 2).alias("drift_x"), F.round("thumbnail", 4).alias("thumbnail"))


@query()
def negative_control(spark, sf_dir):
    """Velocity along lines of the table's patterns: some flow, some stand still, and none of those may pass as reliable."""
    import pyarrow as pa

    from ..operators import velocity

    def task(batches):
        for batch in small(batches):
            rows = []
            for i, kind, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e, flowing = np.array(e), kind % 2 == 0
                e = (e - e.mean()) / max(e.std(), 1e-9)
                rng = np.random.default_rng(3000 + i)
                k = synthetic.kymograph(100, 90, 1.4 + 0.2 * kind, seed=i, pattern=e) if flowing else rng.normal(size=(100, 90)) + np.convolve(np.resize(e, 98), np.ones(9) / 3, "valid")[None]
                v, _, agree, reliable = velocity.estimate(velocity.without_static(k))
                rows.append((i, flowing, float(v), agree, reliable))
            kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["line", "flowing", "velocity", "agree", "reliable"])

    return patterns(spark, sf_dir).mapInArrow(task, "line long, flowing boolean, velocity double, agree long, reliable boolean")


@query()
def drawn_recordings(spark, sf_dir):
    """The drawn recordings themselves: how far each frame has moved, how bright it is and whether it blinks."""
    f = cut(recorded(spark, sf_dir))
    scores = registration.working_frames(f, 120).select("burst", "index", "log_sharpness", "brightness")
    return f.select("burst", "index", F.round("true_dy", 3).alias("dy"), F.round("true_dx", 3).alias("dx"), "blink").join(scores, ["burst", "index"]).withColumn("log_sharpness", F.round("log_sharpness", 3)).withColumn("brightness", F.round("brightness", 4))
