import json
import shutil
import struct

import numpy as np
import pytest

from framequarry.operators import synthetic
from framequarry.operators.kernels import frame_scores
from framequarry.operators.plugins import Entry, Registry, default_registry, segment, source_hash
from framequarry.sources import bursts, tiff


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_tiff_is_bit_exact(kind):
    a = np.random.default_rng(7).integers(0, np.iinfo(kind).max + 1, (40, 63)).astype(kind)
    a[0, 0], a[0, 1] = 0, np.iinfo(kind).max
    assert (tiff.decode(tiff.encode(a)) == a).all()


def test_tiff_of_other_byte_order_and_damage():
    a = np.arange(6, dtype=np.uint16).reshape(2, 3)
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (279, 4, 12)]
    body = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    raw = b"MM" + struct.pack(">HI", 42, 20) + a.astype(">u2").tobytes() + body + b"\0\0\0\0"
    assert (tiff.decode(raw) == a).all()
    for bad in (b"", b"no", raw[:30]):
        with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
            tiff.decode(bad)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("recordings")
    frames, _ = synthetic.burst(6, 40, 64, 1, 0.5)
    for name, manifest, stamps in (
        ("burst_1", {"acquisition_requested": {"requested_fps": 40.0}, "capture": {"effective_fps": 32.0}, "pixel_values": {"bit_depth": 12, "dtype": "uint16"}}, True),
        ("burst_2", {"acquisition_requested": {"requested_fps": 40.0}, "pixel_values": {"dtype": "uint8"}}, False),
        ("burst_3", {}, None),
    ):
        folder = top / name
        folder.mkdir()
        for k, f in enumerate(frames):
            (folder / f"frame_{k:06d}.tif").write_bytes(tiff.encode(np.frombuffer(f, np.uint16).reshape(40, 64)))
        (folder / "manifest.json").write_text(json.dumps(manifest))
        if stamps is not None:
            lines = [f"frame_{k:06d}.tif,{10**18 + k * 25_000_000 if stamps or k else ''},{k}" for k in range(6)]
            (folder / "frames.csv").write_text("\n".join(["filename,camera_timestamp_ns,index", *lines]))
    (top / "burst_3" / "frame_000009.tif").write_bytes(b"broken")
    return f"file://{top}"


def test_recordings(spark, root):
    files = bursts.discover(spark, root)
    assert files.groupBy("burst").count().count() == 3 and files.count() == 19
    manifests = bursts.manifests(spark, root)
    assert {r.burst: (r.fps, r.bit_depth) for r in manifests.collect()} == {"burst_1": (32.0, 12), "burst_2": (40.0, 8), "burst_3": (30.0, 12)}
    times = bursts.frame_times(files, bursts.frames_meta(spark, root), manifests)
    got = {(r.burst, r["index"]): r.time_s for r in times.collect()}
    assert abs(got["burst_1", 3] - 0.075) < 1e-9 and abs(got["burst_2", 3] - 3 / 40) < 1e-9 and abs(got["burst_3", 3] - 0.1) < 1e-9
    frames = bursts.frames(spark, root)
    assert frames.filter("pixels is null").count() == 1 and frames.filter("height = 40 and width = 64 and bit_depth = 16").count() == 18
    assert all(r.has_data for r in bursts.has_image_data(frames).collect())


def test_names_of_files_stay_in_tasks(spark, root, tmp_path):
    """The driver has no index of the files, what is read is what Spark's reader reads, and roots that tasks cannot list are left to it."""
    shutil.copytree(root.removeprefix("file://"), tmp_path / "deep" / "er")
    for name in ("_hidden", ".hidden"):
        shutil.copytree(tmp_path / "deep" / "er" / "burst_1", tmp_path / "deep" / name)
    top = f"file://{tmp_path}/deep"
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "frame_*.tif").load(top)
    key = lambda df: {(r.path.replace("file:///", "file:/"), r.length, r.modificationTime, bytes(r.content)) for r in df.collect()}
    ours = bursts.binary(spark, top, "frame_*.tif")
    assert key(ours) == key(theirs) and ours.count() == 19
    for df in (bursts.discover(spark, top), bursts.frames(spark, top), bursts.frames_meta(spark, top), bursts.manifests(spark, top)):
        assert not [f for f in df.inputFiles() if "burst_" in f]
    assert bursts.frames(spark, f"{top}/*/burst_1").count() == 6 == bursts.discover(spark, f"{top}/*/burst_1").count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bursts.discover(spark, f"{top}/none")
    (tmp_path / "empty").mkdir()
    assert bursts.frames(spark, f"file://{tmp_path}/empty").count() == 0 == bursts.discover(spark, str(tmp_path / "empty")).count()


def test_sinks(spark, root, tmp_path):
    frames = bursts.frames(spark, root).filter("pixels is not null")
    out = bursts.write_frames(frames, str(tmp_path / "copy"))
    assert out.count() == 18
    again = bursts.frames(spark, f"file://{tmp_path}/copy")
    assert again.join(frames, ["burst", "index", "pixels"]).count() == 18
    bursts.write_transforms(spark.createDataFrame([(1, 0.123456, True)], "i int, dx double, ok boolean"), f"file://{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").collect()[0].asDict() == {"i": "1", "dx": "0.1235", "ok": "1"}
    bursts.write_metrics(spark.createDataFrame([(1, [2.0])], "burst int, q array<double>"), f"file://{tmp_path}/m")
    assert json.loads(spark.read.text(f"file://{tmp_path}/m").collect()[0].value) == {"burst": 1, "q": [2.0]}


def test_release_and_overlay(spark, tmp_path):
    (tmp_path / "release.json").write_text(json.dumps({"release": "r", "bursts": [{"burst": "a", "files": [{"path": "a/x", "bytes": 3, "sha256": "00"}]}]}))
    assert bursts.release_files(spark, f"file://{tmp_path}/release.json").collect()[0].path == "a/x"
    for version in (1, 2):
        (tmp_path / f"o{version}.json").write_text(json.dumps({"format": "overlay", "version": version, "vessels": [{"id": "v", "points": [[1, 2]], "props": {"k": "1"}}]}))
    assert bursts.overlays(spark, f"file://{tmp_path}/o1.json").collect()[0].vessels[0].id == "v"
    with pytest.raises(Exception, match="unknown overlay version"):
        bursts.overlays(spark, f"file://{tmp_path}/o2.json").collect()


def test_scores_and_plugins(spark):
    frames, _ = synthetic.burst(8, 60, 80, 3, 0.5, blinks=(4,))
    df = spark.createDataFrame([("b", k, 60, 80, 12, f) for k, f in enumerate(frames)] + [("b", 99, 60, 80, 12, None)], "burst string, index int, height int, width int, bit_depth int, pixels binary")
    score = {r["index"]: r for r in frame_scores(df).collect()}
    assert score[99].brightness is None and min((k for k in score if k != 99), key=lambda k: score[k].log_sharpness) == 4
    registry = default_registry()
    assert not registry.add(Entry("dark", "Other", lambda a: a > 2, 1)) and [e.ident for e in registry.listed()] == ["dark", "ridges"]
    got = segment(df, registry, "dark").collect()
    assert len(got) == 9 and all((r.area is None) == (r["index"] == 99) for r in got)
    own = Registry()
    assert own.add(Entry("x", "X", lambda a: a > 2, 3)) and own.add(Entry("x", "Y", lambda a: a > 2, 1)) and own["x"].label == "Y"
    assert source_hash("a\r\nb") == source_hash("a\nb")
