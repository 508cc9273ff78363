"""Groupwise registration of a recording's frames: a template, each frame's shift to it, and again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small
from ..functions.lineage import cut
from .kernels import ncc, phase_shift_2d
from .synthetic import shifted

#: Templates of so many bytes are broadcast; beyond it each is dealt out SALTS times, so that no recording is one task.
MOST_BROADCAST, SALTS = 64 << 20, 16

_PARTIAL = "burst string, height int, width int, n bigint, total binary"


def _image(raw: bytes, h: int, w: int, bits: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if bits > 8 else np.uint8).reshape(h, w) / float((1 << bits) - 1)


def _sums(batches):
    """Aligned sums of each batch's frames by recording: what the reducer gets is a picture a task, not a frame."""
    sums: dict[tuple, list] = {}
    for batch in small(batches):
        for burst, h, w, bits, raw, dy, dx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a = _image(raw, h, w, bits)
            slot = sums.setdefault((burst, h, w), [0, np.zeros((h, w))])
            slot[0] += 1
            slot[1] += shifted(a, -(dy or 0.0), -(dx or 0.0)) if dy or dx else a
    rows = [(b, h, w, n, s.astype("<f8").tobytes()) for (b, h, w), (n, s) in sums.items()]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["burst", "height", "width", "n", "total"])


def templates(frames: DataFrame) -> DataFrame:
    """burst, height, width, n, template: mean of the frames (with dy, dx: aligned by them); partial sums, then their sum."""
    part = frames.select("burst", "height", "width", "bit_depth", "pixels", "dy", "dx").mapInArrow(_sums, _PARTIAL)

    def merge(table: pa.Table) -> pa.Table:
        n = int(np.sum(table.column("n").to_numpy()))
        total = sum(np.frombuffer(x, "<f8") for x in table.column("total").to_pylist())
        first = [table.column(k)[0].as_py() for k in ("burst", "height", "width")]
        return pa.table({"burst": pa.array(first[:1]), "height": pa.array(first[1:2], pa.int32()), "width": pa.array(first[2:], pa.int32()), "n": pa.array([n]), "template": pa.array([(total / n).astype("<f8").tobytes()])})

    return part.groupBy("burst", "height", "width").applyInArrow(merge, "burst string, height int, width int, n bigint, template binary")


def _match(batches):
    for batch in small(batches):
        out = []
        for h, w, bits, raw, tpl in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
            a, t = _image(raw, h, w, bits), np.frombuffer(tpl, "<f8").reshape(h, w)
            dy, dx, response = phase_shift_2d(t, a)
            out.append((dy, dx, response, ncc(shifted(a, -dy, -dx), t)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([o[k] for o in out], pa.float64()) for k in range(4)]], names=["burst", "index", "dy", "dx", "response", "ncc"])


def beside(frames: DataFrame, few: DataFrame, on: list[str], value: str, write=cut) -> DataFrame:
    """frames with ``value`` (bytes) of their recording: broadcast where all of it is within the bound, else salted by frame."""
    few = write(few.select(*on, value))
    if (few.agg(F.sum(F.octet_length(value))).first()[0] or 0) <= MOST_BROADCAST:
        return frames.join(F.broadcast(few), on)
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return frames.withColumn("salt", F.pmod("index", F.lit(SALTS))).join(dealt, [*on, "salt"]).drop("salt")


def shifts(frames: DataFrame, tpl: DataFrame, write=cut) -> DataFrame:
    """burst, index, dy, dx, response, ncc of each frame against its recording's template."""
    cols, on = ["index", "height", "width", "bit_depth", "pixels"], ["burst", "height", "width"]
    rows = beside(frames.select("burst", *cols), tpl, on, "template", write)
    return rows.select("burst", *cols, "template").mapInArrow(_match, "burst string, `index` int, dy double, dx double, response double, ncc double")


def register(frames: DataFrame, rounds: int = 3, write=cut) -> DataFrame:
    """burst, index, dy, dx, response, ncc: frames against a template that their own alignment sharpens, round by round.

    The first template is each recording's first frame. ``write`` cuts the lineage between rounds; frames whose pixels do not fit are left out.
    """
    bytes_ = F.col("height") * F.col("width") * F.when(F.col("bit_depth") > 8, 2).otherwise(1)
    frames = frames.filter(F.col("pixels").isNotNull() & (F.octet_length("pixels") == bytes_))
    none = F.lit(None).cast("double")
    first = frames.groupBy("burst").agg(F.min("index").alias("index")).join(frames, ["burst", "index"]).withColumn("dy", none).withColumn("dx", none)
    found = write(shifts(frames, templates(first), write))
    for _ in range(rounds - 1):
        found = write(shifts(frames, templates(frames.join(found.select("burst", "index", "dy", "dx"), ["burst", "index"])), write))
    return found


def working_frames(frames: DataFrame, height: int = 600) -> DataFrame:
    """burst, index, height, width, bit_depth (16), pixels, scale, log_sharpness, brightness, clipped_fraction: block means of frames no higher than ``height``.

    The frame's scores are taken in the same pass over its pixels. Frames whose pixels do not fit have nulls.
    """
    from .kernels import laplacian
    from .masks import downscale

    names = ["height", "width", "bit_depth", "pixels", "scale", "log_sharpness", "brightness", "clipped_fraction"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches):
        for batch in small(batches):
            out = []
            for h, w, bits, raw in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if raw is None or not h or not w or len(raw) != h * w * (2 if bits > 8 else 1):
                    out.append((None,) * 8)
                    continue
                full = (1 << bits) - 1
                a = np.frombuffer(raw, "<u2" if bits > 8 else np.uint8).reshape(h, w)
                k = max(1, -(-h // height))
                x = downscale(a, k) / full if k > 1 else a / full
                out.append((*x.shape, 16, np.rint(x * 65535).astype("<u2").tobytes(), k, float(np.log(max(laplacian(x).var(), 1e-12))), float(x.mean()), float((a >= full).mean())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=["burst", "index", *names])

    schema = "burst string, `index` int, height int, width int, bit_depth int, pixels binary, scale int, log_sharpness double, brightness double, clipped_fraction double"
    return frames.select("burst", "index", "height", "width", "bit_depth", "pixels").mapInArrow(run, schema)


def stabilize(frames: DataFrame, most_rounds: int = 5, tolerance: float = 0.05, least_ncc: float = 0.5, height: int = 600, write=cut) -> DataFrame:
    """burst, index, keep, reason, registered, dy, dx (pixels of the input), response, ncc of every frame of every recording.

    Frames are scored, gated, and aligned at a working scale: the first template is the sharpest frame that the gate
    keeps; templates are made again from aligned frames until 0.9 of the shifts of each recording move by less than
    ``tolerance``, or for ``most_rounds``. Shifts are centred on their median. A frame is registered if it was kept and
    agrees with the template. Recordings without a kept frame have no shifts.
    """
    from .gate import gate

    small = write(working_frames(frames, height))
    scores = small.drop("pixels", "height", "width", "bit_depth")
    gated = write(gate(scores, "burst", "log_sharpness", "brightness"))
    good = small.join(gated.filter("keep").select("burst", "index"), ["burst", "index"]).select("burst", "index", "height", "width", "bit_depth", "pixels").filter("pixels is not null")
    good = write(good)
    none = F.lit(None).cast("double")
    start = gated.filter("keep").groupBy("burst").agg(F.max_by("index", F.struct("log_sharpness", -F.col("index"))).alias("index"))
    first = good.join(start, ["burst", "index"]).withColumn("dy", none).withColumn("dx", none)
    found = write(shifts(good, templates(first), write))
    settled = None
    for _ in range(most_rounds - 1):
        new = write(shifts(good, templates(good.join(found.filter(F.col("ncc") >= least_ncc).select("burst", "index", "dy", "dx"), ["burst", "index"])), write))
        both = new.join(found.select("burst", "index", F.col("dy").alias("y0"), F.col("dx").alias("x0")), ["burst", "index"])
        middle = both.groupBy("burst").agg(F.median(F.col("dy") - F.col("y0")).alias("my"), F.median(F.col("dx") - F.col("x0")).alias("mx"))
        moved = both.join(middle, "burst").select("burst", F.hypot(F.col("dy") - F.col("y0") - F.col("my"), F.col("dx") - F.col("x0") - F.col("mx")).alias("d"))
        open_ = write(moved.groupBy("burst").agg(F.percentile("d", F.lit(0.9)).alias("p")).filter(F.col("p") >= tolerance).select("burst"))
        # recordings that have converged leave; the others go on alone
        done = new.join(open_, "burst", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        found = new.join(open_, "burst", "left_semi")
        if open_.isEmpty():
            break
        good = good.join(open_, "burst", "left_semi")
    found = found if settled is None else write(settled.unionByName(found))
    middle = found.groupBy("burst").agg(F.median("dy").alias("my"), F.median("dx").alias("mx"))
    rows = gated.join(found.join(middle, "burst"), ["burst", "index"], "left")
    ok = F.coalesce(F.col("keep") & (F.col("ncc") >= least_ncc), F.lit(False))
    place = lambda c, m: F.when(ok, (F.col(c) - F.col(m)) * F.col("scale"))
    return rows.select("burst", "index", "keep", "reason", ok.alias("registered"), place("dy", "my").alias("dy"), place("dx", "mx").alias("dx"), "response", "ncc", "sharpness_z", "brightness_z", "clipped_fraction")
