"""Recordings whose frames come from a table: every vector of ``embeddings`` is a frame, its label the recording.

The mean vector of a label gives the amplitudes of 64 waves; where they cancel there are dark lines, and that is the
scene. A vector's first two numbers move the scene, its third one makes a blink, its identifier seeds the noise. So
frames grow with the table, and the motion that must be found stands in it. The same vectors give recordings that turn,
signals of live streams, and, in blocks of neighbouring identifiers, the patterns that flow through kymographs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small
from ..operators.kernels import gaussian
from ..operators.synthetic import shifted
from .registry import table

HEIGHT, WIDTH, BITS = 64, 96, 12
#: Pixels a unit of a vector; a third number over this makes a blink.
REACH, BLINK = 12.0, 0.28

_KINDS = (("burst", pa.string()), ("index", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("bit_depth", pa.int32()), ("pixels", pa.binary()), ("true_dy", pa.float64()), ("true_dx", pa.float64()), ("blink", pa.bool_()), ("place", pa.int32()))


def scene(amplitudes: np.ndarray, height: int = HEIGHT, width: int = WIDTH) -> np.ndarray:
    """A periodic picture, 0 to 1, with dark lines where 64 waves of the given amplitudes cancel."""
    y, x = np.arange(height)[:, None] / height, np.arange(width)[None] / width
    a = np.zeros((height, width))
    for k, c in enumerate(amplitudes):
        a += c * np.cos(2 * np.pi * ((k // 8) * y + (k % 8 - 3) * x + 0.618 * k))
    a /= max(a.std(), 1e-9)
    return np.clip(0.7 + 0.05 * a - 0.35 * np.exp(-((a / 0.35) ** 2)), 0, 1)


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Few small rows that cost much each go to all shuffle partitions, which repartition() without their number would merge.

    By a hash of the columns: rows that were grouped by the columns themselves would stay where they are, in merged partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*(by or ("burst", "index"))))


def _rows(spark, sf_dir) -> DataFrame:
    """burst, index, vec_id, e (the vector), mean (of its label)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    mean = v.select("label", F.posexplode("e").alias("k", "x")).groupBy("label", "k").agg(F.round(F.avg("x"), 9).alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))  # as many as a vector has numbers
    index = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return v.select(F.format_string("burst_%02d", "label").alias("burst"), index.cast("int").alias("index"), "vec_id", "label", "e").join(mean, "label")


def recorded(spark, sf_dir) -> DataFrame:
    """burst, index, height, width, bit_depth, pixels, true_dy, true_dx, blink of all vectors; place, from 1, among a recording's blinks or its other frames."""
    place = F.row_number().over(Window.partitionBy("burst", F.coalesce(F.col("z") > BLINK, F.lit(False))).orderBy("index"))
    rows = _rows(spark, sf_dir).select("burst", "index", "vec_id", F.col("e")[0].alias("y"), F.col("e")[1].alias("x"), F.col("e")[2].alias("z"), "mean")
    rows = _dealt(rows.withColumn("place", place).select("burst", "index", "vec_id", "y", "x", "z", "place", "mean"))

    def draw(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in small(batches):
            out = []
            for burst, i, ident, y, x, z, place, mean in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if burst not in kept:
                    kept = {burst: scene(np.array(mean))} if len(kept) > 64 else kept | {burst: scene(np.array(mean))}
                f = shifted(kept[burst], REACH * y, REACH * x) + np.random.default_rng(ident).normal(0, 0.01, (HEIGHT, WIDTH))
                blink = z > BLINK
                f = gaussian(f, 8) * 0.4 if blink else f
                out.append((burst, i, HEIGHT, WIDTH, BITS, (np.clip(f, 0, 1) * ((1 << BITS) - 1)).astype("<u2").tobytes(), REACH * y, REACH * x, blink, place))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])

    return rows.mapInArrow(draw, "burst string, `index` int, height int, width int, bit_depth int, pixels binary, true_dy double, true_dx double, blink boolean, place int")


def turning(spark, sf_dir, height: int = 128, width: int = 160) -> DataFrame:
    """burst, index, height, width, bit_depth, pixels, angle: eight vectors of a label make a frame, which the sum of their first numbers, in degrees, turns about its middle."""
    from ..operators import fields

    def draw(batches):
        grid, kept = fields.Grid(height, width), {}
        for batch in small(batches):
            out = []
            for burst, i, ident, turn, mean in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if burst not in kept:
                    kept = {burst: scene(np.array(mean), height, width)} if len(kept) > 64 else kept | {burst: scene(np.array(mean), height, width)}
                angle = np.radians(turn)
                m = np.array([[np.cos(angle) - 1, -np.sin(angle)], [np.sin(angle), np.cos(angle) - 1]])
                d = fields.Field(np.column_stack([m, -m @ np.array([(width - 1) / 2, (height - 1) / 2])]), np.zeros((len(grid.y), len(grid.x), 2)))
                f = fields.warped(kept[burst], d, grid)
                f = np.where(np.isfinite(f), f, kept[burst].mean()) + np.random.default_rng(ident).normal(0, 0.005, f.shape)
                out.append((burst, i, height, width, BITS, (np.clip(f, 0, 1) * ((1 << BITS) - 1)).astype("<u2").tobytes(), float(np.degrees(angle))))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["burst", "index", "height", "width", "bit_depth", "pixels", "angle"])

    eights = _rows(spark, sf_dir).groupBy("burst", F.expr("cast(`index` div 8 as int)").alias("index"))
    rows = _dealt(eights.agg(F.min("vec_id").alias("vec_id"), F.round(F.sum(F.col("e")[0]), 6).alias("turn"), F.any_value("mean").alias("mean")))
    return rows.mapInArrow(draw, "burst string, `index` int, height int, width int, bit_depth int, pixels binary, angle double")


#: Frames of a live stream a vector, and when, of 220 frames, another scene is seen.
STEPS, ROUND, ELSEWHERE = 5, 220, (90, 150)
#: Strides in which a mean vector is read, one after the other, for a stream's scene and for the other one.
WAYS = ((1, 5, 11, 23), (3, 7, 13, 29))


def live_signals(spark, sf_dir) -> DataFrame:
    """stream, index, seconds, frame (256 numbers), truth: each label a stream, each vector five frames that its numbers move.

    Frames 60 to 62 of a round are a blink; from 90 to 150 another scene (the mean vector in other orders) is seen.
    """
    from ..streaming.stabilizer import moved

    def draw(batches):
        for batch in small(batches):
            out = []
            for burst, k, ident, e, mean in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = ELSEWHERE[0] <= k % ROUND < ELSEWHERE[1]
                at = np.arange(len(mean))[None] * np.array(WAYS[int(other)])[:, None] % len(mean)
                a = np.convolve(np.pad(np.resize(np.array(mean)[at], 256), 4, mode="wrap"), np.hanning(9), "valid")
                a = moved(0.6 + 0.03 * (a - a.mean()) / max(np.diff(a).std(), 1e-9), 5 * e) + np.random.default_rng([ident, k]).normal(0, 0.005, 256)
                if k % ROUND in (60, 61, 62):
                    a = 0.2 * np.convolve(np.pad(a, 20, mode="wrap"), np.ones(41) / 41, "valid")
                out.append((burst.replace("burst_", "s"), k, k / 16.0, a.tolist(), 5 * e))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["stream", "index", "seconds", "frame", "truth"])

    steps = _rows(spark, sf_dir).select("burst", "index", "vec_id", "mean", F.posexplode(F.slice("e", 1, STEPS)).alias("k", "x"))
    rows = _dealt(steps.select("burst", (F.col("index").cast("long") * STEPS + F.col("k")).alias("index"), "vec_id", "x", "mean"))
    return rows.mapInArrow(draw, "stream string, `index` long, seconds double, frame array<double>, truth double")


#: Vectors of neighbouring identifiers that make one line's pattern.
BLOCK = 32


def patterns(spark, sf_dir) -> DataFrame:
    """line, kind (0 to 5: where the first vector is largest), e: the numbers of a block of vectors, one after the other."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    b = v.groupBy(F.expr(f"vec_id div {BLOCK}").alias("line")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "e"))).alias("v"))  # BLOCK vectors at most
    first = F.col("v")[0]["e"]
    return _dealt(b, "line").select("line", ((F.array_position(first, F.array_max(first)) - 1) % 6).cast("int").alias("kind"), F.flatten(F.transform("v", lambda x: x["e"])).alias("e"))


def numbers(e: list[float]) -> list[int]:
    """A vector as whole numbers, which seed what is drawn of it."""
    return [int(abs(x) * 1e6) for x in e]
