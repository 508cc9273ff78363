"""Live streams: gates with state, sessions, sliding rates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Frames that set the reference before results are given, and frames without a match until it is lost.
LOCK, LOST_AFTER = 24, 8
#: Weight of a new frame in the running reference; the anchor keeps the rest from drifting.
FADE, ANCHOR = 0.1, 0.5
#: Relative change of brightness up to which a frame matches the reference.
TOLERANCE = 0.5

RESULTS = "stream string, `index` bigint, offset double, registered boolean, state string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """locking until LOCK frames are in, then locked; LOST_AFTER misses in a row set the reference anew."""
    seen, total, anchor, ref, misses = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0)
    out: list[tuple[Any, ...]] = []
    rows = pd.concat(list(frames)).sort_values("index")
    for index, value in zip(rows["index"].tolist(), rows["value"].tolist(), strict=True):
        if value is None or value != value:
            out.append((key[0], index, None, False, "locked" if seen >= LOCK else "locking"))
            continue
        if seen < LOCK:
            seen, total = seen + 1, total + value
            if seen == LOCK:
                anchor = ref = total / LOCK
            out.append((key[0], index, None, False, "locking"))
            continue
        hit = abs(value / max(abs(ref), 1e-9) - 1) <= TOLERANCE
        misses = 0 if hit else misses + 1
        if hit:
            ref = (1 - FADE) * ref + FADE * (ANCHOR * anchor + (1 - ANCHOR) * value)
        out.append((key[0], index, float(value - ref) if hit else None, bool(hit), "locked" if misses < LOST_AFTER else "lost"))
        if misses >= LOST_AFTER:
            seen, total, misses = 0, 0.0, 0
    state.update((int(seen), float(total), float(anchor), float(ref), int(misses)))
    yield pd.DataFrame(out, columns=["stream", "index", "offset", "registered", "state"])


def anchored_fade(frames: DataFrame) -> DataFrame:
    """RESULTS of a stream (stream, index, value): a running reference with an anchor, kept per stream."""
    state = "seen bigint, total double, anchor double, ref double, misses bigint"
    return frames.groupBy("stream").applyInPandasWithState(_step, RESULTS, state, "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n: sessions closed by a gap; events later than ``late`` are dropped."""
    by = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_per_second(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """key, second, fps: frames in each second."""
    by = events.withWatermark(ts, late).groupBy(key, F.window(ts, "1 second").alias("w")).agg(F.count(F.lit(1)).alias("fps"))
    return by.select(key, F.col("w.start").alias("second"), "fps")


def replay(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_idempotent(df: DataFrame, path: str, checkpoint: str, partition: str, mode: str = "append"):
    """A sink that writes each batch under its own number, so a batch that runs twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).queryName(f"{partition}_{abs(hash(checkpoint))}").trigger(availableNow=True).start()
