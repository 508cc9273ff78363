"""Locks that time undoes: loss after a stretch without a hit, control rows in band, state that goes when it is not needed.

Rows wait in the state until the watermark has passed them and are then taken in the order of their time, so batches do
not matter. A lock is lost when event time, be it another row's or the watermark's alone, is more than ``gap`` after the
last hit. A stream that is not locked and has nothing waiting keeps no state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "stream bigint, at_us bigint, change string"


def timed_locks(frames: DataFrame, gap_us: int, late: str) -> DataFrame:
    """CHANGES of a stream of rows (stream, ts, us, index, kind: "hit", "relock" or anything else): locked, lost, relock, late.

    A hit locks. Loss is dated ``gap_us`` after the last hit, and looked for before what comes later. A relock row ends a
    lock at its time and is nothing to a stream without one. A row that the watermark had passed when it came changes
    nothing and is given as "late". Ties in time go by index, and in that by kind.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = state.get if state.exists else ("[]", -1)
        mark = state.getCurrentWatermarkMs() * 1000
        rows, out = [tuple(r) for r in json.loads(waiting)], []
        for pdf in batches if not state.hasTimedOut else ():
            new = list(zip(pdf["us"].tolist(), pdf["index"].tolist(), pdf["kind"].tolist(), strict=True))
            out += [(r[0], "late") for r in new if r[0] < mark]
            rows += [r for r in new if r[0] >= mark]
        rows.sort()
        due, rows = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        for us, _, kind in due:
            if last >= 0 and us - last > gap_us:
                out.append((last + gap_us, "lost"))
                last = -1
            if kind == "hit":
                if last < 0:
                    out.append((us, "locked"))
                last = us
            elif kind == "relock" and last >= 0:
                out.append((us, "relock"))
                last = -1
        if last >= 0 and last + gap_us < mark:
            out.append((last + gap_us, "lost"))
            last = -1
        if rows or last >= 0:
            state.update((json.dumps(rows), int(last)))
            next_us = min([r[0] for r in rows[:1]] + [last + gap_us] * (last >= 0))
            state.setTimeoutTimestamp(max(next_us // 1000, mark // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], at, change) for at, change in out], columns=["stream", "at_us", "change"]).astype({"stream": "int64", "at_us": "int64"})

    rows = frames.withWatermark("ts", late).select("stream", "ts", "us", "index", "kind").filter(F.col("stream").isNotNull() & F.col("us").isNotNull())
    return rows.groupBy("stream").applyInPandasWithState(step, CHANGES, "waiting string, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def closed_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n: each session once, when the watermark has passed its end; later rows are dropped and counted."""
    by = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
