"""A stabilizer on a stream: calibrates on its first clear frames, registers every later one, notices when it is lost.

State per stream, in the state store: the frames of a calibration, then a permanent base and a fading sum that follows
slow change, statistics that tell clear frames from blinks, and the last few references, which a stream that comes back
rejoins. Frames are rows of numbers; nothing but the state is held between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..operators.kernels import ncc, phase_shift_1d

#: Frames of a calibration; weight that a fading sum keeps a frame; seconds without a match until the stream is lost.
LOCK, DECAY, LOST_AFTER = 24, 1 - 1 / 64, 1.0
#: Agreement that a registered frame needs; that two references of one scene need; references that are remembered.
MATCH, SAME, REMEMBERED = 0.6, 0.8, 4
#: Robust scores of sharpness and brightness beyond which a frame is a blink, and the least relative change for that.
UNUSUAL, CHANGE = 4.0, 0.25

RESULTS = StructType([StructField("stream", StringType()), StructField("index", LongType()), StructField("offset", DoubleType()), StructField("registered", BooleanType()), StructField("state", StringType())])
_NUMBERS = ArrayType(DoubleType())
_STATE = StructType(
    [
        StructField("waiting", _NUMBERS),  # calibration frames, end to end
        StructField("base", _NUMBERS),
        StructField("fading", _NUMBERS),
        StructField("weight", DoubleType()),
        StructField("stats", _NUMBERS),  # median and MAD of log sharpness and of brightness
        StructField("lost_since", DoubleType()),
        StructField("origin", DoubleType()),  # of the base in the first reference's places
    ]
)
_OLDER = StructType([StructField("base", _NUMBERS), StructField("origin", DoubleType())])


def moved(a: np.ndarray, by: float) -> np.ndarray:
    f = np.fft.rfftfreq(len(a))
    return np.fft.irfft(np.fft.rfft(a) * np.exp(-2j * np.pi * f * by), len(a))


def scores(a: np.ndarray) -> tuple[float, float]:
    return float(np.log(max(np.diff(a, 2).var(), 1e-12))), float(a.mean())


def _spread(x: np.ndarray) -> tuple[float, float]:
    mid = float(np.median(x))
    return mid, float(np.median(np.abs(x - mid)))


def is_clear(a: np.ndarray, stats) -> bool:
    """Not unusual in sharpness or brightness against the calibration, or unusual by too little to matter."""
    sharp, bright = scores(a)
    zs = (sharp - stats[0]) / max(1.4826 * stats[1], 1e-6)
    zb = (bright - stats[2]) / max(1.4826 * stats[3], 1e-6)
    blurred = zs < -UNUSUAL and np.exp(sharp - stats[0]) < 1 - CHANGE
    return not blurred and not (abs(zb) > UNUSUAL and abs(bright / max(abs(stats[2]), 1e-9) - 1) > CHANGE)


def registered(template: np.ndarray, a: np.ndarray) -> tuple[float, float]:
    """(offset, agreement) of a frame against a template."""
    offset, _ = phase_shift_1d(template, a)
    return offset, ncc(moved(a, -offset), template)


class Stream:
    """One stream's state as numpy; ``step`` takes a frame and tells (offset, registered, state)."""

    def __init__(self, state: tuple | None, older: list[tuple]):
        numbers = lambda x: None if x is None or len(x) == 0 else np.array(x, float)
        self.waiting, self.base, self.fading, self.weight, self.stats, self.lost_since, self.origin = state or ([], None, None, 0.0, None, None, 0.0)
        self.waiting, self.base, self.fading = list(self.waiting or []), numbers(self.base), numbers(self.fading)
        self.stats = None if self.stats is None or not len(self.stats) else list(self.stats)
        self.older = [(np.array(b, float), o) for b, o in older]

    def saved(self) -> tuple:
        plain = lambda x: [] if x is None else [float(v) for v in x]
        return plain(self.waiting), plain(self.base), plain(self.fading), float(self.weight), plain(self.stats), self.lost_since, float(self.origin)

    def template(self) -> np.ndarray:
        """Half the permanent base, half what the last frames show: it follows, but cannot drift away."""
        return self.base if self.weight <= 0 else 0.5 * self.base + 0.5 * self.fading / self.weight

    def reset(self) -> None:
        if self.base is not None:
            self.older = [(self.base, self.origin), *self.older][:REMEMBERED]
        self.waiting, self.base, self.fading, self.weight, self.stats, self.lost_since = [], None, None, 0.0, None, None

    def calibrated(self, n: int) -> str:
        frames = np.array(self.waiting).reshape(-1, n)
        mean = frames[0]
        for _ in range(2):
            mean = np.mean([moved(f, -registered(mean, f)[0]) for f in frames], axis=0)
        s = np.array([scores(f) for f in frames])
        self.stats = [*_spread(s[:, 0]), *_spread(s[:, 1])]
        self.waiting, self.base, self.fading, self.weight, self.origin = [], mean, np.zeros(n), 0.0, 0.0
        for base, origin in self.older:
            offset, agree = registered(base, mean) if len(base) == n else (0.0, 0.0)
            if agree >= SAME:
                self.base, self.origin = base, origin
                self.older = [(b, o) for b, o in self.older if b is not base]
                return "rejoined"
        return "locked"

    def step(self, a: np.ndarray, seconds: float) -> tuple[float | None, bool, str]:
        if not len(a) or not np.isfinite(a).all():
            return None, False, "locking" if self.base is None else "locked"
        if self.base is not None and len(a) != len(self.base):
            self.reset()
        if self.base is None:
            if self.waiting and len(self.waiting) % len(a):
                self.waiting = []
            self.waiting += a.tolist()
            return (None, False, "locking") if len(self.waiting) < LOCK * len(a) else (None, False, self.calibrated(len(a)))
        if not is_clear(a, self.stats):
            return None, False, "locked"  # a blink says nothing
        template = self.template()
        offset, agree = registered(template, a)
        if agree >= MATCH:
            self.lost_since = None
            self.fading, self.weight = self.fading * DECAY + moved(a, -offset), self.weight * DECAY + 1
            return offset + self.origin, True, "locked"
        if self.lost_since is None:
            self.lost_since = seconds
        if seconds - self.lost_since > LOST_AFTER:
            self.reset()
            return None, False, "lost"
        return None, False, "locked"


class Stabilizer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reference", _STATE)
        self.older = handle.getListState("older", _OLDER)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        older = [(r[0], r[1]) for r in self.older.get()]
        stream = Stream(self.state.get() if self.state.exists() else None, older)
        frames = pd.concat(list(rows)).sort_values(["seconds", "index"], kind="stable")
        out = [(key[0], int(i), *stream.step(np.array(v if v is not None else [], float), float(s))) for i, s, v in zip(frames["index"], frames["seconds"], frames["frame"], strict=True)]
        self.state.update(stream.saved())
        if stream.older:
            self.older.put([([float(x) for x in b], float(o)) for b, o in stream.older])
        yield pd.DataFrame(out, columns=["stream", "index", "offset", "registered", "state"])

    def close(self) -> None:
        pass


def stabilize(frames: DataFrame) -> DataFrame:
    """RESULTS of a stream (stream, index, seconds, frame: numbers). Needs the RocksDB state store.

    A frame without numbers, or with gaps, has no result; one of another length sets the stream anew.
    """
    return frames.select("stream", "index", "seconds", "frame").groupBy("stream").transformWithStateInPandas(Stabilizer(), RESULTS, "Append", "None")


class Buffer(StatefulProcessor):
    """At most SLOTS frames of a stream are in flight, each for ``busy`` seconds; what comes when all are taken is dropped and counted."""

    SLOTS = 32

    def __init__(self, busy: float):
        self.busy = busy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flying = handle.getValueState("flying", StructType([StructField("until", _NUMBERS), StructField("dropped", LongType())]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        until, dropped = self.flying.get() if self.flying.exists() else ([], 0)
        until = list(until or [])
        frames = pd.concat(list(rows)).sort_values(["seconds", "index"], kind="stable")
        out = []
        for i, s in zip(frames["index"], frames["seconds"], strict=True):
            until = [u for u in until if u > s]
            taken = len(until) < self.SLOTS
            if taken:
                until.append(float(s) + self.busy)
            else:
                dropped += 1
            out.append((key[0], int(i), taken, int(dropped)))
        self.flying.update(([float(u) for u in until], int(dropped)))
        yield pd.DataFrame(out, columns=["stream", "index", "taken", "dropped"])

    def close(self) -> None:
        pass


def bounded(frames: DataFrame, busy: float) -> DataFrame:
    """stream, index, taken, dropped (so far) of a stream (stream, index, seconds). Needs the RocksDB state store."""
    schema = StructType([StructField("stream", StringType()), StructField("index", LongType()), StructField("taken", BooleanType()), StructField("dropped", LongType())])
    return frames.select("stream", "index", "seconds").groupBy("stream").transformWithStateInPandas(Buffer(busy), schema, "Append", "None")
