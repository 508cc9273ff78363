"""Segmenters as plug-ins: a registry, and a table function that runs one on each frame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import small
from .kernels import vesselness

Segmenter = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Entry:
    ident: str
    label: str
    run: Segmenter
    folder_rank: int = 0


class Registry:
    """First folder wins by identifier; listing is by label."""

    def __init__(self):
        self._entries: dict[str, Entry] = {}

    def add(self, entry: Entry) -> bool:
        old = self._entries.get(entry.ident)
        if old and old.folder_rank <= entry.folder_rank:
            return False
        self._entries[entry.ident] = entry
        return True

    def listed(self) -> list[Entry]:
        return sorted(self._entries.values(), key=lambda e: (e.label, e.ident))

    def __getitem__(self, ident: str) -> Entry:
        return self._entries[ident]


def source_hash(text: str) -> str:
    """Fingerprint of a plug-in's source, the same for all line ends."""
    return hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()[:12]


def default_registry() -> Registry:
    out = Registry()
    out.add(Entry("ridges", "Ridges", lambda a: vesselness(a, (1.5, 3.0)) > 0.2))
    out.add(Entry("dark", "Dark pixels", lambda a: a < np.median(a) - 1.5 * a.std()))
    return out


def segment(frames: DataFrame, registry: Registry, ident: str) -> DataFrame:
    """burst, index, segmenter, area, mask (a bit a pixel, row by row); null where pixels do not fit."""
    run_one = registry[ident].run

    def run(batches):
        for batch in small(batches):
            rows = []
            for h, w, bits, raw in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if raw is None or not h or not w or len(raw) != h * w * (2 if bits > 8 else 1):
                    rows.append((None, None))
                    continue
                mask = run_one(np.frombuffer(raw, "<u2" if bits > 8 else np.uint8).reshape(h, w) / float((1 << bits) - 1))
                rows.append((int(mask.sum()), np.packbits(mask).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([ident] * batch.num_rows), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["burst", "index", "segmenter", "area", "mask"])

    return frames.select("burst", "index", "height", "width", "bit_depth", "pixels").mapInArrow(run, "burst string, `index` int, segmenter string, area bigint, mask binary")
