"""Arrow batches in small pieces: what a task holds as Python objects does not grow with Spark's batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a piece: pictures of the tables take some ten kilobytes each.
ROWS = 128


def small(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, at most so many at once; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)
