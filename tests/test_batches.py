import numpy as np
import pyarrow as pa

from framequarry.functions.batches import ROWS, small
from framequarry.operators import registration
from framequarry.plans import recordings


def test_small_pieces_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64())], names=["x"]) for a, b in ((0, 300), (300, 300), (300, 301))]
    pieces = list(small(batches))
    assert max(p.num_rows for p in pieces) <= ROWS
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(301))
    assert sum(p.num_rows == 0 for p in pieces) == 1


def test_frames_are_matched_in_small_pieces():
    """Of a batch of Spark's, few frames and results are Python objects at once."""
    a = np.random.default_rng(1).integers(0, 4095, (8, 8)).astype("<u2")
    n = 2 * ROWS + 5
    columns = [["b"] * n, list(range(n)), [8] * n, [8] * n, [12] * n, [a.tobytes()] * n, [(a / 4095.0).astype("<f8").tobytes()] * n]
    got = list(registration._match([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefg"))]))
    assert [b.num_rows for b in got] == [ROWS, ROWS, 5]
    assert [x for b in got for x in b.column(1).to_pylist()] == list(range(n))


def test_no_window_sees_pictures(spark, sf):
    """consecutive_steps: a recording is one task of a window, so no pictures go there."""
    plan = recordings.consecutive_steps(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Window" in line for line in plan)
    assert not any("Window" in line and "pixels" in line for line in plan)
