import datetime as dt
import json

from pyspark.sql import functions as F

from framequarry.streaming import live, timed

HOUR = 3_600_000_000
SCHEMA = "stream bigint, ts timestamp, us bigint, `index` bigint, kind string"


def row(stream, hours, index, kind):
    us = int(hours * HOUR)
    return (stream, dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us), us, index, kind)


def test_time_undoes_locks(spark, tmp_path):
    """Three files: rows out of order across files, a late one, a relock, a gap between rows, and one that only the watermark shows."""
    files = [
        [row(1, 1, 1, "hit"), row(1, 3, 3, "hit"), row(2, 1, 1, "hit"), row(3, 1.5, 1, "relock"), row(1, 2, 2, "miss")],
        [row(1, 2.5, 9, "relock"), row(1, 9, 4, "hit"), row(2, 4, 2, "miss"), row(3, 12, 2, "hit"), row(None, 12, 2, "hit")],
        [row(1, 9.5, 5, "hit"), row(3, 40, 3, "hit"), row(2, 2, 7, "hit")],  # the last is later than the watermark allows
    ]
    path = f"{tmp_path}/in"
    for k, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    frames = live.replay(spark, path, SCHEMA, 1)
    got = timed.timed_locks(frames, 5 * HOUR, "4 hours")
    q = live.write_idempotent(got, f"{tmp_path}/out", f"{tmp_path}/mark", "timed")
    q.awaitTermination()
    rows = sorted((r.stream, r.at_us / HOUR, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(1, 1, "locked"), (1, 2.5, "relock"), (1, 3, "locked"), (1, 8, "lost"), (1, 9, "locked"), (1, 14.5, "lost"), (2, 1, "locked"), (2, 2, "late"), (2, 6, "lost"), (3, 12, "locked"), (3, 17, "lost")]
    seen = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in q.recentProgress]
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] == 1  # only stream 3 waits: its last row is not due yet


def test_sessions_are_given_once(spark, tmp_path):
    path = f"{tmp_path}/in"
    for f in ([row(1, 1, 1, "hit"), row(1, 2, 2, "hit")], [row(1, 2.5, 3, "hit"), row(1, 9, 4, "hit")], [row(2, 30, 1, "hit")]):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = timed.closed_sessions(live.replay(spark, path, SCHEMA, 1), "stream", "ts", "2 hours", "4 hours")
    live.write_idempotent(got, f"{tmp_path}/out", f"{tmp_path}/mark", "sessions").awaitTermination()
    rows = sorted((r.stream, r.s / HOUR, r.e / HOUR, r.n) for r in spark.read.parquet(f"{tmp_path}/out").select("stream", F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"), "n").collect())
    assert rows == [(1, 1, 4.5, 3), (1, 9, 11, 1)]
