"""Queries on streams, run to their end over the whole table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.lineage import cut, shared_folder
from ..operators import velocity
from ..streaming import live, stabilizer, timed
from .registry import EVENTS, query, table
from .series import _kymograph
from .table_frames import live_signals


def _stream(spark, sf_dir) -> DataFrame:
    """Events as a stream of files; the name is a pattern, so a file and a folder of files both serve."""
    schema = table(spark, sf_dir, "events").schema
    return live.replay(spark, f"{sf_dir}/event[s].parquet", schema, 8).withColumn("ts", F.col("ts").cast("timestamp"))


def _all(df: DataFrame, mode: str, state: bool = False) -> DataFrame:
    """What a stream gives when its source is read to the end: batches and checkpoint are in the shared folder.

    In mode "complete" each batch has all rows, so the last one counts. ``state``: keep state in RocksDB.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/fq-stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if state:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live.write_idempotent(df, f"{root}/out", f"{root}/checkpoint", "rows", mode).awaitTermination()
    finally:
        if state and before:
            spark.conf.set(key, before)
        elif state:
            spark.conf.unset(key)
    out = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).option("recursiveFileLookup", "false").parquet(f"{root}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    return out.drop("batch")


@query(f"""with {EVENTS}, g as (select user_id, us, case when us - lag(us) over w >= 21600000000 then 1 else 0 end as new from e window w as (partition by user_id order by us)),
 s as (select user_id, us, sum(new) over (partition by user_id order by us rows unbounded preceding) as session from g)
 select user_id, min(us) as start_us, max(us) + 21600000000 as end_us, count(*) as n from s group by user_id, session""")
def session_gap_stream(spark, sf_dir):
    """Sessions of a stream, closed by a gap of six hours."""
    s = _all(live.sessions(_stream(spark, sf_dir), "user_id", "ts", "6 hours", "60 days"), "complete")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"""with {EVENTS} select user_id, (us // 1000000) * 1000000 as second_us, count(*) as fps from e group by 1, 2""")
def rate_stream(spark, sf_dir):
    """Frames a second of a stream."""
    r = _all(live.rate_per_second(_stream(spark, sf_dir), "user_id", "ts", "60 days"), "complete")
    return r.select("user_id", F.unix_micros("second").alias("second_us"), "fps")


_FADE = """s0 as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events),
 f(user_id, k, event_id, seen, total, anchor, ref, misses, off, hit, state) as (
  select user_id, k - 1, cast(-1 as bigint), 0, 0.0::double, 0.0::double, 0.0::double, 0, null::double, false, '' from s0 where k = 1
  union all
  select f.user_id, s0.k, s0.event_id,
   case when f.seen < 24 then f.seen + 1 when abs(value / greatest(abs(ref), 1e-9) - 1) > 0.5 and misses + 1 >= 8 then 0 else f.seen end,
   case when f.seen < 24 then f.total + value when abs(value / greatest(abs(ref), 1e-9) - 1) > 0.5 and misses + 1 >= 8 then 0.0 else f.total end,
   case when f.seen = 23 then (f.total + value) / 24 else anchor end,
   case when f.seen = 23 then (f.total + value) / 24 when f.seen >= 24 and abs(value / greatest(abs(ref), 1e-9) - 1) <= 0.5 then 0.9 * ref + 0.1 * (0.5 * anchor + 0.5 * value) else ref end,
   case when f.seen < 24 then misses when abs(value / greatest(abs(ref), 1e-9) - 1) <= 0.5 then 0 when misses + 1 >= 8 then 0 else misses + 1 end,
   case when f.seen >= 24 and abs(value / greatest(abs(ref), 1e-9) - 1) <= 0.5 then value - (0.9 * ref + 0.1 * (0.5 * anchor + 0.5 * value)) end,
   f.seen >= 24 and abs(value / greatest(abs(ref), 1e-9) - 1) <= 0.5,
   case when f.seen < 24 then 'locking' when abs(value / greatest(abs(ref), 1e-9) - 1) > 0.5 and misses + 1 >= 8 then 'lost' else 'locked' end
  from f join s0 on s0.user_id = f.user_id and s0.k = f.k + 1)"""


@query(f"with recursive {_FADE} select cast(user_id as varchar) as stream, event_id as \"index\", round(off, 3) + 0.0 as \"offset\", hit as registered, state from f where event_id >= 0")
def anchored_fade_stream(spark, sf_dir):
    """Each stream's offsets from a running reference, with lock and loss."""
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("index"), F.col("value"))
    got = _all(live.anchored_fade(e), "append")
    return got.withColumn("offset", F.round("offset", 3) + F.lit(0.0))


@query()
def kymograph_velocity(spark, sf_dir):
    """Velocity by three estimators that must agree."""
    return velocity.velocities(_kymograph(spark, sf_dir))


@query()
def live_stabilizer(spark, sf_dir):
    """Streams that lock, register, pass over blinks, lose a scene after a second and rejoin it."""
    root = f"{shared_folder(spark)}/fq-frames-{uuid.uuid4().hex}"
    drawn = cut(live_signals(spark, sf_dir))
    span = (drawn.agg(F.max("index")).first()[0] or 0) // 5 + 1
    for k in range(5):  # as cameras write: files have a fifth of the time each, and come in the order of time
        drawn.filter(f"index div {span} = {k}").repartition(4, "stream").write.mode("append").parquet(root)
    frames = live.replay(spark, root, "stream string, `index` bigint, seconds double, frame array<double>, truth double", 4)
    out = _all(stabilizer.stabilize(frames), "append", state=True)
    return out.withColumn("offset", F.round("offset", 2))


@query(f"""with recursive {EVENTS}, s0 as (select user_id, event_id, us / 1e6 as tm, row_number() over (partition by user_id order by us, event_id) as k from e),
 f(user_id, k, event_id, ends, taken, dropped) as (select user_id, k - 1, cast(-1 as bigint), []::double[], false, 0 from s0 where k = 1
  union all select f.user_id, s0.k, s0.event_id, case when len(list_filter(ends, lambda u: u > tm)) < 32 then list_append(list_filter(ends, lambda u: u > tm), tm + 1500000) else list_filter(ends, lambda u: u > tm) end,
   len(list_filter(ends, lambda u: u > tm)) < 32, dropped + case when len(list_filter(ends, lambda u: u > tm)) < 32 then 0 else 1 end from f join s0 on s0.user_id = f.user_id and s0.k = f.k + 1)
 select cast(user_id as varchar) as stream, event_id as "index", taken, cast(dropped as bigint) as dropped from f where event_id >= 0""")
def bounded_buffer(spark, sf_dir):
    """At most 32 frames of a stream in flight; what comes when all slots are taken is dropped and counted."""
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("index"), (F.unix_micros("ts") / 1e6).alias("seconds"))
    return _all(stabilizer.bounded(e, 1_500_000.0), "append", state=True)


@query(f"""with {EVENTS} select event_id, case when value >= 10 then 'writer+live' when event_type = 'view' then 'live' else 'preview' end as sinks, event_id % 4 = 0 as previewed from e""")
def fan_out(spark, sf_dir):
    """One source to several sinks in one pass over each batch: all frames written, those for live use and every fourth for preview."""
    e = _stream(spark, sf_dir)
    sinks = F.when(F.col("value") >= 10, "writer+live").when(F.col("event_type") == "view", "live").otherwise("preview")
    return _all(e.select("event_id", sinks.alias("sinks"), (F.col("event_id") % 4 == 0).alias("previewed")), "append")


@query(f"""with {EVENTS}, r as (select event_id, us, value from e where event_type = 'click') select p.event_id, max(r.event_id) as result from e p join r on r.us <= p.us and r.us > p.us - 60000000 where p.event_type = 'view' group by 1""")
def matched_results(spark, sf_dir):
    """Previews and results of two streams joined within a minute, the newest result for each."""
    e = _stream(spark, sf_dir).withWatermark("ts", "60 days")
    p = e.filter("event_type = 'view'").select("event_id", F.col("ts").alias("seen"))
    r = e.filter("event_type = 'click'").select(F.col("event_id").alias("result"), F.col("ts").alias("made"))
    # both sides also by the minute, so the join has a key and its state stays in parts
    minute = lambda c: F.floor(F.unix_micros(c) / 60_000_000)
    r = r.withColumn("cell", F.explode(F.array(minute("made"), minute("made") + 1)))
    p = p.withColumn("cell", minute("seen"))
    j = p.join(r, (p.cell == r.cell) & (F.col("made") <= F.col("seen")) & (F.col("made") > F.col("seen") - F.expr("interval 1 minute")))
    return _all(j.select("event_id", "result"), "append").groupBy("event_id").agg(F.max("result").alias("result"))


#: The watermark at the end of a stream: a delay of two days before its last row, in whole milliseconds.
_MARK = "w as (select ((max(us) - 172800000000) // 1000) * 1000 as mark from e)"


@query(f"""with {EVENTS}, {_MARK}, r as (select user_id, event_id, us, case when event_type = 'signup' then 'relock' else 'hit' end as kind, mark from e, w where event_type <> 'error' and us < mark),
 n as (select *, lag(kind) over v as before, lag(us) over v as before_us, lead(us) over v as after_us from r window v as (partition by user_id order by us, event_id))
 select user_id as stream, us as at_us, 'locked' as change from n where kind = 'hit' and (before is null or before = 'relock' or us - before_us > 21600000000)
 union all select user_id, us + 21600000000, 'lost' from n where kind = 'hit' and us + 21600000000 < coalesce(after_us, mark)
 union all select user_id, us, 'relock' from n where kind = 'relock' and before = 'hit' and us - before_us <= 21600000000""")
def timed_locks_stream(spark, sf_dir):
    """Streams that lock at a hit, are lost six hours of event time after the last one, and are told to lock anew in band."""
    kind = F.when(F.col("event_type") == "signup", "relock").when(F.col("event_type") == "error", "miss").otherwise("hit")
    e = _stream(spark, sf_dir).select(F.col("user_id").alias("stream"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("index"), kind.alias("kind"))
    return _all(timed.timed_locks(e, 21_600_000_000, "2 days"), "append")


@query(f"""with {EVENTS}, {_MARK}, g as (select user_id, us, case when us - lag(us) over x >= 21600000000 then 1 else 0 end as new from e window x as (partition by user_id order by us)),
 s as (select user_id, us, sum(new) over (partition by user_id order by us rows unbounded preceding) as session from g)
 select user_id, min(us) as start_us, max(us) + 21600000000 as end_us, count(*) as n from s group by user_id, session having max(us) + 21600000000 <= (select mark from w)""")
def closed_session_stream(spark, sf_dir):
    """Sessions of a stream, each given once when the watermark has passed it; nothing is rewritten."""
    s = _all(timed.closed_sessions(_stream(spark, sf_dir), "user_id", "ts", "6 hours", "2 days"), "append")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
