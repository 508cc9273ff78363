"""Weekly report of recordings, kept up to date as frames arrive.

A stream takes the files of ``events`` that it has not seen yet, all that there are, and ends. A recording is what one
user sends in one week (Monday to Sunday). Each batch is stored under its own number; of the weeks that it touches, late
ones too, every recording is summed up again: frames that pass the quality gate, why others do not, and the motion of
those that pass. Weeks that it does not touch are not read.

    OUT/frames/week=.../batch=...   the frames as they arrived
    OUT/report/week=...             a row a recording

A batch that was cut short is repeated by the stream under its number and overwrites what it left, so a report never
depends on how often the job ran or where it stopped. A frame that is sent twice counts once. Frames without a time are
in the week "unknown", in the order of their identifiers.

    python -m jobs.recording_report EVENTS OUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from framequarry.operators.gate import GateParams, gate
from framequarry.operators.motion import motion_metrics

log = logging.getLogger("jobs.recording_report")

CONFIG = os.path.join(os.path.dirname(__file__), "recording_report.json")
DYNAMIC = "partitionOverwriteMode"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, value double"


def load_config(path: str | None = None) -> dict:
    with open(path or CONFIG) as f:
        return json.load(f)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and the number of its rows once it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def frames_of(events: DataFrame) -> DataFrame:
    """event_id, user_id, us, value, y, week of frames: value and y are where the eye looks."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    week = F.coalesce(F.date_format(F.date_trunc("week", F.col("ts")), "yyyy-MM-dd"), F.lit("unknown"))
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return events.select("event_id", "user_id", us.alias("us"), value.alias("value"), (F.col("event_id") % 97).cast("double").alias("y"), week.alias("week"))


def report(frames: DataFrame, config: dict) -> DataFrame:
    """A row a recording (user_id, week) of frames: counts by the gate's reasons, motion of what passes (null under three frames)."""
    one = frames.groupBy("week", "event_id").agg(F.min_by(F.struct("user_id", "us", "value", "y"), "batch").alias("f")).select("week", "event_id", "f.*")
    one = one.withColumn("recording", F.struct(F.col("user_id").isNull().alias("nobody"), F.coalesce("user_id", F.lit(0)).alias("user"), F.col("week").alias("in_week")))
    one = one.withColumn("sharp", F.log(F.col("value") + 1)).withColumn("at", F.struct("us", "event_id")).withColumn("seconds", F.col("us") / 1e6)
    params = GateParams(**{k: config[k] for k in ("sharpness_min_z", "sharpness_min_ratio", "brightness_max_abs_z", "brightness_max_rel_change")})
    judged = gate(one, "recording", "sharp", "value", params)
    counts = judged.groupBy("recording").agg(
        F.first("user_id").alias("user_id"),
        F.first("week").alias("week"),
        F.count(F.lit(1)).alias("frames"),
        F.count_if("keep").alias("kept"),
        F.count_if(F.col("reason").contains("blink")).alias("blurred"),
        F.count_if(F.col("reason").contains("brightness")).alias("lighting"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    moved = motion_metrics(judged.filter("keep and value is not null"), "recording", "at", "seconds", "value", "y", config["mad_k"])
    names = ["displacement_median", "displacement_p95", "speed_median", "jitter_rms"]
    moved = moved.select(F.col("recording").alias("moved"), *[F.round(c, 6).alias(c) for c in names], "saccades")
    return counts.join(moved, counts.recording == moved.moved, "left").drop("recording", "moved")


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new in ``events``; the whole report, as it stands now."""
    config = load_config() if config is None else config
    path = events.rstrip("/")
    # the stream takes a folder, or a pattern that may match one file
    events = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    def batch(new: DataFrame, number: int) -> None:
        here = new.sparkSession
        rows, seen = counted(frames_of(new).withColumn("batch", F.lit(number).cast("long")))
        rows.write.mode("overwrite").option(DYNAMIC, "dynamic").partitionBy("week", "batch").parquet(f"{out}/frames")
        log.info("batch %d: read %d new frames from %s, wrote them to %s/frames", number, seen.get["rows"], events, out)
        if not seen.get["rows"]:
            return
        frames = here.read.schema(frames_schema).parquet(f"{out}/frames")
        touched = frames.filter(F.col("batch") == number).select("week").distinct()
        done, written = counted(report(frames.join(touched, "week", "left_semi"), config))
        done.write.mode("overwrite").option(DYNAMIC, "dynamic").partitionBy("week").parquet(f"{out}/report")
        log.info("batch %d: wrote %d recordings to %s/report", number, written.get["rows"], out)

    # the columns as given, not as guessed from the folders' names; the report is there even if no file ever came
    none = frames_of(spark.createDataFrame([], EVENTS)).withColumn("batch", F.lit(0).cast("long"))
    frames_schema, nothing = none.schema, report(none, config)
    nothing.write.mode("append").partitionBy("week").parquet(f"{out}/report")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(events)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(nothing.schema).parquet(f"{out}/report")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.recording_report", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("events")
    p.add_argument("out")
    p.add_argument("checkpoint")
    p.add_argument("--config")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("recording_report").getOrCreate()
    try:
        run(spark, a.events, a.out, a.checkpoint, load_config(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
