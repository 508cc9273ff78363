import datetime as dt
import logging
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries as Q
from jobs import recording_report, text_release

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def by_sql(name, tables):
    db = duckdb.connect()
    for t, path in tables.items():
        db.execute(f"create view {t} as select * from read_parquet('{path}')")
    got = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    return columns, plain(got.fetchall())


def test_report_of_growing_recordings(spark, sf, tmp_path, caplog):
    """Two runs over growing files: the second takes only what is new, late frames too, and gives what one run over all gives."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    late = F.col("event_id") % 10 == 3
    first, second = events.filter(~late & (F.col("ts") < "2024-01-17")), events.filter(late | (F.col("ts") >= "2024-01-17"))
    path, out, mark = (f"{tmp_path}/{x}" for x in ("events", "out", "mark"))
    first.write.parquet(path)
    with caplog.at_level(logging.INFO, "jobs.recording_report"):
        one = recording_report.run(spark, path, out, mark)
        assert one.agg(F.sum("frames")).first()[0] == first.count()
        second.write.mode("append").parquet(path)
        two = recording_report.run(spark, path, out, mark)
        assert f"read {second.count()} new frames" in caplog.text
        caplog.clear()
        three = recording_report.run(spark, path, out, mark)
        assert "read" not in caplog.text
    columns, want = by_sql("job1_recording_report", {"events": f"{sf}/events.parquet"})
    assert plain(two.select(columns).collect()) == plain(three.select(columns).collect()) == want


def test_batch_cut_short_is_repeated(spark, sf, tmp_path, monkeypatch):
    """A batch that fails between its frames and its report leaves nothing wrong behind."""
    path, out, mark = f"{sf}/events.parquet", f"{tmp_path}/out", f"{tmp_path}/mark"
    whole, calls = recording_report.report, []

    def broken(frames, config):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("power cut")
        return whole(frames, config)

    monkeypatch.setattr(recording_report, "report", broken)
    with pytest.raises(Exception, match="power cut"):
        recording_report.run(spark, path, out, mark)
    monkeypatch.setattr(recording_report, "report", whole)
    columns, want = by_sql("job1_recording_report", {"events": path})
    assert plain(recording_report.run(spark, path, out, mark).select(columns).collect()) == want


def test_report_of_awkward_frames(spark, tmp_path):
    """Nothing at all, then frames without time, user or value, sent twice, and extra columns."""
    path, out, mark = (f"{tmp_path}/{x}" for x in ("events", "out", "mark"))
    schema = "event_id long, ts timestamp_ntz, user_id long, value double, week string, batch long"
    day = dt.datetime(2024, 1, 3)
    rows = [(k, day + dt.timedelta(seconds=k), 1, float(k % 3), "x", 9) for k in range(5)] + [(7, None, 1, 1.0, "x", 9), (8, day, None, None, "x", 9), (9, None, None, float("nan"), None, None)]
    spark.createDataFrame([], schema).write.parquet(path)
    assert recording_report.run(spark, path, out, mark).collect() == []
    for _ in range(2):  # the same frames in two files
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        got = recording_report.run(spark, path, out, mark).select("week", "user_id", "frames", "kept").collect()
        assert sorted(map(tuple, got), key=str) == sorted([("2024-01-01", 1, 5, 5), ("unknown", 1, 1, 1), ("2024-01-01", None, 1, 1), ("unknown", None, 1, 1)], key=str)


TABLES = {"documents": "doc_id long, source string, text string, part string", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}


def put(spark, folder, documents, pages=(), conversations=()):
    for name, rows in zip(TABLES, (documents, pages, conversations), strict=True):
        spark.createDataFrame(list(rows), TABLES[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def files(out):
    return {p: sorted(f for f in names if f.endswith(".parquet")) for p, _, names in os.walk(f"{out}/texts") if "part=" in p}


def test_release_follows_its_tables(spark, tmp_path, caplog):
    tables, out = f"{tmp_path}/tables", f"{tmp_path}/out"
    docs = [(k, f"s{k % 3}", f"text {k % 4}", "x") for k in range(12)] + [(20, None, None, "x"), (20, "", "", "x"), (21, "a/b =c", "é", "x"), (None, "s0", "one", None)]
    put(spark, tables, docs, [(1, "http://h/en/1", "<p>"), (2, "no address", None)], [(1, 1, "user", "hi"), (1, 2, "user", "hi")])
    with caplog.at_level(logging.INFO, "jobs.text_release"):
        got = {(r.kind, r.part): r for r in text_release.run(spark, tables, out).collect()}
        assert set(got) == {("documents", x) for x in ("s0", "s1", "s2", "none", "a/b =c")} | {("pages", "en"), ("pages", "none"), ("conversations", "user")}
        none = got["documents", "none"]
        assert (none.texts, none.copies, none.bytes, none.longest) == (2, 1, 0, 0) and got["conversations", "user"].copies == 1
        before = files(out)
        docs[0] = (0, "s0", "another text", "x")
        put(spark, tables, [d for d in docs if d[1] != "s1"] + [(99, "s9", "new", "x")], [(1, "http://h/en/1", "<p>"), (2, "no address", None)], [(1, 1, "user", "hi"), (1, 2, "user", "hi")])
        caplog.clear()
        again = text_release.run(spark, tables, out)
        assert "parts: 1 changed, 6 current, 1 gone, 1 new" in caplog.text
    after = files(out)
    assert {p for p in after if after[p] != before.get(p)} == {f"{out}/texts/kind=documents/part=s0", f"{out}/texts/kind=documents/part=s9"}
    fresh = text_release.run(spark, tables, f"{tmp_path}/fresh")
    assert plain(again.collect()) == plain(fresh.collect())
    texts = lambda where: plain(text_release.released(spark, where).select("kind", "part", "ident", "text").collect())
    assert texts(out) == texts(f"{tmp_path}/fresh") and not any(t[1] == "s1" for t in texts(out))
    # a part that someone changed is found when all parts are read back, and the manifest stays
    spark.createDataFrame([("x", "not released", 1, "")], "ident string, text string, bytes long, sha256 string").write.mode("append").parquet(f"{out}/texts/kind=documents/part=s9")
    with pytest.raises(RuntimeError, match="documents/s9: size"):
        text_release.run(spark, tables, out, text_release.load_config() | {"verify_all": True})
    assert plain(text_release.run(spark, tables, out).collect()) == plain(fresh.collect())


def test_release_of_nothing(spark, tmp_path):
    put(spark, f"{tmp_path}/tables", [])
    for _ in range(2):
        assert text_release.run(spark, f"{tmp_path}/tables", f"{tmp_path}/out").collect() == []


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_registered_jobs_agree_with_sql(spark, sf, name):
    overwrite = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    columns, want = by_sql(name, {t: f"{sf}/{t}.parquet" for t in ("events", "documents", "pages", "conversations")})
    got = Q.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns) and plain(got.select(columns).collect()) == want
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == overwrite


@pytest.mark.parametrize("job,paths", [("recording_report", ["events.parquet"]), ("text_release", [""])])
def test_command_line(spark, sf, tmp_path, job, paths):
    args = [f"{sf}/{p}" for p in paths] + [f"{tmp_path}/out"] + ([f"{tmp_path}/mark"] if job == "recording_report" else [])
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--config", f"{ROOT}/jobs/{job}.json"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/{'report' if job == 'recording_report' else 'parts'}").count() > 0
