"""Queries on incremental execution: what to do, what failed, what may be written, and what a manifest promises."""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import functions as F

from .. import config
from ..functions.lineage import cut
from .registry import EVENTS, events, query, table


@query("""select user_id, case when count(*) < 60 then 'error' else 'ok' end as status, case when count(*) < 60 then 'ValueError: only ' || count(*) || ' frames' end as message, case when count(*) >= 60 then round(avg(value), 6) end as score from events group by 1""")
def isolated_errors(spark, sf_dir):
    """A recording that fails becomes an error record; the others go on (Q2, Q4)."""

    def one(table: pa.Table) -> float:
        if table.num_rows < 60:
            raise ValueError(f"only {table.num_rows} frames")
        return float(sum(table.column("value").to_pylist()) / table.num_rows)

    def run(table: pa.Table) -> pa.Table:
        try:
            got = ("ok", None, one(table))
        except Exception as error:  # noqa: BLE001 - whatever a recording does to its method
            got = ("error", f"{type(error).__name__}: {error}", None)
        return pa.table({"user_id": pa.array([table.column("user_id")[0].as_py()], pa.int64()), "status": pa.array([got[0]]), "message": pa.array([got[1]], pa.string()), "score": pa.array([got[2]], pa.float64())})

    return events(spark, sf_dir).select("user_id", "value").groupBy("user_id").applyInArrow(run, "user_id long, status string, message string, score double").withColumn("score", F.round("score", 6))


@query("""with j as (select user_id, '/data/u' || user_id as source, case when user_id % 3 = 0 then '/data/u' || user_id || '/out' when user_id % 3 = 1 then '/data/u' || user_id || '2' else '/results' end as target from (select distinct user_id from events))
 select user_id, target = source or starts_with(target, source || '/') as inside from j""")
def output_guard(spark, sf_dir):
    """Whether a result would be written into its input (Q5)."""
    users = events(spark, sf_dir).select("user_id").distinct()
    source = F.concat(F.lit("/data/u"), F.col("user_id").cast("string"))
    target = F.when(F.col("user_id") % 3 == 0, F.concat(source, F.lit("/out"))).when(F.col("user_id") % 3 == 1, F.concat(source, F.lit("2"))).otherwise("/results")
    return users.select("user_id", ((target == source) | F.startswith(target, F.concat(source, F.lit("/")))).alias("inside"))


@query("""with m as (select o_orderkey, case when o_orderkey % 7 <> 0 then 'burst_' || o_custkey end as burst, case when o_orderkey % 5 = 0 then -1 else cast(o_totalprice as bigint) end as bytes, case when o_orderkey % 11 = 0 then 'abc' else sha256(cast(o_orderkey as varchar)) end as sha from orders)
 select o_orderkey, concat_ws('; ', case when burst is null then 'no burst' end, case when bytes < 0 then 'bad size' end, case when not regexp_full_match(sha, '[0-9a-f]{64}') then 'bad digest' end) as problems from m""")
def manifest_rules(spark, sf_dir):
    """A manifest's records against a table of rules (Q6)."""
    o = F.col("o_orderkey")
    record = F.struct(F.when(o % 7 != 0, F.concat(F.lit("burst_"), F.col("o_custkey").cast("string"))).alias("burst"), F.when(o % 5 == 0, F.lit(-1)).otherwise(F.round("o_totalprice").cast("long")).alias("bytes"), F.when(o % 11 == 0, "abc").otherwise(F.sha2(o.cast("string"), 256)).alias("sha"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(record).alias("j"))
    m = raw.select("o_orderkey", F.from_json("j", "burst string, bytes bigint, sha string").alias("m")).select("o_orderkey", "m.*")
    rules = {"no burst": F.col("burst").isNull(), "bad size": F.coalesce(F.col("bytes") < 0, F.lit(True)), "bad digest": ~F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False))}
    return m.select("o_orderkey", F.concat_ws("; ", *[F.when(bad, name) for name, bad in rules.items()]).alias("problems"))


@query(f"""with {EVENTS}, a as (select user_id, count(*) as frames, max(us) // 1000000 - min(us) // 1000000 as seconds from e group by 1), x as (select user_id, frames as want, 2000000 as longest from a where user_id % 2 = 0)
 select user_id, 'frames' as field, cast(frames as varchar) as actual, cast(want + user_id % 3 as varchar) as expected from a join x using (user_id) where frames <> want + user_id % 3 union all select user_id, 'seconds', cast(seconds as varchar), '<= ' || longest from a join x using (user_id) where seconds > longest""")
def metadata_warnings(spark, sf_dir):
    """Recorded values that differ from what is expected of them (Q7)."""
    a = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), (F.floor(F.max("us") / 1000000) - F.floor(F.min("us") / 1000000)).alias("seconds"))
    x = a.filter("user_id % 2 = 0").select("user_id", (F.col("frames") + F.col("user_id") % 3).alias("want"))
    j = a.join(x, "user_id")
    found = F.array(F.struct(F.lit("frames").alias("field"), F.col("frames").cast("string").alias("actual"), F.col("want").cast("string").alias("expected"), (F.col("frames") != F.col("want")).alias("bad")), F.struct(F.lit("seconds").alias("field"), F.col("seconds").cast("string").alias("actual"), F.lit("<= 2000000").alias("expected"), (F.col("seconds") > 2_000_000).alias("bad")))
    return j.select("user_id", F.explode(F.filter(found, lambda r: r["bad"])).alias("w")).select("user_id", "w.field", "w.actual", "w.expected")


@query("""with p as (select * from (values ('flow', '{"least_length": 20, "least_peak": 0.08, "most_lag": 12, "most_shift": 40'), ('links', '{"most_turn": 60.0, "most_width_ratio": 2.5, "reach": 12.0'), ('nonrigid', '{"most_rounds": 6, "patch": 64, "stride": 32, "tolerance": 0.02'), ('translation', '{"height": 600, "least_ncc": 0.5, "most_rounds": 5, "tolerance": 0.05')) as t(method, head)),
 u as (select user_id, count(*) as n from events group by 1), k as (select user_id, method, head || ', "frames": ' || n || '}' as params from u, p) select user_id, method, params, sha256(params)[1:12] as params_hash from k""")
def method_parameters(spark, sf_dir):
    """Every method's tunables for each recording, with its frames, and the fingerprint that a result is kept under."""
    import json

    heads = F.array(*[F.struct(F.lit(name).alias("method"), F.lit(json.dumps(asdict(p), sort_keys=True)[:-1]).alias("head")) for name, p in config.METHODS.items()])
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k = u.select("user_id", "n", F.inline(heads)).select("user_id", "method", F.concat("head", F.lit(', "frames": '), F.col("n").cast("string"), F.lit("}")).alias("params"))
    return k.withColumn("params_hash", F.substring(F.sha2("params", 256), 1, 12))


@query("""with r as (select user_id, case when user_id % 4 = 0 then 'old' else 'new' end as hash, case when user_id % 6 = 1 then 'error' else 'ok' end as status from (select distinct user_id from events where user_id % 5 <> 2)),
 u as (select distinct user_id from events) select u.user_id, case when r.user_id is null then 'missing' when status <> 'ok' then 'failed' when hash <> 'new' then 'parameters' else 'current' end as state, r.user_id is null or status <> 'ok' or hash <> 'new' as todo from u left join r on r.user_id = u.user_id""")
def resume_state(spark, sf_dir):
    """What is still to do when a run is resumed, and why."""
    u = events(spark, sf_dir).select("user_id").distinct()
    r = cut(u.filter("user_id % 5 <> 2").select("user_id", F.when(F.col("user_id") % 4 == 0, "old").otherwise("new").alias("hash"), F.when(F.col("user_id") % 6 == 1, "error").otherwise("ok").alias("status")))
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "ok", "failed").when(F.col("hash") != "new", "parameters").otherwise("current")
    return u.join(r, "user_id", "left").select("user_id", state.alias("state"), (state != "current").alias("todo"))


@query("select event_type as stage, count(*) as rows_seen, round(max(value), 6) as largest from events group by 1")
def stage_metrics(spark, sf_dir):
    """Numbers of a stage as it runs, observed in the plan instead of by a second pass."""
    import uuid

    from pyspark.sql import Observation

    e = cut(events(spark, sf_dir).select("event_type", "value"))
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # stages are few
    watch = Observation(f"stages-{uuid.uuid4().hex}")
    of = lambda kind, c: F.when(F.col("event_type") == kind, c)
    seen = [m for k, kind in enumerate(kinds) for m in (F.count(of(kind, F.lit(1))).alias(f"n{k}"), F.max(of(kind, F.col("value"))).alias(f"m{k}"))]
    if seen:
        e.observe(watch, *seen).write.format("noop").mode("overwrite").save()
    rows = [(kind, watch.get[f"n{k}"], round(watch.get[f"m{k}"], 6)) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "stage string, rows_seen long, largest double")


_CONTROLS = "select event_id, event_type || ' 0x0098' || lpad(cast(event_id % 10000 as varchar), 4, '0') || ' (int)    : min=0 max=' || (event_id % 256) || ' step=1 default=' || cast(floor(value) as bigint) || ' value=' || (event_id % 7) as line from events"


@query(f"with l as ({_CONTROLS}) select event_id, regexp_extract(line, '^(\\w+)', 1) as name, regexp_extract(line, '\\((\\w+)\\)', 1) as kind, cast(regexp_extract(line, 'max=(-?\\d+)', 1) as bigint) as most, cast(regexp_extract(line, 'default=(-?\\d+)', 1) as bigint) as usual, cast(regexp_extract(line, 'value=(-?\\d+)', 1) as bigint) as value from l".replace("\\\\", "\\"))
def control_text(spark, sf_dir):
    """Lines of a camera tool's text as maps of settings."""
    n = F.col("event_id")
    line = F.concat("event_type", F.lit(" 0x0098"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(" (int)    : min=0 max="), (n % 256).cast("string"), F.lit(" step=1 default="), F.floor("value").cast("string"), F.lit(" value="), (n % 7).cast("string"))
    settings = F.map_from_entries(F.transform(F.regexp_extract_all(line, F.lit(r"(\w+=-?\d+)"), F.lit(1)), lambda p: F.struct(F.element_at(F.split(p, "="), 1).alias("k"), F.element_at(F.split(p, "="), 2).cast("long").alias("v"))))
    e = table(spark, sf_dir, "events").select("event_id", line.alias("line"), settings.alias("m"))
    return e.select("event_id", F.regexp_extract("line", r"^(\w+)", 1).alias("name"), F.regexp_extract("line", r"\((\w+)\)", 1).alias("kind"), F.col("m")["max"].alias("most"), F.col("m")["default"].alias("usual"), F.col("m")["value"].alias("value"))


@query("""with d as (select lang, sum(coalesce(octet_length(encode(text)), 0)) as b from documents group by 1) select lang, t.task, cast(b as bigint) as needed, t.task = 'once' as fits from d, (values ('once'), ('far too often')) t(task)""")
def space_precondition(spark, sf_dir):
    """Whether the shared folder has the room for the texts of a language, once and 10^15 times, before anything is written."""
    from ..functions.lineage import shared_folder
    from ..sources import results

    root = shared_folder(spark)
    cut(spark.range(1))  # the folder exists
    left = results.space_left(spark, root)
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("needed"))
    tasks = F.array(*[F.struct(F.lit(n).alias("task"), F.lit(x).alias("times")) for n, x in (("once", 1.0), ("far too often", 1e15))])
    return d.select("lang", "needed", F.inline(tasks)).select("lang", "task", "needed", (F.col("needed") * F.col("times") <= left).alias("fits"))


@query("""with c as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from events), k as (select c.*, g.k, greatest(0, 1 - abs(pos * 4.0::double / greatest(n - 1, 1) - g.k)) as w from c, range(0, 5) g(k))
 select user_id, k as knot, round(sum(w * value) / sum(w), 6) as width from k where w > 0 group by 1, 2""")
def edge_refit(spark, sf_dir):
    """The width of each edge at five knots along it, every sample shared by the two next to it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    c = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(w.orderBy("event_id")) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    at = F.col("pos") * 4.0 / F.greatest(F.col("n") - 1, F.lit(1))
    c = c.withColumn("at", at).withColumn("k", F.explode(F.array(F.floor("at"), F.floor("at") + 1))).withColumn("w", 1 - F.abs(F.col("at") - F.col("k"))).filter("w > 0 and k < 5")
    return c.groupBy("user_id", F.col("k").alias("knot")).agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("width"))


@query("""select cast(user_id as varchar) as client, count(*) as received, 'stopped' as state from events group by 1""")
def client_lifecycle(spark, sf_dir):
    """A stream that is started, drained and stopped, with what its client received."""
    from ..streaming import live
    from .live import _stream

    import uuid

    from ..functions.lineage import shared_folder

    root = f"{shared_folder(spark)}/fq-client-{uuid.uuid4().hex}"
    query_ = live.write_idempotent(_stream(spark, sf_dir).select("user_id", "event_id"), f"{root}/out", f"{root}/checkpoint", "client")
    query_.awaitTermination()
    state = "stopped" if not query_.isActive and query_.exception() is None else "failed"
    got = spark.read.parquet(f"{root}/out")
    return got.groupBy(F.col("user_id").cast("string").alias("client")).agg(F.count(F.lit(1)).alias("received")).withColumn("state", F.lit(state))
