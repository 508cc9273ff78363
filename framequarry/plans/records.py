"""Queries on manifests, results and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import integrity, ranks
from .registry import EVENTS, events, query, table


@query("""with m as (select doc_id, octet_length(encode(text)) as bytes, sha256(case when doc_id % 11 = 0 then text || '!' else text end) as sha from documents where doc_id % 7 <> 3),
 f as (select doc_id, octet_length(encode(text)) + case when doc_id % 13 = 0 then 1 else 0 end as bytes, sha256(text) as sha from documents where doc_id % 5 <> 1)
 select coalesce(m.doc_id, f.doc_id) as doc_id, case when f.doc_id is null then 'missing' when m.doc_id is null then 'unexpected' when m.bytes <> f.bytes then 'size' else 'hash' end as problem
 from m full outer join f on m.doc_id = f.doc_id where f.doc_id is null or m.doc_id is null or m.bytes <> f.bytes or m.sha <> f.sha""")
def manifest_verify(spark, sf_dir):
    """A manifest against the files that are there: missing, unexpected, wrong size, wrong hash."""
    d = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    m = d.filter("doc_id % 7 <> 3").select("doc_id", size.alias("bytes"), F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    f = d.filter("doc_id % 5 <> 1").select("doc_id", (size + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return integrity.verify(m, f, "doc_id")


@query("select host, count(*) as n from (select regexp_extract(url, '^https?://([^/]+)', 1) as host from pages) group by 1 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Names that occur more than once."""
    return integrity.duplicates(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")), "host")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id, role order by turn, text) as n from conversations) where n = 1")
def first_wins(spark, sf_dir):
    """The first of each key in order of precedence."""
    c = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "role"))
    return integrity.first_wins(c, "key", "turn", "text").select("conv_id", "turn", "role")


@query("""with results as (select o_orderkey as k, o_orderstatus as status, o_orderpriority as hash, o_orderdate as mtime from orders)
 select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '5-LOW' and o_orderdate >= timestamp '1996-01-01')""")
def anti_join_current(spark, sf_dir):
    """Sources without a current result."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("1996-01-01").cast("timestamp_ntz").alias("mtime"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "ok").alias("status"), F.lit("v1").alias("version"), F.col("o_orderpriority").alias("params_hash"), F.col("o_orderdate").alias("mtime"))
    return integrity.stale(c, o, "k", "v1", "5-LOW").select(F.col("k").alias("c_custkey"))


@query("select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 49)")
def semi_join_used(spark, sf_dir):
    """Frames that a result uses (C4)."""
    o, used = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_quantity >= 49")
    return o.join(used, o.o_orderkey == used.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query("""select event_type as kind, count(*) filter (v = 'confirms') as confirms, count(*) filter (v = 'contradicts') as contradicts, count(*) filter (v = 'unknown') as unknown
 from (select event_type, case when value > 15 then 'confirms' when value < 3 then 'contradicts' else 'unknown' end as v from events) group by 1""")
def pivot_kind_verdict(spark, sf_dir):
    """Kinds by verdict."""
    v = F.when(F.col("value") > 15, "confirms").when(F.col("value") < 3, "contradicts").otherwise("unknown")
    e = events(spark, sf_dir).select(F.col("event_type").alias("kind"), v.alias("v"))
    return e.groupBy("kind").pivot("v", ["confirms", "contradicts", "unknown"]).count().na.fill(0)


@query("""with n as (select l_suppkey % 10 as edge, l_partkey % 12 as vessel, count(*) as n from lineitem group by 1, 2),
 e as (select edge, max(n) as best, sum(n) as total from n group by 1) select edge, best, cast(total as bigint) as total, round(best / total, 6) as purity from e""")
def contingency_purity(spark, sf_dir):
    """Share of each edge in its best vessel."""
    n = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("edge"), (F.col("l_partkey") % 12).alias("vessel")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("edge").agg(F.max("n").alias("best"), F.sum("n").alias("total")).withColumn("purity", F.round(F.col("best") / F.col("total"), 6))


@query("""select case when l_quantity < 10 then 'thin' when l_quantity < 30 then 'medium' else 'wide' end as bucket, count(*) as n, round(avg(case when l_discount > 0.04 then 1.0 else 0.0 end), 6) as recall from lineitem group by 1""")
def recall_by_bucket(spark, sf_dir):
    """Recall by class of width."""
    bucket = F.when(F.col("l_quantity") < 10, "thin").when(F.col("l_quantity") < 30, "medium").otherwise("wide")
    hit = F.when(F.col("l_discount") > 0.04, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("recall"))


@query("""with k as (select o_orderstatus as status, o_orderpriority as kind, count(*) as n from orders group by 1, 2)
 select status, string_agg(n || ' ' || kind, ', ' order by kind) as summary, cast(sum(n) as bigint) as total from k group by 1""")
def summary_text(spark, sf_dir):
    """Counts of kinds as a line of text."""
    k = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    one = F.array_sort(F.collect_list(F.struct("kind", "n")))
    line = F.array_join(F.transform("x", lambda r: F.concat_ws(" ", r["n"].cast("string"), r["kind"])), ", ")
    return k.groupBy("status").agg(one.alias("x"), F.sum("n").alias("total")).select("status", line.alias("summary"), "total")


@query("""select event_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) as k, coalesce(json_extract_string(props, '$.missing.deep'), 'none') as deep,
 substr(sha256(props), 1, 12) as fingerprint from events""")
def json_deep_get(spark, sf_dir):
    """Nested values with defaults, and the fingerprint of parameters."""
    return events(spark, sf_dir).select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing.deep"), F.lit("none")).alias("deep"), F.substring(F.sha2("props", 256), 1, 12).alias("fingerprint"))


def _stability(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("burst"))
    return o.agg(F.when(F.count(F.lit(1)) >= 10, "ok").otherwise("skipped").alias("status"), F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div count(1)").alias("stability"))


@query("""with s as (select o_custkey as burst, case when count(*) >= 10 then 'ok' else 'skipped' end as status, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) // count(*) as stability from orders group by 1)
 select burst, status, stability, row_number() over (order by status <> 'ok', stability desc, burst) as place from s""")
def summary_order(spark, sf_dir):
    """The report's order: finished first, then by index."""
    s = _stability(spark, sf_dir)
    return ranks.ranked(s, [F.col("status") != "ok", F.desc("stability"), F.col("burst")], "place")


@query("""select s.status, count(*) as bursts, round(median(stability), 4) as median, min(stability) as least, max(stability) as most from
 (select o_custkey, case when count(*) >= 10 then 'ok' else 'skipped' end as status, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) // count(*) as stability from orders group by 1) s group by 1""")
def cross_burst_summary(spark, sf_dir):
    """Counts and range of an index over recordings."""
    s = _stability(spark, sf_dir)
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("bursts"), F.round(F.median("stability"), 4).alias("median"), F.min("stability").alias("least"), F.max("stability").alias("most"))


@query("""select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as folder, split_part(split_part(url, '?', 1), '/', -1) as name, url like '%..%' or url like '%\\%' as unsafe from pages""")
def safe_paths(spark, sf_dir):
    """Folder and name of a path, and whether it could leave its folder."""
    p = table(spark, sf_dir, "pages")
    name = F.element_at(F.split(F.element_at(F.split("url", "[?]"), 1), "/"), -1)
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("folder"), name.alias("name"), (F.col("url").contains("..") | F.col("url").contains("\\")).alias("unsafe"))


@query("""with p as (select o_custkey, list(o_orderkey order by o_orderkey) as k, count(*) as n from orders where o_totalprice > 200000 group by 1)
 select o_custkey, array_to_string(k[1:5], ', ') || case when n > 5 then ' and ' || (n - 5) || ' more' else '' end as problems from p""")
def summarize_problems(spark, sf_dir):
    """The first five and how many more."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    more = F.when(F.size("k") > 5, F.concat(F.lit(" and "), (F.size("k") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return o.select("o_custkey", F.concat(F.array_join(F.transform(F.slice("k", 1, 5), lambda x: x.cast("string")), ", "), more).alias("problems"))


@query(f"""with {EVENTS}, p as (select user_id, event_type, value, event_id, row_number() over (partition by user_id order by value desc, event_id) as rn from e) select user_id, event_id, value, rn as rank from p where rn <= 3""")
def reservoir_topk_per_group(spark, sf_dir):
    """The best k of each group."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return events(spark, sf_dir).withColumn("rank", rn.cast("long")).filter("rank <= 3").select("user_id", "event_id", "value", "rank")


@query(f"""with {EVENTS} select user_id, max_by(event_id, value) as reference, max(value) as score from e group by 1 having count(distinct value) = count(*)""")
def arg_max_reference(spark, sf_dir):
    """The reference frame: the one of the best score."""
    g = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", "value").alias("reference"), F.max("value").alias("score"), F.count_distinct("value").alias("d"), F.count(F.lit(1)).alias("n"))
    return g.filter("d = n").select("user_id", "reference", "score")


@query(f"""with {EVENTS} select event_id, case when event_type = 'view' then 12 else 8 end as bits, ((1 << case when event_type = 'view' then 12 else 8 end) - 1)::bigint as full_scale,
 (cast(value * 1000 as bigint) >> 4) as shifted, least(greatest(value, 2.0), 18.0) as clipped, cast(case when value >= 15 then 0.5 else 1.0 end as double) as working_scale,
 round(degrees(atan2(value, 10.0)), 6) as angle, round(acos(least(1.0, greatest(-1.0, value / 10.0 - 1.0))), 6) as turn from e""")
def scalar_functions(spark, sf_dir):
    """Bits, shifts, clips and angles."""
    bits = F.when(F.col("event_type") == "view", 12).otherwise(8)
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", bits.alias("bits"), F.expr("cast(shiftleft(1L, case when event_type = 'view' then 12 else 8 end) - 1 as bigint)").alias("full_scale"), F.shiftright(F.round(v * 1000).cast("long"), 4).alias("shifted"), F.least(F.greatest(v, F.lit(2.0)), F.lit(18.0)).alias("clipped"), F.when(v >= 15, 0.5).otherwise(1.0).alias("working_scale"), F.round(F.degrees(F.atan2(v, F.lit(10.0))), 6).alias("angle"), F.round(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v / 10.0 - 1.0))), 6).alias("turn"))
