"""The jobs as queries: each runs twice into one new folder, and the whole output as it stands then is returned."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequarry.functions.lineage import shared_folder

from . import recording_report, text_release


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_recording_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly report of recordings by a stream that takes only new files; the second run finds nothing new."""
    out = _folder(spark, "job1")
    for _ in range(2):
        report = recording_report.run(spark, f"{sf_dir}/events.parquet", f"{out}/out", f"{out}/checkpoint")
    return report


def job2_text_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release of the text tables with a verified manifest; the second run leaves every part as it is."""
    out = _folder(spark, "job2")
    for _ in range(2):
        parts = text_release.run(spark, sf_dir, out)
    return parts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_recording_report": job1_recording_report, "job2_text_release": job2_text_release}


def oracle_sql() -> dict[str, str]:
    return {
        "job1_recording_report": """
            with f as (select event_id, user_id, epoch_us(ts) as us, epoch_us(ts) / 1e6 as s, value, cast(event_id % 97 as double) as y, ln(value + 1) as sharp,
                              coalesce(strftime(date_trunc('week', ts), '%Y-%m-%d'), 'unknown') as week from events),
            m as (select user_id, week, median(sharp) as sm, median(value) as bm from f group by 1, 2),
            d as (select user_id, week, median(abs(sharp - sm)) as sd, median(abs(value - bm)) as bd from f join m using (user_id, week) group by 1, 2),
            z as (select f.*, sm, bm, case when sd <= 1e-12 then 0.0 else (sharp - sm) / (sd * 1.4826) end as zs, case when bd <= 1e-12 then 0.0 else (value - bm) / (bd * 1.4826) end as zb
                  from f join m using (user_id, week) join d using (user_id, week)),
            g as (select *, coalesce(zs < -2.0 and exp(sharp - sm) < 0.6, false) as blur, coalesce(abs(zb) > 2.0 and abs(value / greatest(bm, 1e-9) - 1) > 0.25, false) as light from z),
            k as (select * from g where not (blur or light) and value is not null),
            c as (select user_id, week, median(value) as cx, median(y) as cy from k group by 1, 2),
            p as (select user_id, week, count(*) as n, median(sqrt(pow(value - cx, 2) + pow(y - cy, 2))) as dm, quantile_cont(sqrt(pow(value - cx, 2) + pow(y - cy, 2)), 0.95) as d95
                  from k join c using (user_id, week) group by 1, 2),
            v as (select user_id, week, s - lag(s) over w as dt, sqrt(pow(value - lag(value) over w, 2) + pow(y - lag(y) over w, 2)) as step from k window w as (partition by user_id, week order by us, event_id)),
            sp as (select user_id, week, step / dt as speed from v where dt > 0),
            s1 as (select user_id, week, median(speed) as med from sp group by 1, 2),
            s2 as (select user_id, week, median(abs(speed - med)) as mad from sp join s1 using (user_id, week) group by 1, 2),
            j as (select user_id, week, any_value(med) as med, count(*) filter (speed > med + mad * (6.0 * 1.4826)) as saccades, sqrt(avg(speed * speed) filter (not speed > med + mad * (6.0 * 1.4826))) as jitter
                  from sp join s1 using (user_id, week) join s2 using (user_id, week) group by 1, 2),
            a as (select user_id, week, count(*) as frames, count(*) filter (not (blur or light)) as kept, count(*) filter (blur) as blurred, count(*) filter (light) as lighting, min(us) as first_us, max(us) as last_us from g group by 1, 2)
            select a.*, round(dm, 6) as displacement_median, round(d95, 6) as displacement_p95, round(j.med, 6) as speed_median, round(jitter, 6) as jitter_rms, saccades
            from a left join p on a.user_id = p.user_id and a.week = p.week and p.n >= 3 left join j on a.user_id = j.user_id and a.week = j.week and p.n is not null""",
        "job2_text_release": """
            with t as (select 'documents' as kind, source as part, doc_id::varchar as ident, text from documents
                       union all select 'pages', regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1), page_id::varchar, html from pages
                       union all select 'conversations', role, conv_id || '/' || turn, text from conversations),
            f as (select kind, coalesce(nullif(part, ''), 'none') as part, ident, coalesce(text, '') as text, sha256(coalesce(text, '')) as sha from t)
            select kind, part, count(*) as texts, count(*) - count(distinct sha) as copies, cast(sum(strlen(text)) as bigint) as bytes, cast(max(strlen(text)) as bigint) as longest,
                   sum(cast('0x' || sha256(ident || ':' || sha)[1:15] as bigint))::varchar as checksum
            from f group by 1, 2""",
    }
