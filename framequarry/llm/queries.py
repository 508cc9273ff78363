"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .licenses import COPYRIGHT, HINT, LOWER, MARKS, RESERVED, UPPER, license_scan
from .image_copies import image_copies, vectors_as_images
from .known_licenses import DIGESTS, NOTICES, SPELLINGS, TEXTS
from .line_dedup import LineIndex, dedup_lines, insert, references
from .merkle import FIELDS, digest_of, folded, merkle_manifest, siblings_digest
from .mixing import mix
from .near_dedup import near_duplicates
from .secret_scan import ACCESS, ASSIGN, ENDPOINT, secret_scan, spans_text
from .sentencepiece_codec import Vocabulary, encode
from .sharding import histogram_shards
from .suffix_dedup import suffix_dedup
from .toxicity import fit, toxicity

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer of op10 and of the pipeline; read on the driver only.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Weights of op5's sources, in code point order, repeating.
MIX_WEIGHTS = [3, 1, 2]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no pictures; each vector of ``embeddings`` is drawn as one."""
    pictures = vectors_as_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return image_copies(pictures).withColumnRenamed("id", "vec_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_secret", "n_endpoint", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(documents(spark, sf_dir), 24, "bytes")


def op8_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), Vocabulary.load(MODEL))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    refs = references(docs)
    out = dedup_lines(insert(LineIndex.empty(spark), refs), docs, refs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the checksum of the identifier, the text of a row is lower-cased after the manifest is made."""
    docs = documents(spark, sf_dir)
    tampered = [F.translate(docs[f], UPPER, LOWER) if f == "text" else docs[f] for f in FIELDS]
    probe = F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, digest_of(*tampered))
    out = merkle_manifest(docs, tampered=probe)
    root = folded(F.coalesce("probe", "leaf"), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Query]:
    return {
        "op1_hyperminhash_dedup": op1_hyperminhash_dedup,
        "op2_image_copies": op2_image_copies,
        "op3_secret_scan": op3_secret_scan,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_mix_sources": op5_mix_sources,
        "op6_toxicity": op6_toxicity,
        "op7_histogram_shards": op7_histogram_shards,
        "op8_content_sort_dedup": op8_content_sort_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_line_dedup": op11_line_dedup,
        "op12_merkle_manifest": op12_merkle_manifest,
    }


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, {_sql(COPYRIGHT)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_sql(RESERVED)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_sql(a)}, {_sql(b)})"
    return f"trim(regexp_replace({out}, {_sql(MARKS)}, ' ', 'g'))"


def _known_sql(texts: dict[str, str], digests: dict[str, str]) -> str:
    rows = ", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in sorted(texts.items()))
    known = f"select id, sha256({_canonical_sql('t')}) as known_digest from (values {rows}) as v(id, t)"
    if digests:
        known += " union all select * from (values " + ", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in sorted(digests.items())) + ") as w(id, known_digest)"
    return f"(select known_digest, min(id) as license_id from ({known}) group by 1)"


def _spans_sql(rank: int, pattern: str, keep: str, group: int = 0, where: str = "true") -> str:
    """doc_id, rank, start, stop of matches, from what ``regexp_extract_all`` and ``string_split_regex`` give."""
    return f"""
        select doc_id, {rank} as rank, start, start + length(mm) as stop from (
          select doc_id, m[i] as mm, q[i] as qq,
                 cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as start
          from (select doc_id, regexp_extract_all(t, {pattern}, 0) as m, regexp_extract_all(t, {pattern}, {group}) as q, string_split_regex(t, {pattern}) as g from d where {where}) as p,
               unnest(range(1, len(p.m) + 1)) as u(i)) where {keep}"""


def _secret_sql() -> str:
    near = lambda a, b: f"{a}.doc_id = {b}.doc_id and {b}.start - {a}.stop <= 300 and {a}.start - {b}.stop <= 300"
    text = "string_agg((['assign', 'access', 'hex', 'secret', 'endpoint'])[rank + 1] || ':' || start || ':' || stop, ',' order by start, rank, stop)"
    return f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        base as ({_spans_sql(0, _sql(ASSIGN), "length(qq) >= 6", 1)} union all {_spans_sql(1, _sql(ACCESS), "length(mm) >= 20")} union all {_spans_sql(2, _sql("[0-9a-f]+"), "length(mm) >= 24")}),
        ids as (select * from base where rank = 1),
        weak as ({_spans_sql(3, _sql("[A-Za-z0-9+/]+=?"), "length(mm) = 40 and not contains(mm, '=')", where="contains(t, 'AKIA')")}),
        ends as ({_spans_sql(4, _sql(ENDPOINT), "length(mm) >= 8", where="contains(t, 'AKIA')")}),
        secret as (select * from weak w where exists (select 1 from ids i where {near("w", "i")})),
        linked as (select * from secret union all select * from ends e where exists (select 1 from ids i where {near("e", "i")}) and exists (select 1 from secret s where {near("e", "s")})),
        b as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, {text} as x from base group by 1),
        l as (select doc_id, count(*) filter (rank = 3) as n_secret, count(*) filter (rank = 4) as n_endpoint from linked group by 1),
        a as (select doc_id, {text} as spans from (select * from base union all select * from linked) group by 1)
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_secret, 0) as n_secret,
               coalesce(n_endpoint, 0) as n_endpoint, sha256(coalesce(x, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join b using (doc_id) left join l using (doc_id) left join a using (doc_id)"""


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


def _merkle_sql() -> str:
    leaf = "sha256(" + " || ".join(_field_sql(f) for f in FIELDS) + ")"
    probe = "sha256(" + " || ".join(_field_sql(f"translate(text, '{UPPER}', '{LOWER}')" if f == "text" else f) for f in FIELDS) + ")"
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda k: (ascii(c)::bigint >> k) & 1)))"
    crc = f"xor(list_reduce([4294967295::bigint] || {bits}, lambda x, b: xor(x >> 1, (xor(x, b) & 1) * 3988292384::bigint)), 4294967295::bigint)"
    tree = lambda base: f"select * from ({base}) union all select g, lvl + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from {{t}} where n > 1 group by g, lvl, i // 8, n"
    sides = lambda t: f"""select a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
                          from {t} a join {t} b on a.g = b.g and a.lvl = b.lvl and a.i // 8 = b.i // 8 where a.n > 1 group by 1, 2, 3"""  # noqa: E731
    return f"""
        with recursive d as (select doc_id, coalesce('=' || lang, '') as g, {leaf} as leaf, case when {crc} % 3 = 0 then {probe} end as probe from documents),
        o as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d),
        t(g, lvl, i, h, n) as ({tree("select g, 0::bigint, i, leaf, n from o").format(t="t")}),
        s as (select g, h as subroot, row_number() over (order by g) - 1 as i, count(*) over () as n from t where n = 1),
        u(g, lvl, i, h, n) as ({tree("select '', 0::bigint, i, subroot, n from s").format(t="u")}),
        tp as ({sides("t")}), up as ({sides("u")}),
        p as (select o.g, o.i, tp.lvl as step, tp.l, tp.r from o join tp on tp.g = o.g and tp.i = o.i // (8 ** tp.lvl)::bigint
              union all select o.g, o.i, 1000 + up.lvl, up.l, up.r from o join s using (g) join up on up.i = s.i // (8 ** up.lvl)::bigint),
        q as (select *, row_number() over (partition by g, i order by step) as k from p),
        f(g, i, k, h) as (select g, i, 0::bigint, coalesce(probe, leaf) from o union all select f.g, f.i, q.k, sha256(q.l || f.h || q.r) from f join q on q.g = f.g and q.i = f.i and q.k = f.k + 1),
        e as (select g, i, max_by(h, k) as folded_root from f group by 1, 2),
        c as (select g, i, string_agg(l || r, '' order by k) as proof from q group by 1, 2)
        select doc_id, leaf, subroot, (select h from u where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = (select h from u where n = 1) as verified
        from o join s using (g) join e on e.g = o.g and e.i = o.i left join c on c.g = o.g and c.i = o.i"""


def oracle_sql() -> dict[str, str]:
    """Those of op1, op3, op4 compare everything with everything, so they are for small tables only."""
    return {
        "op1_hyperminhash_dedup": rf"""
            with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
            s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                     when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
            n as (select doc_id, count(*) as n from s group by 1),
            p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
            l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
            e as (select x as a, y as b from l union all select y, x from l),
            r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on r.b = e.a),
            k as (select a as doc_id, min(b) as component_id from r group by 1)
            select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from k left join n using (doc_id)""",
        "op3_secret_scan": _secret_sql(),
        "op4_suffix_array_dedup": """
            with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
            w as (select doc_id, i, array_slice(b, i, i + 49) as s from d, unnest(range(1, octet_length(b) - 48)) as u(i)),
            c as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as f from w) where f < doc_id),
            g as (select *, i - lag(i) over (partition by doc_id order by i) as gap from c),
            r as (select *, sum(case when gap is null or gap > 50 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as run from g),
            p as (select doc_id, run, min(i) as a, max(i) + 49 as z from r group by 1, 2),
            k as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as x, a - 1 as y from p
                  union all select doc_id, max(z) + 1, 1000000000 from p group by 1),
            h as (select k.doc_id, string_agg(hex(array_slice(b, x, y)), '' order by x) as kept from k join d using (doc_id) where x <= y group by 1),
            t as (select doc_id, cast(sum(z - a + 1) as bigint) as n_removed, count(*) as n_spans from p group by 1)
            select d.doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
                   sha256(case when t.doc_id is null then b else unhex(coalesce(kept, '')) end) as kept_sha256
            from d left join t using (doc_id) left join h using (doc_id)""",
        "op5_mix_sources": rf"""
            with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
            n as (select source, sum(size) as n from d group by 1),
            r as (select source, cast(n as double) as n, cast(([3, 1, 2])[((row_number() over (order by source is null, source) - 1) % 3) + 1] as double) as w, sum(n) over () * 1.5::double as total from n),
            c as (select *, 2 * n as cap, coalesce(sum(2 * n) over (order by 2 * n / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as full_before,
                  sum(w) over (order by 2 * n / w, source is null, source rows between current row and unbounded following) as open from r),
            o as (select *, (total - full_before) / open as level from c),
            l as (select *, min(case when level * w < cap then 2 * n / w end) over () as first_open from o),
            v as (select max(level) filter (2 * n / w = first_open) as level from l),
            t as (select source, n, case when n = 0 then 0.0::double else least(cap, w * coalesce((select level from v), 1e300)) end as target from c),
            p as (select d.*, row_number() over (partition by source order by size, doc_id) as place from d),
            q as (select doc_id, size, cast(n as bigint) as source_size, target, case when n > 0 then target / n else 0 end as rate, cast('0x' || md5(coalesce(p.source, '') || '|0')[1:8] as bigint) / 4294967296.0::double as off, place
                  from p join t on t.source is not distinct from p.source)
            select doc_id, size, source_size, target, cast(case when size > 0 then floor(place * rate + off) - floor((place - 1) * rate + off) else 0 end * size as bigint) as taken,
                   cast(case when size > 0 then floor(place * rate + off) - floor((place - 1) * rate + off) else 0 end as int) as copies from q""",
        "op8_content_sort_dedup": """
            with d as (select doc_id, coalesce(text, '') as t from documents)
            select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
                   doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
            from d""",
        "op11_line_dedup": f"""
            with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
            e as (select doc_id, i, l[i] as line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k from d, unnest(range(1, len(d.l) + 1)) as u(i)),
            r as (select k, max(doc_id) as top from e where length(k) >= 20 group by 1 having count(distinct doc_id) >= 3),
            m as (select e.*, coalesce(r.top <> doc_id, false) as gone from e left join r using (k))
            select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
            from m group by 1""",
        "op12_merkle_manifest": _merkle_sql(),
        "op9_license_scan": f"""
            with d as (select doc_id, coalesce(text, '') as t from documents),
            lines as (select doc_id, unnest(list_filter(string_split(translate(t, '{UPPER}', '{LOWER}'), chr(10)), lambda x: regexp_matches(x, '{HINT}'))) as l from d),
            hits as (select doc_id, count(*) as n, string_agg(distinct license_id, ',' order by license_id) as notices
                     from lines join {_known_sql(NOTICES, {})} on known_digest = sha256({_canonical_sql("l")}) group by doc_id),
            whole as (select doc_id, sha256({_canonical_sql("t")}) as digest from d)
            select w.doc_id, w.digest, k.license_id, cast(coalesce(h.n, 0) as bigint) as n_notices, coalesce(h.notices, '') as notices
            from whole w left join {_known_sql(TEXTS, DIGESTS)} k on k.known_digest = w.digest left join hits h on h.doc_id = w.doc_id""",
    }
