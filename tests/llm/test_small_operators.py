import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framequarry.llm.common import range_bucket, splitters_of
from framequarry.llm.exact_dedup import exact_dedup
from framequarry.llm.known_licenses import DIGESTS, TEXTS
from framequarry.llm.licenses import license_scan
from framequarry.llm.mixing import mix, source_targets
from framequarry.llm.secret_scan import KINDS, secret_scan, spans_text
from framequarry.llm.sharding import histogram_shards, write_shards

SCHEMA = "doc_id long, text string"
AWKWARD = [(1, None), (2, ""), (None, ""), (None, None), (3, "a"), (3, "a"), (4, "a"), (-5, "é\n"), (6, "x" * 300_000), (7, "x" * 300_000)]


def hot(n=300):
    return [(k, "same" if k % 3 == 0 else f"text {k // 2}") for k in range(n)]


@pytest.mark.parametrize("rows", [AWKWARD, hot(), []])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, rows, keep):
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), keep=keep, pieces=7, sample_rows=200, carry=True).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    for r in got:
        own = groups[r.row.text or ""]
        ids = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (best(ids) if ids else None)
        assert r.text_sha256 == hashlib.sha256((r.row.text or "").encode()).hexdigest() and r.row.doc_id == r.doc_id
    kept = [r for r in got if r.kept]
    assert len(got) == len(rows) and all(r.doc_id == r.keep_id for r in kept)
    assert Counter(r.text_sha256 for r in kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def test_exact_dedup_normalises_and_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "A b", 5, 1), (2, "a B", 6, 2)], "doc_id long, text string, kept int, keep_id int")
    assert {r.doc_id: r.kept for r in exact_dedup(df, normalise=F.lower).collect()} == {1: False, 2: True}


def test_range_bucket(spark):
    cuts = splitters_of([f"{k:03d}" for k in range(0, 1000, 7)], 40)
    keys = [f"{k:03d}" for k in range(0, 1000, 3)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", range_bucket(F.col("k"), cuts).alias("b")).collect()
    assert all(r.b == sum(c <= r.k for c in cuts) for r in got)


@pytest.mark.parametrize("rows", [AWKWARD, hot(), []])
@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_shards(spark, rows, law):
    got = histogram_shards(spark.createDataFrame(rows, SCHEMA), 5, law).collect()
    texts = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 5 and (r.grown_shard in (r.shard, 5) if law == "key" else r.grown_shard is None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows and rows is not AWKWARD:
        if law == "rows":
            assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 5
        if law == "bytes":
            size = Counter()
            for r in got:
                size[r.shard] += r["size"]
            assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)


def test_shards_keep_small_groups_whole(spark):
    rows = [(k, f"text {k // 4} " + "y" * 80) for k in range(4000)]
    got = histogram_shards(spark.createDataFrame(rows, SCHEMA), 5, tolerance=0.01).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_write_shards(spark, tmp_path):
    write_shards(spark.createDataFrame(hot(), SCHEMA), f"file://{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 300 and back.select("shard").distinct().count() == 3
    clashing = spark.createDataFrame(hot(), SCHEMA).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(1.5)).withColumn("k", F.lit(1))
    write_shards(clashing, f"file://{tmp_path}/clash", files=7, shards=3)
    again = spark.read.parquet(f"file://{tmp_path}/clash")
    assert again.count() == 300 and {r[0] for r in again.select("row.shard").distinct().collect()} == {"mine"}
    for shard in range(3):  # files of a shard are in slot order
        names = sorted(f.name for f in (tmp_path / "clash" / f"shard={shard}").glob("*.parquet"))
        slots = [s for n in names for s in pq.ParquetFile(tmp_path / "clash" / f"shard={shard}" / n).read(["slot"]).column("slot").to_pylist()]
        assert slots == sorted(slots)


def level(sizes, weights, total, most):
    """Shares the excess again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = total * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        at = rest / sum(w[s] for s in names if s not in full) if len(full) < len(names) else 0
        over = {s for s in names if s not in full and w[s] * at > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * at for s in names}
        full |= over


def test_mix(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["a", "b", "b", "b", "b", "c", "ä", None])) for k in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "only empty"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, [3, 1, 2]).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    want, taken = level(sizes, [3, 1, 2], 1.5, 2.0), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mix(df.repartition(7), [3, 1, 2]).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert mix(df.limit(0), [1]).collect() == []


def test_targets_level_out(spark):
    for sizes in ({"a": 5, "b": 100, "c": 0}, {"a": 1, "b": 1, "c": 1, "d": 1000}, {"x": 10}):
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, n long"), [3, 1, 2], 1.5, 2.0).collect()
        want = level(sizes, [3, 1, 2], 1.5, 2.0)
        assert all(abs(r.target - want[r.source]) < 1e-9 for r in got)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_base_spans(spark):
    rnd = random.Random(6)
    bits = ["password", "Token", "secret", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "abcdef12", "AKIA", "Z9Z9Z9Z9", "0f" * 9, "0123", "𝔘é", "\n"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for k in range(600)]
    rows += [(1000, None), (1001, ""), (None, "api_key: 'QQQQQQQ"), (1002, ("token=abcdef12 " + "a" * 30 + " ") * 700), (1002, "x")]
    got = secret_scan(spark.createDataFrame(rows, SCHEMA)).select("doc_id", spans_text(F.col("base")).alias("b")).collect()
    assert Counter((r.doc_id, r.b) for r in got) == Counter((i, base_spans(t)) for i, t in rows)


def test_secret_links(spark):
    key, weak = "AKIA" + "Z9" * 8, "aB3" * 13 + "x"
    rows = [(1, f"{key} {weak} https://s3.example.com/x"), (2, weak), (3, f"{key}{' ' * 400}{weak} https://a.b"), (4, f"{weak} {key} {weak} z https://x.y"), (5, f"https://x.y {key}"), (1, f"{key} {weak} https://s3.example.com/x")]
    got = secret_scan(spark.createDataFrame(rows, SCHEMA)).select("doc_id", spans_text(F.col("spans")).alias("s")).collect()
    assert Counter((r.doc_id, r.s) for r in got) == Counter({(1, "access:0:20,secret:21:61,endpoint:62:84"): 2, (2, ""): 1, (3, "access:0:20"): 1, (4, "secret:0:40,access:41:61,secret:62:102,endpoint:105:116"): 1, (5, "access:12:32"): 1})


def test_secret_links_at_every_offset(spark):
    """A gap of 300 links and one of 301 does not, wherever the parts stand and however long the host is."""
    key, weak, rows, want = "AKIA" + "Z9" * 8, "aB3" * 13 + "x", [], {}
    for gap in (261, 299, 300, 301):
        for at in range(300):
            for a, b in ((weak, key), (key, weak)):
                want[len(rows)] = (int(gap <= 300), 0)
                rows.append((len(rows), " " * at + a + " " * gap + b))
    for n in (100, 310, 700):
        host = "https://" + "h" * n
        for gap in (1, 150, 279, 280):  # the token stands 21 places behind the identifier's beginning
            for at in range(0, 300, 7):
                want[len(rows)] = (1, int(gap + 21 <= 300))
                rows.append((len(rows), " " * at + host + " " * gap + key + " " + weak))
    got = {r.doc_id: (r.n_secret, r.n_endpoint) for r in secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_secret_after_equals_sign(spark):
    key, weak = "AKIA" + "Z9" * 8, "aB3" * 13 + "x"
    rows = [
        (1, f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={weak}\nS3=https://s3.example.com"),
        (2, f"aws_access_key_id = {key}\naws_secret_access_key='{weak}'"),
        (3, f"?AWSAccessKeyId={key}&Key={weak}&x=1"),
        (4, f"{key} k={weak}="),
        (5, f"{key} k={weak}a"),
        (6, f"{key} k=b{weak}"),
    ]
    got = {r.doc_id: (r.n_secret, r.n_endpoint) for r in secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (1, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}


def test_longer_licenses_by_digest(spark):
    """Given digests are looked up like those of given texts; a whole text matches, a part of it does not."""
    own = "Licence of Nowhere, version 1.\n\nYou may do what you like.\n"
    digest = license_scan(spark.createDataFrame([(1, own)], SCHEMA)).first().digest
    rows = [(1, "COPYRIGHT (c) 1999 Me\n" + own.upper()), (2, own[:-6]), (3, own + own), (None, own), (None, own), (4, "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("lines", F.lit("x"))
    got = sorted(((r.doc_id, r.license_id) for r in license_scan(df, digests={"Nowhere-1": digest}).collect()), key=str)
    assert got == sorted([(1, "Nowhere-1"), (2, None), (3, None), (None, "Nowhere-1"), (None, "Nowhere-1"), (4, None)], key=str)
    assert license_scan(df.limit(0)).collect() == []
    assert license_scan(df, texts={}, notices={}).filter("license_id is not null or n_notices > 0").isEmpty()
    assert len(set(DIGESTS.values())) == len(DIGESTS) and all(len(d) == 64 for d in DIGESTS.values())


def test_licenses(spark):
    british = TEXTS["MIT"].replace("<year> <copyright holders>", "2020 Somebody").replace("license", "licence").upper()
    bsd = TEXTS["BSD-3-Clause"].replace("\n", "\r\n   ").replace('"', "”")
    rows = [(1, british), (2, bsd), (3, "Text.\nreleased under the MIT licence!\nx\nLicensed under CC BY-NC 4.0."), (4, None), (5, "..."), (6, TEXTS["ISC"] + " more"), (None, "")]
    got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    none = (None, 0, "")
    assert got == {1: ("MIT", 0, ""), 2: ("BSD-3-Clause", 0, ""), 3: (None, 2, "CC-BY-NC-4.0,MIT"), 4: none, 5: none, 6: none, None: none}
