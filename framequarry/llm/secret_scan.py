"""Secrets in texts, with multipart credentials linked.

Three strong patterns are always reported. A key-shaped token alone is too weak to report: it counts only where an
access identifier stands in the same scope, and an endpoint only where both do. Scopes are stretches of ``scope`` code
points; identifiers, tokens and endpoints are put into the blocks of that length that they touch and joined with all
blocks within the scope, so the join grows with the parts found, not with their pairs. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 or more; shorter runs would be dropped afterwards, so they are not matched at all.
HEX = r"[0-9a-f]{24,}"
#: A token shaped like a secret key: 40 characters of base 64, none of its kind beside it. "=" may stand before it, as in
#: NAME=value; behind it, it is padding of something else.
TOKEN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
SPAN = "array<struct<start:int,rank:int,end:int>>"
BLOCK = 128


def _sums(lengths: Column) -> Column:
    """Running sums of an integer array; blocks keep the copying linear in its length."""

    def plain(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out"))
        return F.aggregate(xs, zero, step, lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
    before = F.zip_with(plain(totals), totals, lambda upto, own: upto - own)
    nested = F.flatten(F.zip_with(blocks, before, lambda xs, at: F.transform(plain(xs), lambda x: x + at)))
    return F.when(F.size(lengths) <= BLOCK, plain(lengths)).otherwise(nested)


def _spans(df: DataFrame, pattern: str, rank: int, least: int, group: int = 0, only: Column | None = None) -> DataFrame:
    """Add column s<rank>: the leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    Spark gives matches without positions; ``split`` gives what stands before each, so match n starts at the sum of
    all gaps up to its own and all matches before it.
    """
    text, found, none = F.col("t"), F.col("m"), F.array().cast(SPAN)
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("m", got if only is None else F.when(only, got).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("q", F.when(F.size(found) > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else found)
    df = df.withColumn("g", F.when(F.exists("q", lambda x: F.length(x) >= least), F.split(text, pattern, -1)))
    steps = F.zip_with(F.slice("g", 1, F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, 1, F.size(found) - 1)), lambda g, m: F.length(g) + F.length(m))
    df = df.withColumn("d", F.when(F.col("g").isNotNull(), steps))
    df = df.withColumn("b", F.when(F.col("d").isNotNull(), _sums(F.col("d"))))
    rows = F.transform(F.arrays_zip("b", "m", "q"), lambda x: F.struct(x["b"].alias("start"), F.lit(rank).alias("rank"), (x["b"] + F.length(x["m"])).alias("end"), (F.length(x["q"]) >= least).alias("ok")))
    kept = F.transform(F.filter(rows, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    return df.withColumn(f"s{rank}", F.coalesce(F.when(F.col("b").isNotNull(), kept), none)).drop("m", "q", "g", "d", "b")


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_spans(df: DataFrame) -> DataFrame:
    """Add s0..s4: spans of assignments, access identifiers, hex strings, weak tokens and endpoints in column t.

    Tokens and endpoints are looked for only where the text has an access identifier: else none can be linked.
    """
    df = _spans(df, ASSIGN, 0, 6, group=1)
    df = _spans(df, ACCESS, 1, 20)
    df = _spans(df, HEX, 2, 24)
    anchored = F.size("s1") > 0
    df = _spans(df, TOKEN, 3, 40, only=anchored)
    return _spans(df, ENDPOINT, 4, 8, only=anchored)


def link_parts(found: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """keys, linked: the weak spans of each row that have their complementary parts within ``scope`` code points."""
    block = lambda c: F.floor(c / scope).cast("int")
    # every block that a span or its scope touches, on either side: two spans within the scope share one at least
    part = lambda rank: found.filter(F.size(f"s{rank}") > 0).select(*keys, F.explode(f"s{rank}").alias("x")).distinct()
    reach = lambda df, *names: df.select(*names, F.explode(F.sequence(block(F.col("x.start") - scope), block(F.col("x.end") + scope))).alias("b2"))
    own = lambda df: df.select(*keys, "x", F.explode(F.sequence(block(F.col("x.start")), block(F.col("x.end")))).alias("b1"))

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of ``a`` with a row of ``b`` within the scope; a gap of over ``scope`` between them is too far."""
        a = own(a)
        b = reach(b, *[F.col(k).alias(f"{k}2") for k in keys], F.col("x").alias("y"))
        on = [a[k].eqNullSafe(b[f"{k}2"]) for k in keys] + [a["b1"] == b["b2"], b["y.start"] - a["x.end"] <= scope, a["x.start"] - b["y.end"] <= scope]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return a.join(b, cond, "left_semi").drop("b1").distinct()

    weak = found.filter((F.size("s1") > 0) & (F.size("s3") > 0))
    ids = weak.select(*keys, F.explode("s1").alias("x")).distinct()
    tokens = beside(weak.select(*keys, F.explode("s3").alias("x")).distinct(), ids)
    ends = beside(beside(part(4), ids), tokens)
    return tokens.unionByName(ends).groupBy(*keys).agg(F.collect_list("x").alias("linked"))


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_secret, n_endpoint, base, spans (arrays of start, rank, end).

    Null texts count as empty and have no spans. Rows of equal identifier and text have equal results; null identifiers
    stay null. ``rank`` is the position in KINDS; offsets are code points, ends exclusive. A base span stays even where a
    linked one overlaps it. Texts are searched whole, however long. Other columns, whatever their names, are not read.
    Empty input gives no rows.
    """
    base = df.select(df[id_col].cast("long").alias("i"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    found = find_spans(base.withColumn("h", F.xxhash64("t"))).drop("t")
    found = materialise(found, "secrets")
    linked = link_parts(found, ["i", "h"], scope).withColumnRenamed("i", "i2").withColumnRenamed("h", "h2")
    rows = found.join(linked, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    linked = F.coalesce(F.col("linked"), F.array().cast(SPAN))
    count = lambda rank: F.size(F.filter(linked, lambda x: x["rank"] == rank)).cast("long")
    rows = rows.withColumn("base", F.concat("s0", "s1", "s2"))
    return rows.select(F.col("i").alias(id_col), *[F.size(f"s{n}").cast("long").alias(f"n_{KINDS[n]}") for n in range(3)], count(3).alias("n_secret"), count(4).alias("n_endpoint"), "base", F.concat("base", linked).alias("spans"))
