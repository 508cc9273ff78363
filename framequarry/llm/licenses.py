"""Licence texts by canonical digest.

Case, punctuation, copyright lines and equivalent spellings are levelled out; the digest of what is left is looked up
among the digests of known texts. Whole texts are joined; short notices that stand in a line of their own are looked
up line by line in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .known_licenses import DIGESTS, NOTICES, SPELLINGS, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright line, after lower-casing, and the sentence that often follows it.
COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]+[0-9]|©)[^\n]*"
RESERVED = r"(^|\n)[ \t]*all rights reserved\.?[ \t\r]*"
#: White space and punctuation of ASCII, and typographic quotes and dashes.
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’–—…]+"
#: Lines that can be a notice.
HINT = r"licen[sc]e"
#: The known table is broadcast: so many rows at most. Notices are looked up in a literal: so many at most.
MOST_KNOWN, MOST_NOTICES = 100_000, 1_000


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, "\n")
    out = F.regexp_replace(out, RESERVED, "\n")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, MARKS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: dict[str, str], digests: dict[str, str] | None = None) -> DataFrame:
    """license_id, known_digest of known texts and of canonical digests; of equal ones the first identifier."""
    df = spark.createDataFrame(sorted(texts.items()), "license_id string, t string").select(digest(F.col("t")).alias("known_digest"), "license_id")
    if digests:
        df = df.union(spark.createDataFrame(sorted((v, k) for k, v in digests.items()), "known_digest string, license_id string"))
    return df.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def license_scan(df: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", digests: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, digest, license_id (of the whole text, else null), n_notices, notices.

    Known texts are given as such or by their canonical digest; without either, those of ``known_licenses`` are used.
    ``notices`` are the identifiers of known one-line notices, once each, sorted and comma-joined; n_notices counts the
    lines. Null and empty texts, and texts of nothing but punctuation, match nothing. Texts and lines are read whole,
    however long. Null identifiers stay null; rows that repeat have equal results. Other columns, whatever their names,
    are not read. Empty input gives no rows. Known tables hold at most MOST_KNOWN texts, which bounds the broadcast.
    """
    if texts is None and digests is None:
        texts, digests = TEXTS, DIGESTS
    texts, digests, notices = texts or {}, digests or {}, NOTICES if notices is None else notices
    if len(texts) + len(digests) > MOST_KNOWN or len(notices) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_KNOWN} known texts or {MOST_NOTICES} notices")
    spark = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    base = df.select(df[id_col].cast("long").alias("i"), digest(text).alias("d"), F.filter(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda x: x.rlike(HINT)).alias("lines"))
    by_digest = {r.known_digest: r.license_id for r in known(spark, notices).collect()}
    none = F.array().cast("array<string>")
    if by_digest:
        table = F.create_map(*[F.lit(x) for kv in sorted(by_digest.items()) for x in kv])
        hits = F.filter(F.transform("lines", lambda x: F.element_at(table, digest(x))), lambda x: x.isNotNull())
    else:
        hits = none
    rows = base.withColumn("hits", F.when(F.size("lines") > 0, hits).otherwise(none))
    rows = rows.join(F.broadcast(known(spark, texts, digests)), F.col("d") == F.col("known_digest"), "left")
    return rows.select(F.col("i").alias(id_col), F.col("d").alias("digest"), "license_id", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))
