"""Line dedup that can be taken back: sharded cuckoo filters in front of an exact table of references.

Every line of enough code points gives a reference (digest of its key, document, place, count). References are only
appended: a document's insertion adds them, its deletion adds the same with counts below zero, so the sum of a key's
counts is the number of documents that hold it now. The filters hold a key as often as documents do, up to
``least_docs`` times. They never count too low: a key that they count less often is left alone without a look at the
exact table, and a key of a new batch that they do not know at all is new. What they count high enough is summed in
the exact table, so their errors cost time only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, LEAST_HOT, look_up, materialise
from .cuckoo import CuckooFilter, buckets_for
from .licenses import LOWER, UPPER

BLANKS = " \t\n\x0b\x0c\r"
#: A new index gets the least power of two of shards that leaves each so many entries.
ENTRIES = 1 << 15

_REFS = "key binary, doc_id long, text_hash long, at int, n long"
_FILTERS = "shard long, buckets long, entries long, slots binary, stash binary"


@dataclass(frozen=True)
class LineIndex:
    """References and filters; ``insert`` and ``delete`` return a new index, the old one stays as it is."""

    refs: DataFrame
    filters: DataFrame
    shards: int | None = None
    least_docs: int = 3
    min_chars: int = 20

    @staticmethod
    def empty(spark: SparkSession, shards: int | None = None, least_docs: int = 3, min_chars: int = 20) -> LineIndex:
        """``shards``: a power of two, by default chosen at the first insertion."""
        if shards is not None and shards & (shards - 1):
            raise ValueError("shards is a power of two")
        return LineIndex(spark.createDataFrame([], _REFS), spark.createDataFrame([], _FILTERS), shards, least_docs, min_chars)


def line_key(line: Column) -> Column:
    """Blanks at both ends stripped, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """key, doc_id, text_hash, at, n: a row for each line with a key of ``min_chars`` code points or more.

    Each row of ``docs`` is a document; ``n`` is 1 at a key's first line in it and 0 at its others. The table is written.
    """
    text = docs[text_col].cast("string")
    keys = F.transform(_lines(text), lambda line, i: F.struct(line_key(line).alias("k"), i.alias("at")))
    keys = F.transform(F.filter(keys, lambda x: F.length(x["k"]) >= min_chars), lambda x: F.struct(F.unhex(F.sha2(x["k"], 256)).alias("key"), x["at"].alias("at")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.array_sort(keys).alias("ks"))
    first = F.transform("ks", lambda x, i: F.struct(x["key"].alias("key"), x["at"].alias("at"), F.when((i > 0) & (F.get("ks", i - 1)["key"] == x["key"]), 0).otherwise(1).cast("long").alias("n")))
    return materialise(rows.select("doc_id", "text_hash", F.explode(first).alias("r")).select("r.key", "doc_id", "text_hash", "r.at", "r.n"), "refs")


def _hash(key: str = "key") -> Column:
    return F.xxhash64(key).alias("h")


def _probe(index: LineIndex, keys: DataFrame) -> DataFrame:
    """h, copies: what the filters count for distinct hashes ``keys`` (h); a hash whose shard has no filter is left out."""

    def count(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(held):
            return pd.DataFrame({"h": np.zeros(0, np.int64), "copies": np.zeros(0, np.int64)})
        f = held.iloc[0]
        h = pdf["h"].to_numpy()
        return pd.DataFrame({"h": h, "copies": CuckooFilter(int(f["buckets"]), f["slots"], f["stash"]).copies(h).astype(np.int64)})

    dealt = keys.withColumn("shard", F.col("h").bitwiseAND(F.lit((index.shards or 1) - 1)))
    return dealt.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(count, "h long, copies long")


def _held(index: LineIndex, hashes: DataFrame) -> DataFrame:
    """key, docs: how many documents hold the keys with the given hashes, from the exact table."""
    return index.refs.join(hashes.select("h"), _hash_on(index.refs, hashes), "left_semi").groupBy("key").agg(F.sum("n").alias("docs"))


def _hash_on(refs: DataFrame, hashes: DataFrame) -> Column:
    return F.xxhash64(refs["key"]) == hashes["h"]


def _fill(changes: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The filters after ``changes`` (h, add, rebuilt): entries added or, below zero, removed; a rebuilt shard begins empty."""

    def fill(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        f = held.iloc[0] if len(held) else None
        if not len(pdf):
            return held[["shard", "buckets", "entries", "slots", "stash"]]
        h, add = pdf["h"].to_numpy(), pdf["add"].to_numpy()
        rebuilt = bool(pdf["rebuilt"].iloc[0])
        entries = int(add.sum()) + (0 if rebuilt else int(f["entries"]))
        out = CuckooFilter(buckets_for(entries)) if rebuilt else CuckooFilter(int(f["buckets"]), f["slots"], f["stash"])
        order = np.argsort(h, kind="stable")  # whatever the order of rows, the same filter
        h, add = h[order], add[order]
        out.remove(np.repeat(h, np.maximum(-add, 0)))
        out.add(np.repeat(h, np.maximum(add, 0)))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "buckets": [out.buckets], "entries": [entries], "slots": [out.table.tobytes()], "stash": [out.stash.tobytes()]})

    dealt = changes.withColumn("shard", F.col("h").bitwiseAND(F.lit(shards - 1)))
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(fill, _FILTERS)


def _change(index: LineIndex, refs: DataFrame) -> LineIndex:
    """The index with more references, whose counts may be below zero."""
    most = index.least_docs
    delta = refs.groupBy("key").agg(F.sum("n").alias("d")).filter("d != 0")
    if index.shards is None or index.filters.isEmpty():
        before = delta.select("*", F.lit(0).cast("long").alias("docs"))
    else:
        delta = materialise(delta, "delta")
        known = materialise(_probe(index, delta.select(_hash()).distinct()).filter("copies > 0").select("h"), "known")
        before = delta.join(_held(index, known), "key", "left").select("key", "d", F.coalesce("docs", F.lit(0)).alias("docs"))
    add = F.least(F.col("docs") + F.col("d"), F.lit(most)) - F.least("docs", F.lit(most))
    changes = materialise(before.select(_hash(), add.alias("add"), (F.col("docs") + F.col("d")).alias("docs")).filter("add != 0"), "changes")
    total = changes.agg(F.sum("add")).first()[0] or 0
    shards = index.shards
    while shards is None or shards * ENTRIES < total and index.shards is None:
        shards = 1 if shards is None else shards * 2
    new = replace(index, refs=index.refs.unionByName(refs.select(*index.refs.columns)) if index.shards else refs, shards=shards)

    # a shard that has no filter yet or outgrows its own is built anew, from the exact counts of all its keys
    shard = F.col("h").bitwiseAND(F.lit(shards - 1))
    load = changes.groupBy(shard.alias("shard")).agg(F.sum(F.greatest("add", F.lit(0))).alias("more"))
    load = load.join(index.filters.select("shard", "buckets", "entries"), "shard", "left")
    room = F.col("entries").isNotNull() & (F.col("more") + F.col("entries") <= F.col("buckets") * 4 * 0.8)
    load = load.select("shard", (~room).alias("rebuilt"), F.col("entries").isNotNull().alias("there"))
    marked = changes.select(shard.alias("shard"), "h", "add").join(load, "shard")
    kept = marked.filter("not (rebuilt and there)").select("h", "add", "rebuilt")
    if load.filter("rebuilt and there").isEmpty():
        return replace(new, filters=materialise(_fill(kept, index.filters, shards), "filters"))
    grown = new.refs.select("key", "n", _hash()).withColumn("shard", shard).join(load.filter("rebuilt and there").select("shard"), "shard", "left_semi")
    whole = grown.groupBy("h", "key").agg(F.sum("n").alias("docs")).filter("docs > 0").select("h", F.least("docs", F.lit(most)).alias("add"), F.lit(True).alias("rebuilt"))
    return replace(new, filters=materialise(_fill(kept.unionByName(whole), index.filters, shards), "filters"))


def insert(index: LineIndex, refs: DataFrame) -> LineIndex:
    """The index with the documents whose ``references`` are given."""
    return _change(index, refs)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of the given identifiers (doc_id); unknown ones, and null, change nothing.

    What is left is as if they had never been inserted; no text is needed for it.
    """
    gone = index.refs.join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    gone = gone.groupBy("key", "doc_id", "text_hash", "at").agg((-F.sum("n")).alias("n")).filter("n < 0")
    return _change(index, materialise(gone.select(*index.refs.columns), "refs"))


def repeated_keys(index: LineIndex, refs: DataFrame) -> DataFrame:
    """key, docs, top: keys of ``refs`` that ``least_docs`` documents of the index hold now, and the largest of these."""
    hits = materialise(_probe(index, refs.select(_hash()).distinct()).filter(F.col("copies") >= index.least_docs).select("h"), "hits")
    held = index.refs.join(hits, _hash_on(index.refs, hits), "left_semi").groupBy("key", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0")
    out = held.groupBy("key").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top"))
    return materialise(out.filter(F.col("docs") >= index.least_docs), "repeated")


def dedup_lines(index: LineIndex, docs: DataFrame, refs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, kept (the text that stays).

    A text is split at newlines; null and empty ones are one empty line. A line goes if its key is held by
    ``least_docs`` documents of the index and the largest identifier among them is another one. Rows of one identifier
    are documents of their own, but keep the same lines; a null identifier is the smallest, and is told from other
    null ones by nothing. ``refs`` are the ``references`` of ``docs``, if these are known. Documents that the index does
    not hold are judged by those that it does. No rows give no rows; other columns are not read.
    """
    refs = references(docs, id_col, text_col, index.min_chars) if refs is None else refs
    repeated = repeated_keys(index, refs)
    total = refs.count()
    # lines of keys that very many documents hold do not move; those beyond 1 / HOT keys are joined like the others
    hot = repeated.filter(F.col("docs") > max(total * HOT, LEAST_HOT)).select("key").orderBy(F.desc("docs")).limit(int(1 / HOT)).collect()
    drop = look_up(refs, repeated, ["key"], hot, how="inner").filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    drop = drop.groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")).agg(F.collect_set("at").alias("gone"))
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    rows = rows.join(drop, rows.doc_id.eqNullSafe(F.col("drop_id")) & (rows.text_hash == F.col("drop_hash")), "left")
    rows = rows.withColumn("lines", _lines(F.col("text")))  # a column, so that it is not split again for each line
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return rows.select(F.col("doc_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
