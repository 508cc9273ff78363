"""Repeated passages by suffix arrays.

A byte goes if a string of ``width`` bytes over it also starts in a document with a smaller identifier. Windows of that
width are dealt into shards by an anchor, the gram of least hash within them, so equal windows meet in one shard however
the documents are spread. Neighbouring windows with one anchor form a run of at most 76 bytes; runs of one digest (128
bits) are collapsed to the one of the smallest identifier, in the reading task first and then in the shard, so a passage
that a third of all documents share costs one run a task. The runs that are left, of anchors with several contexts, are
streamed into one text per shard, and its suffix array is built by external induced sorting: a queue by leading symbol,
in a file beyond a bound, carries each suffix and its common prefix with its neighbour. Neighbours with a common prefix
of ``width`` bytes are one string, and its smallest identifier decides.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffix_kernels import IN_MEMORY, MOST_NAMES, Scratch, first_owner, pieces, runs_of
from .text_kernels import U, chunks, mix64, string_bytes

WIDTH, GRAM = 50, 24
#: Bytes of text in a group of documents, on average; there are as many shards of runs as groups.
GROUP_BYTES = 4 << 20
#: Stands for a null identifier: larger than any other.
NO_ID = (1 << 63) - 1
_RUNS = "shard int, ids binary, keys binary, doc binary, start binary, windows binary, anchor binary, first binary, second binary, done boolean"
_MARKS = "bucket int, ids binary, keys binary, doc binary, start binary, windows binary, anchor binary"
_STRINGS = "shard int, ids binary, keys binary, start binary, sizes binary, bytes binary"


def _i64(x) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _table(names: list[str], rows: list[tuple], first: pa.DataType = pa.int32()) -> pa.RecordBatch:
    kinds = {"shard": first, "bucket": first, "done": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.binary())) for k, n in enumerate(names)], names=names)


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits as four planes of bytes, which compress well if neighbours are close."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _bucket(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Documents are dealt out by identifier and text, so that copies of one text do not meet."""
    return (mix64(mix64(ids.astype(np.int64).view(U)) + keys.astype(np.int64).view(U)) % U(buckets)).astype(np.int64)


def _least_of_equal(anchor: np.ndarray, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by (anchor, digests, id), where a new digest begins, and which rows have a smaller identifier before them there."""
    by = np.lexsort((ids, second, first, anchor))
    new = np.ones(len(by), bool)
    new[1:] = False
    for x in (anchor, first, second):
        new[1:] |= x[by][1:] != x[by][:-1]
    i = ids[by]
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else i
    return by, new, i > least


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    """``anchor`` keeps 32 bits of the gram's hash; anchors that share them share a shard and are told apart by their strings."""
    return (mix64(anchor.astype(U)) % U(shards)).astype(np.int64)


def _runs_by_shard(ids, keys, offsets, data, width: int, gram: int, shards: int) -> list[tuple]:
    got = []
    for group in pieces(offsets, width):
        parts = [data[a:b] for _, a, b in group]
        bounds = np.cumsum([0, *map(len, parts)])
        text, start, windows, anchor, first, second = runs_of(np.concatenate(parts), bounds, width, gram)
        rows = np.array([r for r, _, _ in group])
        base = np.array([a for _, a, _ in group]) - offsets[rows]
        got.append((rows[text].astype(np.uint32), (start + base[text]).astype(np.uint32), windows.astype(np.uint8), anchor.astype(np.uint32), first, second))
    if not got:
        return []
    doc, start, windows, anchor, first, second = (np.concatenate(x) for x in zip(*got, strict=True))
    by, _, done = _least_of_equal(anchor, first, second, ids[doc])
    flag = np.zeros(len(by), bool)
    flag[by] = done
    shard = _shard(anchor, shards)
    order = np.lexsort((flag, shard))
    cut = shard[order] * 2 + flag[order]
    edges = np.append(np.flatnonzero(np.append(True, cut[1:] != cut[:-1])), len(cut))
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        o = order[a:b]
        used, at = np.unique(doc[o], return_inverse=True)
        is_done = bool(flag[o[0]])
        rows.append((int(shard[o[0]]), _i64(ids[used]), _i64(keys[used]), _planes(at), _planes(start[o]), windows[o].tobytes(), *([b""] * 3 if is_done else [_planes(anchor[o]), first[o].tobytes(), second[o].tobytes()]), is_done))
    return rows


def _deal(width: int, gram: int, shards: int):
    """Documents (id, key, text) -> their runs by shard; those that the batch already decides are marked done."""
    names = [x.split()[0] for x in _RUNS.split(", ")]

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, data = string_bytes(batch.column(2))
            for a, b in chunks(offsets, GROUP_BYTES):
                rows = _runs_by_shard(ids[a:b], keys[a:b], offsets[a : b + 1], data, width, gram, shards)
                if rows:
                    yield _table(names, rows)

    return run


def _gather(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Arrays of all rows' blobs, with doc pointing into the joined ids and keys."""
    kinds = {"ids": np.int64, "keys": np.int64, "doc": None, "start": None, "windows": np.uint8, "anchor": None, "first": U, "second": U}
    out: dict[str, list] = {n: [] for n in ("ids", "keys", "doc", *names)}
    base = 0
    blobs = {n: table.column(n).to_pylist() for n in out}
    for k in range(table.num_rows):
        for n in out:
            x = np.frombuffer(blobs[n][k], kinds[n]) if kinds[n] else _from_planes(blobs[n][k])
            out[n].append(x.astype(np.int64) + base if n == "doc" else x)
        base += len(out["ids"][-1])
    return {n: np.concatenate(x) if x else np.zeros(0, kinds[n] or np.uint32) for n, x in out.items()}


def _mark_rows(ids, keys, doc, start, windows, anchor, buckets: int) -> list[tuple]:
    """Blobs by group of documents; ``anchor`` 0 means that the windows are covered, else that the shard must decide."""
    bucket = _bucket(ids, keys, buckets)[doc] if len(doc) else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
    rows = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        o = order[x:y]
        used, at = np.unique(doc[o], return_inverse=True)
        rows.append((int(b[x]), _i64(ids[used]), _i64(keys[used]), _planes(at), _planes(start[o]), windows[o].astype(np.uint8).tobytes(), _planes(anchor[o])))
    return rows


def _decide(buckets: int):
    """All runs of a shard -> windows that are covered, and runs of anchors with several contexts and documents."""
    names = [x.split()[0] for x in _MARKS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(table.column("done"))
        x = _gather(done, ("start", "windows"))
        rows = _mark_rows(x["ids"], x["keys"], x["doc"], x["start"], x["windows"], np.zeros(len(x["doc"]), np.uint32), buckets)
        x = _gather(table.filter(pa.compute.invert(table.column("done"))), ("start", "windows", "anchor", "first", "second"))
        ids = x["ids"][x["doc"]]
        by, new, covered = _least_of_equal(x["anchor"], x["first"], x["second"], ids)
        if len(by):
            a, i = x["anchor"][by], ids[by]
            at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            several = (np.add.reduceat(new.astype(np.int64), at) > 1) & (np.minimum.reduceat(i, at) != np.maximum.reduceat(i, at))
            open_ = np.repeat(several, np.diff(np.append(at, len(a)))) & ~covered
            keep = covered | open_
            o = by[keep]
            rows += _mark_rows(x["ids"], x["keys"], x["doc"][o], x["start"][o], x["windows"][o], np.where(open_[keep], a[keep] | 1, 0), buckets)
        return pa.Table.from_batches([_table(names, rows)])

    return run


def _bounds_of(docs: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """Row of each (id, key), and the texts' offsets and bytes."""
    ids, keys = docs.column("id").to_pylist(), docs.column("key").to_pylist()
    offsets, data = string_bytes(docs.column("t"))
    return {k: n for n, k in enumerate(zip(ids, keys, strict=True))}, offsets, data


def _cut(width: int, shards: int):
    """Documents of a group and their open runs -> the runs' bytes by shard."""
    names = [x.split()[0] for x in _STRINGS.split(", ")]

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows or not marks.num_rows:
            return pa.Table.from_batches([_table(names, [])])
        row_of, offsets, data = _bounds_of(docs)
        x = _gather(marks, ("start", "windows", "anchor"))
        o = np.flatnonzero(x["anchor"] != 0)
        doc, shard = x["doc"][o], _shard(x["anchor"][o], shards)
        at = np.array([row_of[k] for k in zip(x["ids"].tolist(), x["keys"].tolist(), strict=True)], np.int64)
        start = offsets[at[doc]] + x["start"][o]
        size = x["windows"][o].astype(np.int64) + width - 1
        rows = []
        order = np.argsort(shard, kind="stable")
        s = shard[order]
        edges = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)) if len(s) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            p = order[a:b]
            index = np.repeat(start[p] - np.cumsum(size[p]) + size[p], size[p]) + np.arange(size[p].sum())
            rows.append((int(s[a]), _i64(x["ids"][doc[p]]), _i64(x["keys"][doc[p]]), _planes(x["start"][o][p]), size[p].astype(np.uint8).tobytes(), data[index].tobytes()))
        return pa.Table.from_batches([_table(names, rows)])

    return run


def _sort(width: int, buckets: int, in_memory: int, most_names: int):
    """Runs of a shard -> windows whose string a smaller identifier has, by the shard's suffix array."""
    names = [x.split()[0] for x in _MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        with tempfile.TemporaryFile(prefix="fq-suffix-") as file:  # the shard's text; of its runs, 21 bytes each are in memory
            for batch in batches:
                cols = [batch.column(n).to_pylist() for n in ("ids", "keys", "start", "sizes", "bytes")]
                for i, k, at, size, text in zip(*cols, strict=True):
                    for part, x in zip(parts, (np.frombuffer(i, np.int64), np.frombuffer(k, np.int64), _from_planes(at), np.frombuffer(size, np.uint8)), strict=True):
                        part.append(x)
                    file.write(text)
            file.flush()
            ids, keys, start, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
            data = np.memmap(file, np.uint8, "r") if len(ids) else np.zeros(0, np.uint8)
        if len(ids):
            for of, at, least in first_owner(data, np.cumsum(sizes.astype(np.int64)), ids, width, Scratch(in_memory), most_names):
                hit = least < ids[of]
                of, at = of[hit], at[hit]
                if len(of):
                    used, doc = np.unique(of, return_inverse=True)
                    yield _table(names, _mark_rows(ids[used], keys[used], doc, start[of] + at, np.ones(len(of), np.int64), np.zeros(len(of), np.uint32), buckets))

    return run


def _remove(width: int):
    """Documents of a group and their covered windows -> what is left of each text."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        offsets, data = string_bytes(docs.column("t"))
        rows = list(zip(docs.column("id").to_pylist(), docs.column("key").to_pylist(), strict=True))
        x = _gather(marks, ("start", "windows", "anchor")) if marks.num_rows else {"anchor": np.zeros(0, np.uint32), "doc": np.zeros(0, np.int64)}
        of: dict = {}
        keep = np.flatnonzero(x["anchor"] == 0)
        doc = x["doc"][keep]
        order = np.argsort(doc, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(doc[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            o = keep[order[a:b]]
            d = int(doc[order[a]])
            of.setdefault((int(x["ids"][d]), int(x["keys"][d])), []).append(o)
        out = []
        for n, k in enumerate(rows):
            text = data[offsets[n] : offsets[n + 1]]
            if k not in of:
                out.append((len(text), 0, 0, text.tobytes()))
                continue
            o = np.concatenate(of[k])
            first = x["start"][o].astype(np.int64)
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, np.minimum(first + x["windows"][o] + width - 1, len(text)), -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(text), int(gone.sum()), spans, text[~gone].tobytes()))
        return pa.Table.from_arrays([docs.column("id"), *[pa.array([r[c] for r in out], schema.types[c + 1]) for c in range(4)]], schema=schema)

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, groups: int | None = None, in_memory: int = IN_MEMORY, most_names: int = MOST_NAMES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the bytes that stay; they may cut a character).

    Texts are UTF-8 bytes, null is empty; texts under ``width`` bytes stay whole. Matches never cross documents, and a
    document does not cover itself: rows that repeat an identifier do not cover each other. A null identifier counts as
    larger than any other and stays null. ``groups`` (default: one for each GROUP_BYTES) bounds a group's texts; a single
    longer text is a group of its own and is worked on in pieces. A shard's arrays of over ``in_memory`` numbers are
    files, and over ``most_names`` names are ordered by recursion. Identical rows have identical results. Other columns,
    whatever their names, are not read. Empty input gives no rows.
    """
    if not 0 < width - gram < 255 - width:
        raise ValueError("gram must be shorter than width, and a run's windows must fit a byte")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("t"))
    groups = groups or 1 + (docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // GROUP_BYTES
    bucketed = docs.mapInArrow(_with_bucket(groups), "id long, key long, t string, bucket int")
    marks = materialise(docs.mapInArrow(_deal(width, gram, groups), _RUNS).groupBy("shard").applyInArrow(_decide(groups), _MARKS), "marks")
    strings = bucketed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut(width, groups), _STRINGS)
    sorted_ = materialise(strings.groupBy("shard").applyInArrow(_sort(width, groups, in_memory, most_names), _MARKS), "sorted")
    rows = bucketed.groupBy("bucket").cogroup(marks.union(sorted_).groupBy("bucket")).applyInArrow(_remove(width), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def _with_bucket(buckets: int):
    def run(batches):
        for batch in batches:
            bucket = _bucket(batch.column(0).to_numpy(), batch.column(1).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32))], names=["id", "key", "t", "bucket"])

    return run
