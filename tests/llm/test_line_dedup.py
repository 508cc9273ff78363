from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.llm.cuckoo import CuckooFilter, buckets_for
from framequarry.llm.line_dedup import LineIndex, _hash, _probe, dedup_lines, delete, insert, references

SCHEMA = "doc_id long, text string"


def plain(rows, least=3, chars=20):
    """Every line of every row, held against all rows."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held, tops = Counter(), defaultdict(lambda: None)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k] += 1
                tops[k] = max(tops[k], i, key=lambda x: (x is not None, x or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (held[key(x)] >= least and tops[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found(index, docs, refs=None):
    return sorted((tuple(r) for r in dedup_lines(index, docs, refs).collect()), key=str)


def made(n, seed, first=0):
    rng = np.random.default_rng(seed)
    line = lambda: f"{'  ' * rng.integers(0, 2)}{'Line' if rng.integers(0, 2) else 'LINE'} of number {int(rng.zipf(1.3)) % 400:08d}\t"
    return [(first + k, "\n".join(line() if rng.integers(0, 5) else "short" for _ in range(rng.integers(1, 12)))) for k in range(n)]


@pytest.mark.parametrize("few_buckets", [False, True])
def test_filter_never_counts_too_low(few_buckets):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    counts = rng.integers(1, 4, 3000)
    f = CuckooFilter(8 if few_buckets else buckets_for(counts.sum()))
    f.add(np.repeat(keys, counts))
    assert (f.copies(keys) >= counts).all() and (len(f.stash) > 0) == few_buckets
    others = rng.integers(-(2**63), 2**63 - 1, 20_000)
    if not few_buckets:
        assert (f.copies(others) > 0).mean() < 0.001
    f = CuckooFilter(f.buckets, f.table.tobytes(), f.stash.tobytes())
    f.remove(np.repeat(keys[:2000], counts[:2000]))
    assert (f.copies(keys[2000:]) >= counts[2000:]).all()
    f.remove(np.repeat(keys[2000:], counts[2000:]))
    assert not f.table.any() and not len(f.stash)
    with pytest.raises(ValueError):
        f.remove(keys[:1])


def test_insertions_and_deletions_against_brute_force(spark):
    """Two insertions, one of which outgrows its filters, and a deletion: always as if made of what is left alone."""
    a, b = made(300, 1), made(900, 2, 1000)
    df = {k: spark.createDataFrame(v, SCHEMA) for k, v in (("a", a), ("b", b), ("ab", a + b))}
    one = insert(LineIndex.empty(spark, shards=2), references(df["a"]))
    assert found(one, df["a"]) == plain(a)
    two = insert(one, references(df["b"]))
    assert found(two, df["ab"]) == plain(a + b)
    gone = df["ab"].filter("doc_id % 3 = 1")
    three = delete(two, gone.select("doc_id"))
    left = [x for x in a + b if x[0] % 3 != 1]
    assert found(three, spark.createDataFrame(left, SCHEMA)) == plain(left)
    entries = lambda index: sorted(map(tuple, index.filters.select("shard", "entries").collect()))
    assert entries(three) == entries(insert(LineIndex.empty(spark, shards=2), references(spark.createDataFrame(left, SCHEMA))))
    back = insert(three, references(gone))
    assert found(back, df["ab"]) == plain(a + b) and entries(back) == entries(two)
    none = delete(back, df["ab"].select("doc_id"))
    assert none.filters.agg(F.sum("entries")).first()[0] == 0
    assert _probe(none, back.refs.select(_hash()).distinct()).filter("copies > 0").count() == 0
    # a document that no index holds is judged by the others
    assert found(one, df["b"].limit(0)) == []


def test_awkward_rows(spark):
    x, y = "a line of twenty marks", "\x0bA LINE OF TWENTY MARKS \r"
    rows = [(1, x), (2, y), (3, f"{x}\n{x}\nend"), (3, f"{y}\nother"), (None, x), (None, None), (4, ""), (5, "\n\n"), (6, "é" * 20), (7, "É" * 20), (8, "é" * 20), (9, "é" * 20 + "\n"), (10, "x" * 19), (11, "x" * 19), (12, "x" * 19)]
    rows += [(20, "the same row, again and again")] * 30 + [(None, "only without identifier")] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "n", "at", "lines", "gone", "text_hash", "top"):
        df = df.withColumn(name, F.lit(1))
    index = insert(LineIndex.empty(spark), references(df))
    assert found(index, df) == plain(rows)
    nothing = df.limit(0)
    assert found(insert(LineIndex.empty(spark), references(nothing)), nothing) == []
    assert found(index, df.limit(0)) == []


def test_long_text_and_common_line(spark):
    """One text of 60,000 lines, and a line in 3,000 documents: neither is worked on line by line against all others."""
    long = "\n".join(f"line number {k % 40_000} of a very long text" for k in range(60_000))
    rows = [(1, long), (2, long), (3, long + "\nend")] + [(k, f"a line that everybody has\nown {k}") for k in range(10, 3010)]
    df = spark.createDataFrame(rows, SCHEMA)
    refs = references(df)
    assert found(insert(LineIndex.empty(spark), refs), df, refs) == plain(rows)
