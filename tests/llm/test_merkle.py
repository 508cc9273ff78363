import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from framequarry.llm import queries as Q
from framequarry.llm.merkle import FIELDS, digest_of, folded, merkle_manifest, siblings_digest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def proofs(nodes, fanout):
    """Root, and each node's siblings as (left, right), by climbing one node at a time."""
    out, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(at):
            first = j - j % fanout
            out[i].append(("".join(nodes[first:j]), "".join(nodes[j + 1 : first + fanout])))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [j // fanout for j in at]
    return nodes[0], out


def expected(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: (sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for g in names}
    inner = {g: proofs([x[1] for x in done[g]], fanout) for g in names}
    root, outer = proofs([inner[g][0] for g in names], fanout)
    return sorted(((i, leaf, inner[g][0], root, tuple(inner[g][1][k] + outer[j])) for j, g in enumerate(names) for k, (i, leaf) in enumerate(done[g])), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 3), (3, 2), (8, 3)])
def test_manifest_against_brute_force(spark, fanout, levels):
    rows = [(k, f"s{k % 3}", [None, "", "en", "fr", "é", "=x"][min(k % 11, 5)], k if k % 4 else None, None if k % 13 == 0 else f"Text {k}\n" * (k % 5)) for k in range(150)]
    rows += [(None, None, "en", None, None), (None, None, "en", None, "b"), (7, "x", "one of its own", 1, "A" * 50_000)] + [(200, "s", "fr", 1, "again")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("g", "index", "n", "item", "node", "probe", "copies", "piece", "block", "root"):
        df = df.withColumn(name, F.lit("other"))
    got = merkle_manifest(df, fanout=fanout, levels=levels)
    seen = got.withColumn("back", folded(F.col("leaf"), F.col("proof"))).collect()
    want = expected([r.asDict() for r in df.collect()], fanout)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in seen), key=str) == want
    assert all(r.back == r.root and r.probe is None for r in seen)


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(3, None, "en", 2, "ab")], SCHEMA)
    row = merkle_manifest(one).select("*", siblings_digest(F.col("proof")).alias("d")).first()
    assert row.leaf == row.subroot == row.root == h("1:3-2:en1:22:ab") and row.proof == [] and row.d == h("")
    assert merkle_manifest(one.limit(0)).collect() == []


def test_tampered_rows_are_found(spark, tmp_path):
    rows = [(k, "s", "en", 1, "ABC" if k % 2 else "abc") for k in range(40)] + [(None, "s", "en", 1, "ABC"), (41, "s", "de", 1, None), (42, "s", "de", 1, None), (43, None, "de", None, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[4] for x in rows if x[0] == r.doc_id)
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text != (text and text.lower())
        assert r.verified == (not touched) == (r.folded_root == r.root)
    assert {r.verified for r in got} == {True, False}


def test_fields_cannot_run_together(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("-", "c"), ("", "c")], "x string, y string")
    assert df.select(digest_of(df.x, df.y)).distinct().count() == 5
