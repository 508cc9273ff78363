import random

import numpy as np
import pytest

from framequarry.llm.suffix_dedup import _bucket, _least_of_equal, suffix_dedup
from framequarry.llm.suffix_kernels import PIECE, Scratch, runs_of, suffix_array

SCHEMA = "doc_id long, text string"


def brute(rows, w=50):
    rank = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - w + 1):
            first[b[k : k + w]] = min(first.get(b[k : k + w], 1 << 63), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] < rank(i):
                gone[k : k + w] = b"\1" * w
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows):
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows)


def test_shared_passages_in_other_contexts(spark):
    rnd = random.Random(2)
    words = ["the", "of", "and", "einß", "nté", "stion", "a"]
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    passages = [text(rnd.randrange(5, 60)) for _ in range(12)]
    rows = []
    for k in range(200):
        s = text(rnd.randrange(0, 50))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            s = s[: len(s) // 2] + " " + p[rnd.randrange(len(p)) // 3 :] + s[len(s) // 2 :]
        if rnd.random() < 0.1:
            s = "x" * rnd.randrange(40, 200) + s
        if rows and rnd.random() < 0.1:
            s = rnd.choice(rows)[1]
        rows.append((k * 7 % 251, s))
    check(spark, rows + [(600, None), (601, ""), (None, passages[0] * 2), (5, passages[1] * 2), (5, passages[2] * 3), (5, passages[1] * 2)])


def test_ties_and_edges(spark):
    a = "".join(chr(97 + k % 23) for k in range(50))
    check(spark, [(1, a), (2, a), (2, a), (3, a[:-1]), (4, "é" + a + a), (5, a * 40), (6, "z" * 49), (7, "z" * 51), (8, "z" * 50)])
    check(spark, [])


@pytest.mark.parametrize(("limit", "most"), [(10**6, 10**6), (20, 10**6), (20, 3)])
def test_suffix_array(limit, most):
    """In memory, in files, and with recursion; order and common prefixes."""
    rnd = random.Random(4)
    for k in range(60):
        n, symbols = rnd.randrange(1, 300), rnd.choice([1, 2, 5, 200])
        t = [rnd.randrange(1, symbols + 1) for _ in range(n)] + [0]
        t = (t[:20] * 15)[:n] + [0] if k % 3 == 0 and n >= 20 else t
        order, common = suffix_array(np.array(t, np.int32), 10**6, scratch=Scratch(limit), most=most, cap=50)
        want = sorted(range(n + 1), key=lambda i: t[i:])
        assert order.tolist() == want
        shared = lambda i, j: next((k for k in range(50) if t[i + k] != t[j + k]), 50)
        assert common[:-1].tolist() == [0] + [shared(i, j) for i, j in zip(want, want[1:], strict=False)]


def test_shards_in_files(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5)))
    passage = " ".join(word() for _ in range(40))
    rows = [(k, " ".join(word() for _ in range(30)) + passage[rnd.randrange(20) : 60 + rnd.randrange(20)] + word() * 9) for k in range(120)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), groups=2, in_memory=64, most_names=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows)


def test_one_anchor_in_many_contexts():
    """Contexts of one gram are told apart, however many: nothing is merged."""
    n = 250_000
    gram = b"#" * 24
    rnd = np.random.default_rng(1)
    noise = rnd.integers(97, 123, (n, 52), dtype=np.uint8)
    text = np.concatenate([noise[:, :26], np.tile(np.frombuffer(gram, np.uint8), (n, 1)), noise[:, 26:]], axis=1)
    _, _, _, anchor, first, second = runs_of(text.ravel(), np.arange(n + 1) * 76, 50, 24)
    assert len(np.unique(anchor)) < len(anchor)
    _, new, covered = _least_of_equal(anchor.astype(np.uint32), first, second, np.arange(len(anchor)))
    assert new.all() and not covered.any()


def test_copies_of_one_text_are_spread():
    bucket = _bucket(np.arange(20_000), np.full(20_000, 12345), 11)
    assert np.bincount(bucket).max() <= 2 * 20_000 / 11


def test_very_long_text(spark):
    """Over several pieces, with a passage across their border."""
    rnd = random.Random(8)
    long = "".join(rnd.choices("abcdefgh ", k=3 * PIECE + 5000))
    rows = [(3, long), (2, long[PIECE - 300 : PIECE + 300]), (4, long), (1, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: (len(long), 600, 1), 2: (600, 0, 0), 4: (len(long), len(long), 1), 1: (0, 0, 0)}
