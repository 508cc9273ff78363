import collections
import random
import re

import numpy as np

from framequarry.llm.components import components
from framequarry.llm.near_dedup import CHANCE, FINE, fine_registers, near_duplicates
from framequarry.llm.text_kernels import mix64, shingle_sets

SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, words=5, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    having = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    both = collections.Counter((a, b) for ids in having.values() for n, b in enumerate(ids) for a in ids[:n])
    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def check(spark, rows):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_small_documents_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        base = [rnd.choice("aBcdefghij") + str(rnd.randrange(500)) for _ in range(rnd.choice([1, 3, 5, 7, 8, 9, 12, 30, 80, 300]))]
        for _ in range(rnd.randrange(1, 7)):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, len(w) // 25) + 1)):
                w[rnd.randrange(len(w))] = "Z" + str(rnd.randrange(99))
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    check(spark, rows + [(5000, None), (5001, ""), (5002, " \n\t")])


def test_group_whose_members_link_only_through_others(spark):
    """A large group round a base that is neither first nor linked with all."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    check(spark, rows + [(500, " ".join(base))])


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, 2), (3, "a b c d e f", None, 1), (3, "zz", 1, 1), (9, "zz", 1, 1)], "doc_id long, text string, n long, label long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (9, 3, False), (None, 3, False)]
    a, b = "a b c d e f", "p q r s t u"
    rows = [(1, a), (2, b), (None, a), (None, b), (None, "x y z"), (None, "x y z"), (None, None), ((1 << 63) - 1, "m n o"), (None, "m n o"), (-(1 << 63), "k l")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    top, low = (1 << 63) - 1, -(1 << 63)
    assert got == sorted([(1, 1, True), (2, 2, True), (None, 1, False), (None, 2, False), (None, None, True), (None, None, False), (None, None, True), (top, top, True), (None, top, False), (low, low, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_keys_do_not_change_results(spark, monkeypatch):
    """With a bound so low that copies, bands, heads and labels are looked up as hot ones."""
    from framequarry.llm import common, near_dedup

    for module in (common, near_dedup):
        monkeypatch.setattr(module, "LEAST_HOT", 3)
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 10)
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(k % 4):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    template = " ".join(f"t{k}" for k in range(30))
    rows += [(200 + k, template + " " + " ".join(f"u{k}_{j}" for j in range(22))) for k in range(40)]  # alike, but below the threshold
    check(spark, rows)


def test_pairs_near_the_threshold_are_found(spark):
    """400 pairs at a similarity of 0.75 to 0.8, all apart from each other."""
    rnd, rows = random.Random(12), []
    for k in range(400):
        n = rnd.randrange(40, 200)
        w = [f"p{k}_{j}" for j in range(n)]
        m = n - 4
        cut = next(c for c in range(m, 0, -1) if 100 * c < 75 * (2 * m - c)) + 1  # shingles in common
        v = w[: cut + 4] + [f"q{k}_{j}" for j in range(m - cut)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    component = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: c for i, (_, c) in brute(rows).items()} == {2 * k + d: 2 * k for k in range(400) for d in (0, 1)}
    assert sum(component[2 * k + 1] != 2 * k for k in range(400)) == 0


def test_very_long_text(spark):
    rnd = random.Random(1)
    w = [f"q{rnd.randrange(50000)}" for _ in range(200_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:190_000])), (3, " ".join(w[:90_000]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_words_are_runs_of_other_than_ascii_space():
    texts = ["A b\tC\x0bd\re f", "a b c d e f", "a b c"]
    raw = [t.encode() for t in texts]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2 and len(sets[2]) == 1


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(1)
    x, y = (np.sort(mix64(rng.integers(0, 2**62, 20_000).astype(np.uint64))) for _ in range(2))
    a, b = fine_registers(x), fine_registers(y)
    assert abs(float((a == b).mean()) - CHANCE) < 5 * (CHANCE / FINE) ** 0.5
    z = np.sort(np.concatenate([x[:16_000], y[:4_000]]))
    seen = float((fine_registers(z) == a).mean())
    assert abs((seen - CHANCE) / (1 - CHANCE) - 16 / 24) < 0.12


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}
