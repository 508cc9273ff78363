import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import chains, field_fit


def walked(links):
    """Chains by walking from end to end, rings cut at their dearest link."""
    other = {}
    for a, b, c in links:
        other[a], other[b] = (b, c), (a, c)
    edges = sorted({e // 2 for e in other})
    out, seen = [], set()

    def walk(edge, entry):
        first, place, end = edge, 0, entry
        while True:
            seen.add(end // 2)
            out.append((first, place, end // 2, bool(end % 2)))
            step = other.get(end ^ 1)
            if step is None or step[0] // 2 in seen:
                return
            end, place = step[0], place + 1

    for e in edges:
        for end in (2 * e, 2 * e + 1):
            if e not in seen and end not in other:
                walk(e, end)
    for e in edges:
        if e in seen:
            continue
        ring, end = [], 2 * e  # only cycles are left
        while True:
            step = other[end ^ 1]
            ring.append((-step[1], min(end ^ 1, step[0]), max(end ^ 1, step[0])))
            end = step[0]
            if end // 2 == e:
                break
        _, a, b = min(ring)
        del other[a], other[b]
        walk(a // 2, a)
    return out


def linked(rng, edges, rings=0.3):
    """Random chains and rings over the given edges, entered from either side."""
    links, left = [], list(edges)
    rng.shuffle(left)
    while left:
        n = rng.randrange(1, 9)
        part, left = left[:n], left[n:]
        ends = [2 * e + rng.randrange(2) for e in part]
        steps = list(zip(ends, ends[1:]))
        if rng.random() < rings:
            steps.append((ends[-1], ends[0]))
        links += [(a ^ 1, b, float(rng.randrange(5))) for a, b in steps]
    return links


def ranked(spark, links, nodes=None):
    got = chains.ranked_chains(spark.createDataFrame(links, "a long, b long, cost double"), nodes)
    return sorted(tuple(r) for r in got.collect())


def test_chains_against_walking(spark):
    links = linked(random.Random(5), range(100, 400))
    assert ranked(spark, links) == sorted(walked(links))
    assert ranked(spark, links[:0]) == []


def test_long_path_takes_few_rounds(spark, caplog):
    """A path of 20,000 edges in random order and directions."""
    rng = random.Random(7)
    order = list(range(20_000))
    rng.shuffle(order)
    ends = [2 * e + rng.randrange(2) for e in order]
    links = [(a ^ 1, b, 1.0) for a, b in zip(ends, ends[1:])]
    with caplog.at_level("INFO", "framequarry.operators.chains"):
        got = chains.ranked_chains(spark.createDataFrame(links, "a long, b long, cost double")).collect()
    places = {r.edge: r.place for r in got}
    want = {e: k for k, e in enumerate(order)}
    assert places == want or places == {e: 19_999 - k for e, k in want.items()}
    assert int(caplog.messages[0].split()[1]) <= 16


def test_chain_that_meets_itself_is_cut(spark):
    """Edges 1, 2, 3 in a row from node 5 back to node 5: cut at the dearest link; what is left begins and ends apart."""
    links = [(3, 4, 1.0), (5, 6, 2.0), (9, 10, 1.0)]
    at = {2: 5, 3: 6, 4: 6, 5: 7, 6: 7, 7: 5, 8: 1, 9: 2, 10: 2, 11: 3}
    nodes = spark.createDataFrame(list(at.items()), "end long, node long")
    assert ranked(spark, links, nodes) == [(1, 0, 1, False), (1, 1, 2, False), (3, 0, 3, False), (4, 0, 4, False), (4, 1, 5, False)]


def test_contracted_edges(spark):
    rows = [(1, 10, 11, 1), (2, 12, 11, 2), (3, 12, 13, 4), (4, 13, 14, 8), (5, 13, 15, 16), (6, 20, 21, 1), (7, 21, 22, 1), (8, 22, 20, 1), (9, 30, 30, 5), (10, 40, 41, 1), (11, 40, 41, 1)]
    got = chains.contracted(spark.createDataFrame(rows, "e long, u long, v long, len long"), "e", "u", "v", "len").collect()
    seen = sorted((r.edge, tuple(sorted((r.u, r.v))), r.length, r.edges) for r in got)
    rings = [s for s in seen if s[0] in (6, 7, 8, 10, 11)]
    assert [s for s in seen if s not in rings] == [(1, (10, 13), 7, 3), (4, (13, 14), 8, 1), (5, (13, 15), 16, 1), (9, (30, 30), 5, 1)]
    assert [(s[1][0] == s[1][1], s[2], s[3]) for s in rings] == [(True, 3, 3), (True, 2, 2)]


def dense(seed, columns, rows):
    """Random sparse systems: matrix, targets, penalties."""
    rng = np.random.default_rng(seed)
    out = {}
    for s, (n, m) in enumerate(zip(columns, rows)):
        a = np.where(rng.random((m, n)) < 0.3, rng.normal(size=(m, n)), 0) + (np.arange(m)[:, None] % n == np.arange(n))
        out[s] = (a, rng.normal(size=m), np.diff(np.eye(n), axis=0) * 0.3)
    return out


def system_tables(spark, out):
    entries = [(s, r, c, float(a[r, c])) for s, (a, _, _) in out.items() for r in range(a.shape[0]) for c in range(a.shape[1]) if a[r, c]]
    entries += [(s, 10_000 + r, c, float(p[r, c])) for s, (_, _, p) in out.items() for r in range(p.shape[0]) for c in range(p.shape[1]) if p[r, c]]
    targets = [(s, r, float(d[r])) for s, (_, d, _) in out.items() for r in range(len(d))]
    return spark.createDataFrame(entries, "system long, row long, col long, a double"), spark.createDataFrame(targets, "system long, row long, d double")


def scores(a, d, p, owners):
    h = a.T @ a + p.T @ p
    x, inverse = np.linalg.solve(h, a.T @ d), np.linalg.inv(h)
    out = {}
    for o in set(owners):
        c = [k for k, w in enumerate(owners) if w == o]
        out[o] = x[c] @ np.linalg.solve(inverse[np.ix_(c, c)], x[c]) / max(np.sum((a[:, c] @ x[c]) ** 2), 1e-12)
    return x, out


def test_joint_fit_equals_a_dense_one(spark):
    """Systems of 1 to 40 coefficients in the same rounds; unique shares by two coefficients a vessel; dropping in order."""
    out = dense(3, [1, 6, 12, 40], [5, 30, 50, 200])
    entries, targets = system_tables(spark, out)
    owners = spark.createDataFrame([(c, c // 2) for c in range(40)], "col long, owner long")
    x, inverse = field_fit.fitted(entries, targets)
    got = {(r.system, r.i): r.x for r in x.collect()}
    share = {(r.system, r.owner): r.score for r in field_fit.unique_shares(entries, targets, owners, x, inverse).collect()}
    for s, (a, d, p) in out.items():
        want, score = scores(a, d, p, [c // 2 for c in range(a.shape[1])])
        assert np.allclose([got[s, c] for c in range(len(want))], want, atol=1e-8)
        assert all(abs(share[s, o] - v) < 1e-6 * max(1, v) for o, v in score.items())


def test_dropping_goes_on_until_all_are_needed(spark):
    out = dense(8, [8, 12], [20, 25])
    entries, targets = system_tables(spark, out)
    owners = [c // 2 for c in range(12)]
    near = {(s, o, q) for s in out for o in range(6) for q in range(6) if abs(o - q) == 1}
    fate, fits = field_fit.settle(entries, targets, spark.createDataFrame(list(enumerate(owners)), "col long, owner long"), spark.createDataFrame(list(near), "system long, owner long, other long"), least=0.9)
    fate, fits = {(r.system, r.owner): r.dropped_in for r in fate.collect()}, {(r.system, r.col): r.x for r in fits.collect()}
    for s, (a, d, p) in out.items():
        left, k = list(range(a.shape[1])), 0
        while True:
            k += 1
            x, score = scores(a[:, left], d, p[:, left], [owners[c] for c in left]) if left else ([], {})
            batch = []
            for o in sorted(score, key=lambda o: (score[o], o)):
                if score[o] < 0.9 and not any((s, o, b) in near for b in batch):
                    batch.append(o)
            if not batch:
                break
            assert all(fate[s, o] == k for o in batch)
            left = [c for c in left if owners[c] not in batch]
        assert {o for (t, o), v in fate.items() if t == s and v is None} == {owners[c] for c in left}
        assert np.allclose([fits[s, c] for c in left], x, atol=1e-8) and k > 1


def test_solver_says_when_it_does_not_get_there(spark):
    h = spark.createDataFrame([(0, i, j, 1.0 / (i + j + 1)) for i in range(12) for j in range(12)], "system long, i long, j long, h double")
    rhs = spark.createDataFrame([(0, 0, i, 1.0) for i in range(12)], "system long, rhs long, i long, g double")
    with pytest.raises(ArithmeticError, match="1 right sides"):
        field_fit.conjugate_gradients(h, rhs, most=3)
    empty = field_fit.conjugate_gradients(h.filter("i < 0"), rhs.filter("i < 0"))
    assert empty.count() == 0
    lone = field_fit.conjugate_gradients(h.filter("i = 0 and j = 0"), rhs.filter(F.col("i") < 2))
    assert sorted((r.i, r.x) for r in lone.collect()) == [(0, 1.0), (1, 0.0)]


def test_systems_solved_outright_as_by_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(s, r, c, float(rng.normal())) for s in range(3) for r in range(9) for c in range(2 + s) if rng.random() < 0.8]
    entries = spark.createDataFrame(rows, "system long, row long, col long, a double")
    targets = spark.createDataFrame([(s, r, float(rng.normal())) for s in range(3) for r in range(9)], "system long, row long, d double")
    for direct in (64, 3):  # all systems outright; the largest by rounds
        x, inverse = field_fit.fitted(entries, targets, direct=direct)
        got, inv = {(r.system, r.i): r.x for r in x.collect()}, {(r.system, r.k, r.i): r.v for r in inverse.collect()}
        d = {(r.system, r.row): r.d for r in targets.collect()}
        for s in range(3):
            a = np.zeros((9, 2 + s))
            for q, r, c, v in rows:
                if q == s:
                    a[r, c] = v
            want = np.linalg.lstsq(a, np.array([d[s, r] for r in range(9)]), rcond=None)[0]
            assert np.allclose([got[s, c] for c in range(2 + s)], want, atol=1e-8)
            assert np.allclose([[inv[s, k, c] for c in range(2 + s)] for k in range(2 + s)], np.linalg.inv(a.T @ a), atol=1e-8)


def test_fit_broadcasts_nothing_that_grows(spark):
    entries = spark.createDataFrame([(s, 0, 0, 1.0) for s in range(50)], "system long, row long, col long, a double")
    targets = spark.createDataFrame([(s, 0, 2.0) for s in range(50)], "system long, row long, d double")
    for t in (*field_fit.normal_equations(entries, targets), field_fit.weakest_apart(targets.select("system", F.col("row").alias("owner"), F.col("d").alias("score")), entries.select("system", F.col("row").alias("owner"), F.lit(1).cast("long").alias("other")))):
        assert "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()


def test_components_shrink_the_graph(spark):
    """Random components, a path in a bad order, a star and a loop; edges that are settled are not written again."""
    import numpy as np

    from framequarry.functions.lineage import cut
    from framequarry.operators.graph import components

    rng = np.random.default_rng(7)
    path = [1000 + int(k) for k in rng.permutation(40)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + list(zip(path, path[1:], strict=False)) + [(9999, 2000 + k) for k in range(50)] + [(5000, 5000)]
    label = {x: x for p in pairs for x in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    widths = []

    def write(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            widths.append(out.count())
        return out

    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u long, v long"), "u", "v", write).collect()}
    assert got == label
    assert len(widths) > 1 and widths[-1] == 0
    assert all(b < a for a, b in zip(widths, widths[1:], strict=False))


def test_ranking_a_long_chain_writes_few_rows(spark, monkeypatch):
    monkeypatch.setattr(chains, "REST", 16, raising=False)
    seen = []

    def write(df):
        df = df.localCheckpoint()
        seen.append(df.count())
        return df

    n = 600
    order = [(k * 1009) % n for k in range(n)]  # places and numbers have nothing in common
    chain = [(2 * a + 1, 2 * b, 1.0) for a, b in zip(order, order[1:])]
    ring = [(2 * a + 1 - a % 2, 2 * b + b % 2, float(b)) for a, b in zip(range(5000, 5090), [*range(5001, 5090), 5000])]  # every other edge turned, dearest into 5089
    links = spark.createDataFrame(chain + ring, "a long, b long, cost double")
    got = {r.edge: (r.chain, r.place, r.reversed) for r in chains.ranked_chains(links, write=write).collect()}
    turned = 2 * order[0] > 2 * order[-1] + 1
    want = {e: (order[-1], n - 1 - k, True) if turned else (order[0], k, False) for k, e in enumerate(order)}
    # 5088 and 5089 are the free ends of the ring; from the smaller one it goes down to 5000, then to 5089
    want |= {e: (5088, 5088 - e if e < 5089 else 89, e % 2 == 0) for e in range(5000, 5090)}
    assert got == want
    assert sum(seen) < 14 * (n + 90)  # by doubling, each of ten rounds wrote both directions of every edge
