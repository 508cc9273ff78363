import random

import numpy as np
from pyspark.sql import functions as F

from framequarry import plans
from framequarry.operators import chains, nets, ranks


def best_weight(edges):
    if not edges:
        return 0.0
    a, b, w = edges[0]
    rest = best_weight(edges[1:])
    return rest if w <= 0 else max(rest, w + best_weight([e for e in edges[1:] if not {a, b} & set(e[:2])]))


def test_matching_is_the_best_of_all():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(2, 9)
        edges = [(a, b, rnd.choice([rnd.randrange(-2, 10), rnd.random() * 5])) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.6]
        taken = nets.maximum_matching(edges)
        ends = [x for p in taken for x in p]
        assert len(ends) == len(set(ends))
        assert abs(sum(w for a, b, w in edges if (a, b) in taken) - best_weight(edges)) < 1e-4
    assert nets.maximum_matching([]) == set() and nets.maximum_matching([(1, 1, 5.0)]) == set()


def test_matching_by_components(spark):
    rows = [(1, 2, 5.0), (2, 3, 6.0), (3, 4, 5.0), (10, 11, 1.0), (12, 12, 9.0), (20, 21, -1.0), (2, 1, 4.0)]
    got = {(r.a, r.b, r.weight) for r in nets.matching(spark.createDataFrame(rows, "a long, b long, w double"), "a", "b", "w").collect()}
    assert got == {(1, 2, 5.0), (3, 4, 5.0), (10, 11, 1.0)}


def test_chains_and_cycles(spark):
    end = lambda e, last: 2 * e + last
    links = [(end(1, 1), end(2, 0), 1.0), (end(2, 1), end(3, 1), 2.0), (end(5, 1), end(6, 0), 1.0), (end(6, 1), end(7, 0), 9.0), (end(7, 1), end(5, 0), 2.0), (end(8, 0), end(8, 1), 1.0)]
    got = {}
    for r in chains.ranked_chains(spark.createDataFrame(links, "a long, b long, cost double")).collect():
        got.setdefault(r.chain, []).append((r.place, r.edge, r.reversed))
    got = {k: [(e, v) for _, e, v in sorted(x)] for k, x in got.items()}
    assert [(1, False), (2, False), (3, True)] in got.values() or [(3, False), (2, True), (1, True)] in got.values()
    assert sorted(e for x in got.values() for e, _ in x) == [1, 2, 3, 5, 6, 7, 8]
    ring = next(x for x in got.values() if (5, False) in x or (5, True) in x)
    assert [e for e, _ in ring] in ([7, 5, 6], [6, 5, 7])  # cut between 6 and 7


def test_skeletons_of_simple_shapes():
    def drawn(*lines):
        m = np.zeros((30, 30), bool)
        for y0, x0, y1, x1 in lines:
            n = max(abs(y1 - y0), abs(x1 - x0)) + 1
            m[np.rint(np.linspace(y0, y1, n)).astype(int), np.rint(np.linspace(x0, x1, n)).astype(int)] = True
        return m

    assert [(u, v) for _, u, v, _ in nets.skeleton_graph(drawn((5, 3, 5, 25)))] == [(-2, -1)]
    cross = nets.skeleton_graph(drawn((15, 3, 15, 27), (3, 15, 27, 15)))
    assert len(cross) == 4 and all(v == 1000 and u < 0 for _, u, v, _ in cross)
    assert nets.skeleton_graph(np.zeros((6, 6), bool)) == []
    ring = nets.skeleton_graph(drawn((5, 15, 15, 25), (15, 25, 25, 15), (25, 15, 15, 5), (15, 5, 5, 15)))
    assert len(ring) == 1 and ring[0][1] == ring[0][2]


def test_places_over_all_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc") if rnd.random() < 0.9 else None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, k int").repartition(7)
    got = {(r.s, r.k): r.place for r in ranks.ranked(df, [F.desc("s"), F.col("k")], "place").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[1]))
    assert got == {r: n + 1 for n, r in enumerate(order)}


def test_chained_curves_use_each_end_once(spark, sf):
    q = plans.queries()
    cost = {(2 * r.ua + r.ta, 2 * r.ub + r.tb): 4 - r.cost for r in q["end_links"](spark, sf).collect()}
    taken = {(r.a, r.b) for r in q["end_matching"](spark, sf).collect()}
    ends = [x for p in taken for x in p]
    assert len(ends) == len(set(ends)) and taken <= set(cost)
    groups = {}
    for a, b in cost:  # components, by merging
        near = [g for g in groups.values() if a in g or b in g]
        merged = set().union({a, b}, *near)
        for x in merged:
            groups[x] = merged
    for g in {id(g): g for g in groups.values()}.values():
        edges = [(a, b, w) for (a, b), w in cost.items() if a in g]
        if len(edges) <= 16:
            assert abs(sum(w for a, b, w in edges if (a, b) in taken) - best_weight(edges)) < 1e-4
    greedy = {(r.a, r.b) for r in q["greedy_pairs"](spark, sf).collect()}
    assert greedy <= set(cost) and sum(cost[p] for p in greedy) <= sum(cost[p] for p in taken) + 1e-6
    seen = [r.edge for r in q["consolidated_chains"](spark, sf).collect()]
    assert sorted(seen) == sorted({x // 2 for x in ends}) and len(seen) == len(set(seen))


def test_inferred_flow_balances(spark, sf):
    """Wherever a flow was inferred, one of its nodes is in balance."""
    o = {r.o_orderkey: (r.o_custkey, r.o_orderkey % 1000 + 1_000_000) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    rows = {r.edge: r for r in plans.queries()["inferred_flow"](spark, sf).collect()}
    net, known = {}, {}
    for e, (u, v) in o.items():
        for node, sign in ((u, -1), (v, 1)):
            net[node] = net.get(node, 0) + sign * (rows[e].q or 0)
            known[node] = known.get(node, True) and rows[e].q is not None
    inferred = [e for e in o if rows[e].inferred]
    assert inferred and all(any(known[n] and abs(net[n]) < 1 for n in o[e]) for e in inferred)


def test_matcher_keeps_edges_not_all_pairs():
    import tracemalloc

    tracemalloc.start()
    nets._Matcher(2000, [(k, k + 1, 2) for k in range(1, 2000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_matcher_searches_around_each_node():
    """A long path, where prices prove the weight, does not cost the square of its nodes; triangles in a row shrink and open again."""
    import time

    rnd, n = random.Random(8), 6000
    path = [(k, k + 1, 1 + rnd.random()) for k in range(n)]
    began = time.monotonic()
    taken, price = nets.priced_matching(path)
    weight = lambda edges, pairs: sum(round(w * nets.PARTS) for a, b, w in edges if (a, b) in pairs)
    best, before = 0, 0
    for _, _, w in path:
        best, before = max(best, before + round(w * nets.PARTS)), best
    assert weight(path, taken) == best
    assert all(price[a] + price[b] >= round(w * nets.PARTS) / nets.PARTS and price[a] >= 0 for a, b, w in path)
    assert sum(price.values()) * nets.PARTS == best
    assert time.monotonic() - began < 30
    # triangles in a row: an edge of each, and every second link between them
    n = 300
    odd = [e for k in range(0, n, 3) for e in ((k, k + 1, 3.0), (k + 1, k + 2, 3.0), (k, k + 2, 3.0), (k + 2, k + 3, 1.0))][:-1]
    assert weight(odd, nets.maximum_matching(odd)) == (3 * (n // 3) + n // 6) * nets.PARTS


def test_matching_takes_few_links_of_many(spark):
    """Of a crowd where everything links to everything, with many equals, tasks see a part, and the weight is that of all links."""
    from framequarry.functions.lineage import cut

    rnd = random.Random(5)
    rows = [(a, b, rnd.choice([3.0, 3.0, 2.5, 1 + 2 * rnd.random()])) for a in range(90) for b in range(a + 1, 90) if a % 3 or b % 5]
    rows += [(100 + a, 200 + b, 1.0) for a in range(12) for b in range(30)] + [(300, 301, 0.5), (301, 302, 0.4), (303, 303, 1.0)]
    written = []

    def write(df):
        out = cut(df)
        written.append((out.columns, out.count()))
        return out

    got = nets.matching(spark.createDataFrame(rows, "a long, b long, w double").repartition(4), "a", "b", "w", write).collect()
    ends = [x for r in got for x in (r.a, r.b)]
    value = {(a, b): w for a, b, w in rows}
    assert len(ends) == len(set(ends)) and all(value[r.a, r.b] == r.weight for r in got)
    whole = lambda pairs: sum(round(value[p] * nets.PARTS) for p in pairs)
    assert whole((r.a, r.b) for r in got) == whole(nets.maximum_matching(rows))
    pairs = [n for c, n in written if {"a", "b"} <= set(c)]
    assert max(pairs[1:]) < len(rows) / 2


def test_matcher_goes_on_from_prices():
    """Edges added in parts, each time from the prices and pairs so far, give the weight of all edges."""
    rnd = random.Random(9)
    for _ in range(200):
        n = rnd.randrange(3, 14)
        edges = [(a, b, 2 * rnd.choice([4, 4, rnd.randrange(1, 30)])) for a in range(1, n) for b in range(a + 1, n + 1) if rnd.random() < 0.7]
        rnd.shuffle(edges)
        start = mate = None
        for part in (len(edges) // 3, 2 * len(edges) // 3, len(edges)):
            m = nets._Matcher(n, edges[:part], start, mate)
            m.run()
            start, mate = m.starts(), m.mate[1 : n + 1]
            assert all(not v or mate[v - 1] == u for u, v in enumerate(mate, 1))
            taken = [(u, v) for u, v in enumerate(mate, 1) if u < v]
            alone = nets.maximum_matching([(a, b, w / nets.PARTS) for a, b, w in edges[:part]])
            total = lambda pairs: sum(w for a, b, w in edges[:part] if (a, b) in pairs)  # noqa: E731, B023
            assert total(taken) == total(alone)
