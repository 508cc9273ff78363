from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framequarry import plans
from framequarry.functions import stats
from framequarry.operators import curves, graph, integrity, series, spatial
from framequarry.streaming import live


def test_no_spread_means_no_score(spark):
    df = spark.createDataFrame([(1, 5.0)] * 4 + [(2, 1.0), (2, 2.0), (2, 9.0), (2, None)], "g int, x double")
    z = df.join(stats.median_mad(df, ["g"], "x"), "g").select("g", "x", stats.robust_z(F.col("x"), F.col("med"), F.col("mad")).alias("z")).collect()
    assert {r.z for r in z if r.g == 1} == {0.0}
    assert [round(r.z, 4) for r in z if r.x == 9.0] == [round(7 / 1.4826, 4)] and [r.z for r in z if r.x is None] == [None]
    assert spark.range(1).select(stats.clean(F.lit(float("nan"))).alias("x")).first().x is None


def test_evenly_spaced_is_numpy_s(spark):
    for n in (1, 2, 7, 100, 997):
        got = spark.range(1).select(stats.evenly_spaced(F.lit(n), 8).alias("x")).first().x
        assert got == np.linspace(0, n - 1, 8).astype(int).tolist()
    assert spark.range(1).select(stats.evenly_spaced(F.lit(5), 1).alias("x")).first().x == [0]


def test_grid_join_is_all_pairs(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1, 1, (200, 2))
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "i int, x double, y double")
    got = {(r.a, r.b) for r in spatial.radius_pairs(df, "i", "x", "y", 0.2).collect()}
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    assert got == {(a, b) for a in range(200) for b in range(a + 1, 200) if d[a, b] <= 0.2}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 6), (2, 4, 3), (5, 5, 1)], "u int, v int, q int")
    nodes = {r.node: r for r in graph.node_balance(edges, "u", "v", "q").collect()}
    assert [nodes[k].kind for k in (1, 2, 3)] == ["inlet", "divergent", "outlet"] and abs(nodes[2].residual - 0.1) < 1e-9
    depth = {r.node: r.depth for r in graph.depths(edges, "u", "v", spark.createDataFrame([(1,)], "node int"), 5).collect()}
    assert depth == {1: 0, 2: 1, 3: 2, 4: 2}


def test_curves(spark):
    pts = [(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 3.0, 0.0), (3, 3.0, 4.0), (4, 6.0, 4.0)]
    df = curves.without_repeats(spark.createDataFrame([("c", *p) for p in pts], "c string, i int, x double, y double"), "c", "i", "x", "y")
    r = curves.tortuosity(df, "c", "i", "x", "y").first()
    assert (r.points, r.length, r.inflections) == (4, 10.0, 1) and abs(r.chord - 52**0.5) < 1e-9 and abs(r.turning - np.pi) < 1e-9


def test_interpolation_holds_its_ends(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 1.0, None, None, 4.0, None])], "g string, i int, v double")
    assert [r.filled for r in series.interpolated(df, ["g"], "i", "v").orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_safe_members(spark):
    cases = {"b/x.tif": True, "b/c/x.tif": True, "b": False, "/b/x": False, "b/../x": False, "b/./x": False, "c/x": False, "b\\x/y": False, "b//x": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", integrity.safe_member(F.col("p"), F.lit("b")).alias("ok")).collect()} == cases


def test_live_stream_locks_loses_and_locks_again(spark, tmp_path):
    values = [100.0] * 30 + [10.0] * 10 + [10.0] * 30 + [None]
    pd.DataFrame({"stream": "s", "index": range(len(values)), "value": values}).to_parquet(tmp_path / "a.parquet")
    src = live.replay(spark, f"file://{tmp_path}", "stream string, index bigint, value double")
    src_query = live.anchored_fade(src).writeStream.format("memory").queryName("fade").outputMode("append").trigger(availableNow=True).start()
    src_query.awaitTermination()
    rows = {r["index"]: r for r in spark.table("fade").collect()}
    assert rows[10].state == "locking" and rows[28].registered and abs(rows[28].offset) < 1e-9
    assert not rows[31].registered and rows[37].state == "lost" and rows[66].registered and abs(rows[66].offset) < 1e-9
    assert rows[70].offset is None


def plain_write(spark):
    return lambda df: spark.createDataFrame(df.collect(), df.schema)


def test_graph_fix_points(spark):
    write = plain_write(spark)
    chain = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(50, 60)], "u int, v int")
    assert {r.node: r.label for r in graph.components(chain, "u", "v", write).collect()} == {**dict.fromkeys(range(21), 0), 50: 50, 60: 50}
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 4.0, 3.0), (9, 7.0, 7.0)], "node int, x double, y double")
    got = {r.node: (r.into, r.x, r.y) for r in graph.merged_nodes(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), nodes, write).collect()}
    assert got == {1: (1, 2.0, 1.0), 2: (1, 2.0, 1.0), 3: (1, 2.0, 1.0), 9: (9, 7.0, 7.0)}
    edges = spark.createDataFrame([(1, 2, 30.0), (2, 3, 30.0), (2, 4, 5.0), (3, 5, 40.0), (3, 6, 3.0)], "u int, v int, len double")
    assert {(r.u, r.v) for r in graph.without_spurs(edges, "u", "v", "len", 10, write=write).collect()} == {(1, 2), (2, 3), (3, 5)}
    pairs = graph.passed_through(spark.createDataFrame([(1, 1, 2, 3.0), (2, 2, 3, 4.0), (3, 3, 4, 1.0), (4, 3, 5, 1.0)], "e int, u int, v int, len double"), "e", "u", "v", "len")
    assert [tuple(r) for r in pairs.collect()] == [(2, 1, 2, 7.0)]


def test_flow_is_inferred_by_conservation(spark):
    rows = [(1, 1, 2, 10.0), (2, 2, 3, 6.0), (3, 2, 4, None), (4, 5, 4, 1.0), (5, 4, 6, None), (6, 7, 8, None)]
    got = {r.edge: (r.q, r.inferred) for r in graph.oriented(spark.createDataFrame(rows, "e int, u int, v int, q double"), "e", "u", "v", "q", write=plain_write(spark)).collect()}
    assert got == {1: (10.0, False), 2: (6.0, False), 3: (4.0, True), 4: (1.0, False), 5: (5.0, True), 6: (None, False)}


def test_matching(spark):
    rows = [(1, 2, 1.0), (2, 3, 0.5), (3, 4, 1.0), (1, 4, 3.0), (5, 6, 2.0), (6, 5, 1.5), (7, 7, 0.1)]
    got = {(r.a, r.b, r.cost) for r in graph.greedy_matching(spark.createDataFrame(rows, "a int, b int, c double"), "a", "b", "c", write=plain_write(spark)).collect()}
    assert got == {(2, 3, 0.5), (1, 4, 3.0), (5, 6, 1.5)}


def test_graph_queries_read_all_orders(spark, sf):
    """Against plain loops over every order."""
    q = plans.queries()
    edges = {(r.o_custkey, r.o_orderkey) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    label = {}
    for root in sorted(near):
        if root in label:
            continue
        steps, front = {root: 0}, [root]
        while front:
            front = sorted({b for a in front for b in near[a]} - set(steps))
            steps |= {b: max(steps.values()) + 1 for b in front}
        label |= dict.fromkeys(steps, root)
    assert {r.node: r.label for r in q["graph_components"](spark, sf).collect()} == label
    left = dict.fromkeys(edges, 0) | {(a, b): a % 13 + b % 7 + 1 for a, b in edges}
    rounds = 0
    while True:
        d = Counter(x for e in left for x in e)
        spurs = [e for e in left if left[e] < 6 and min(d[e[0]], d[e[1]]) == 1 and max(d[e[0]], d[e[1]]) > 2]
        if not spurs:
            break
        rounds += 1
        for e in spurs:
            del left[e]
    assert {r.edge: r.length for r in q["spur_pruning"](spark, sf).collect()} == {f"{a}:{b}": n for (a, b), n in left.items()} and rounds >= 1


def test_depths_go_to_the_end(spark):
    path = spark.range(12).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    root = spark.range(1).select(F.col("id").alias("node"))
    assert {r.node: r.depth for r in graph.depths(path, "u", "v", root).collect()} == {k: k for k in range(13)}


def test_spurs_go_to_the_end(spark):
    """A binary tree of twelve levels loses one a round, down to the two edges of its root."""
    tree = spark.range(2, 1 << 13).select((F.col("id") / 2).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1).alias("len"))
    assert {(r.u, r.v) for r in graph.without_spurs(tree, "u", "v", "len", 5, rounds=None).collect()} == {(1, 2), (1, 3)}


def test_line_queries_read_all_lines(spark, sf):
    """Every edge has its places, every pair its cheapest candidate, owners of any number share pixels."""
    q, lines = plans.queries(), spark.read.parquet(f"{sf}/lineitem.parquet")
    assert q["place_along_edge"](spark, sf).count() == lines.count()
    pairs = lines.select(F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")).distinct().count()
    assert q["cheapest_pair"](spark, sf).count() == pairs
    owners = lines.select("l_suppkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    met = q["pixel_overlap_pairs"](spark, sf).agg(F.sum("n")).first()[0]
    assert 0 < met <= owners.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]


def test_greedy_matching_goes_to_the_end(spark):
    """On a path with rising costs only one pair a round is the cheapest at both ends: 51 rounds for 102 edges."""
    path = spark.range(102).coalesce(1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("id").cast("double").alias("cost"))
    got = {(r.a, r.b) for r in graph.greedy_matching(path, "a", "b", "cost").collect()}
    assert got == {(k, k + 1) for k in range(0, 102, 2)}


def test_depths_shuffle_each_edge_once(spark):
    from framequarry.operators import graph

    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (3, 3), (4, 5), (6, None)], "u int, v int")
    got = {r.node: r.depth for r in graph.depths(edges, "u", "v", spark.createDataFrame([(1,)], "node int"), write=write).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    assert plans[0].count("Exchange hashpartitioning") == 1


def test_greedy_matching_lists_few(spark, monkeypatch):
    """Where every round takes one pair, all candidates are written once, not in every round; ends that wait go on."""
    import random

    from framequarry.functions.lineage import cut

    monkeypatch.setattr(graph, "LISTED", 4, raising=False)
    rnd, n = random.Random(6), 24
    rows = [(a, b, float(a) if b == a + 1 else 100 + rnd.choice([1.0, 1.0, rnd.random()])) for a in range(n) for b in range(a + 1, n)]
    rows += [(50 + a, 70 + b, 7.0) for a in range(9) for b in range(6)] + [(1, 1, 0.0), (3, 2, 0.5)]
    sizes = []

    def write(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    want, used = set(), set()
    for c, a, b in sorted((c, min(a, b), max(a, b)) for a, b, c in rows if a != b):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b, c))
    for swept in (1 << 20, 0, 30):
        monkeypatch.setattr(graph, "SWEPT", swept, raising=False)
        sizes.clear()
        got = graph.greedy_matching(spark.createDataFrame(rows, "a long, b long, c double").repartition(3), "a", "b", "c", write=write).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert sum(k > len(rows) / 2 for k in sizes) <= 2
