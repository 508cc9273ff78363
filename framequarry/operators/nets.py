"""Graph operators that need a whole component at once: exact matching of ends, skeletons as graphs.

Components come from a fix point over tables; what is here runs on one component's rows (of a matching, on a few links of
each node), so that must fit a task.
"""

from __future__ import annotations

import heapq
import logging
from array import array
from bisect import bisect_left
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small
from ..functions.lineage import cut
from .graph import components
from .pictures import dilate, labelled, thinned, window_inside

log = logging.getLogger(__name__)

#: Weights are compared as whole numbers of this many parts.
PARTS = 1 << 20
#: Links of a node that a round of ``matching`` adds.
MOST = 8


class _Matcher:
    """Maximum-weight matching in a general graph by shrinking odd cycles, with a price for each node and cycle.

    Nodes are 1 to n, shrunk cycles n + 1 to 2n. Free nodes look for a partner one after the other: a tree of tight edges
    grows from one of them until it meets another free node, or a node of price 0, which gives up its partner. So a
    search sees what lies around its node, not the whole graph. What changes in a search is kept as a part that stands still and
    a ``sign`` times ``now``, how far the search has come. Memory is that of the edges.
    """

    def __init__(self, n: int, edges: list[tuple[int, int, int]], start: list[int] | None = None, mate: list[int] | None = None):
        """``start`` and ``mate`` (0: none) of the nodes from 1 on: where an earlier matching, before edges were added, has got."""
        self.n = n
        m = 2 * n + 2
        rows = np.asarray(edges, np.int64).reshape(-1, 3)
        rows = rows[rows[:, 2] > 0]
        rows = np.concatenate([rows, rows[:, [1, 0, 2]]])
        rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]
        at = np.searchsorted(rows[:, 0], np.arange(n + 2))
        #: the other ends of a node's edges, ascending, and what the edges are worth
        self.ends, self.worth = ([array("q", rows[i:j, c].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)] for c in (1, 2))
        #: of nodes, then of cycles: the price is price + sign * now
        self.price, self.sign, self.now = [max(w, default=0) for w in self.worth] + [0] * (m - n - 1), [0] * m, 0
        self.mate, self.top, self.parent = [0] * m, list(range(m)), [0] * m
        if start is not None:
            self.price[1 : n + 1] = start
            for u in range(1, n + 1):  # an edge that is worth more raises one of its ends
                self.price[u] = max(self.price[u], self.cheapest(u))
            for u, v in enumerate(mate, 1):  # pairs stay where their edge is tight
                if v and self.price[u] + self.price[v] == 2 * self.worth[u][bisect_left(self.ends[u], v)]:
                    self.mate[u] = v
        self.base = list(range(m))
        self.ring: list[list[int]] = [[] for _ in range(m)]
        #: steps[b][k] is the edge from a node of ring[b][k] to one of the next
        self.steps: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        #: of tops: 0, 1 (outer) or 2 (inner), and the edge by which the tree came in
        self.kind, self.way = [0] * m, [None] * m
        self.free = list(range(m - 1, n, -1))
        self.events: list[tuple[int, int, int, int, int]] = []
        self.queue: list[int] = []
        self.soonest: dict[int, int] = {}
        self.seen: set[int] = set()
        self.limit = 0

    def near(self, u: int):
        return zip(self.ends[u], self.worth[u])  # noqa: B905

    def cheapest(self, u: int) -> int:
        """The lowest price that the node's edges allow."""
        price = self.price
        return max(max((2 * w - price[v] for v, w in self.near(u)), default=0), 0)

    def cost(self, x: int) -> int:
        return self.price[x] + self.sign[x] * self.now

    def moves(self, x: int, sign: int) -> None:
        self.price[x] += (self.sign[x] - sign) * self.now
        self.sign[x] = sign

    def nodes(self, b: int) -> list[int]:
        out, todo = [], [b]
        while todo:
            x = todo.pop()
            if x <= self.n:
                out.append(x)
            else:
                todo += reversed(self.ring[x])
        return out

    def label(self, b: int, kind: int, way: tuple[int, int] | None) -> None:
        self.kind[b], self.way[b] = kind, way
        self.seen.add(b)
        for x in self.nodes(b):
            self.moves(x, (0, -1, 1)[kind])
        if b > self.n:
            self.moves(b, (0, 2, -2)[kind])
            if kind == 2:
                self.happens(self.now + self.cost(b) // 2, 3, b)
        if kind == 1:
            self.queue += self.nodes(b)

    def happens(self, when: int, what: int, u: int, v: int = 0, w: int = 0) -> None:
        if when <= self.limit:
            heapq.heappush(self.events, (when, what, u, v, w))

    def scan(self, u: int) -> None:
        """What the edges of an outer node will bring."""
        own, cost, now, kind, top = self.top[u], self.cost(u), self.now, self.kind, self.top
        if now + cost < self.limit:
            self.limit = now + cost
        self.happens(now + cost, 2, u)
        for v, w in self.near(u):
            b = top[v]
            if b == own or kind[b] == 2:
                continue
            gap = cost + self.price[v] + self.sign[v] * now - 2 * w
            if kind[b] == 1:
                self.happens(now + gap // 2, 1, u, v, w)
            elif now + gap <= self.limit and now + gap < self.soonest.get(v, self.limit + 1):
                self.soonest[v] = now + gap
                self.happens(now + gap, 0, u, v, w)

    def awaits(self, b: int) -> None:
        """What outer nodes around will bring to a top that has left the tree."""
        for v in self.nodes(b):
            self.soonest.pop(v, None)
            for u, w in self.near(v):
                if self.kind[self.top[u]] == 1:
                    when = self.now + self.cost(u) + self.cost(v) - 2 * w
                    if when < self.soonest.get(v, self.limit + 1):
                        self.soonest[v] = when
                        self.happens(when, 0, u, v, w)

    def meeting(self, u: int, v: int) -> int:
        """The outer top where the ways of two outer nodes to the root meet."""
        passed, u, v = set(), self.top[u], self.top[v]
        while u or v:
            if u:
                if u in passed:
                    return u
                passed.add(u)
                u = self.top[self.way[self.top[self.way[u][0]]][0]] if self.way[u] else 0
            u, v = v, u
        raise AssertionError("one tree has one root")

    def shrink(self, low: int, u: int, v: int) -> None:
        b = self.free.pop()
        ring, steps, x = [], [(u, v)], self.top[u]
        while x != low:
            ring.append(x)
            steps.append(self.way[x])
            x = self.top[self.way[x][0]]
        ring.append(low)
        ring.reverse()
        steps.reverse()
        x = self.top[v]
        while x != low:
            ring.append(x)
            steps.append(self.way[x][::-1])
            x = self.top[self.way[x][0]]
        self.ring[b], self.steps[b], self.base[b] = ring, steps, self.base[low]
        self.kind[b], self.way[b], self.parent[b] = 1, self.way[low], 0
        self.price[b], self.sign[b] = -2 * self.now, 2
        self.seen.add(b)
        for y in ring:
            self.parent[y] = b
            if y > self.n:
                self.moves(y, 0)
            for x in self.nodes(y):
                self.top[x] = b
                if self.kind[y] == 2:
                    self.moves(x, -1)
                    self.queue.append(x)

    def opened(self, b: int) -> list[int]:
        """The members of a cycle, tops again."""
        ring = self.ring[b]
        for y in ring:
            self.parent[y], self.kind[y], self.way[y] = 0, 0, None
            for x in self.nodes(y):
                self.top[x] = y
        self.seen.discard(b)
        self.kind[b] = 0
        self.free.append(b)
        return ring

    def expand(self, b: int) -> None:
        """An inner cycle whose price is used up: half of it stays in the tree, the rest leaves it."""
        v, w = self.way[b]
        steps, ring = self.steps[b], self.opened(b)
        at = ring.index(self.top[w])
        k, step = (at - len(ring), 1) if at % 2 else (at, -1)
        stays = {}
        while True:
            stays[ring[k]] = (2, (v, w))
            if k == 0:
                break
            p, q = steps[k] if step == 1 else steps[k - 1][::-1]  # the matched edge
            k += step
            stays[ring[k]] = (1, (p, q))
            v, w = steps[k] if step == 1 else steps[k - 1][::-1]
            k += step
        for y in ring:
            if y not in stays:
                self.label(y, 0, None)
        for y, (kind, way) in stays.items():
            self.label(y, kind, way)
        for y in ring:
            if y not in stays:
                self.awaits(y)

    def turn(self, b: int, v: int) -> None:
        """Matched edges within a top change so that its node v is the one that is free or matched outside."""
        todo = [(b, v)]
        while todo:
            b, v = todo.pop()
            if b <= self.n:
                continue
            t = v
            while self.parent[t] != b:
                t = self.parent[t]
            todo.append((t, v))
            ring, steps = self.ring[b], self.steps[b]
            i = k = ring.index(t)
            k, step = (k - len(ring), 1) if k % 2 else (k, -1)
            while k:
                k += step
                x, y = steps[k] if step == 1 else steps[k - 1][::-1]
                todo += [(ring[k], x), (ring[k + step], y)]
                k += step
                self.mate[x], self.mate[y] = y, x
            self.ring[b], self.steps[b], self.base[b] = ring[i:] + ring[:i], steps[i:] + steps[:i], v

    def augment(self, u: int, partner: int) -> None:
        """An outer node takes a partner (0: none), and so on down to the root."""
        while True:
            b = self.top[u]
            self.turn(b, u)
            self.mate[u] = partner
            if not self.way[b]:
                return
            x = self.top[self.way[b][0]]
            u, partner = self.way[x]
            self.turn(x, partner)
            self.mate[partner] = u

    def search(self, root: int) -> None:
        self.now, self.limit = 0, self.price[root]
        self.label(self.top[root], 1, None)
        while True:
            while self.queue:
                self.scan(self.queue.pop())
            self.now, what, u, v, w = heapq.heappop(self.events)
            if what == 3:
                if self.kind[u] == 2 and not self.parent[u] and u in self.seen and self.cost(u) == 0:
                    self.expand(u)
                continue
            if what == 2:
                self.augment(u, 0)
                break
            b = self.top[v]
            if b == self.top[u] or self.kind[b] == 2 or self.cost(u) + self.cost(v) != 2 * w:
                continue
            if self.kind[b] == 1:
                self.shrink(self.meeting(u, v), u, v)
            elif not self.mate[self.base[b]]:
                self.turn(b, v)
                self.mate[v] = u
                self.augment(u, v)
                break
            else:
                self.label(b, 2, (u, v))
                inner = self.base[b]
                outer = self.mate[inner]
                self.label(self.top[outer], 1, (inner, outer))
        self.settle()

    def settle(self) -> None:
        """Prices stand still after a search, and cycles whose price is 0 are nodes again."""
        todo = []
        for b in sorted(self.seen):
            self.kind[b], self.way[b] = 0, None
            if self.parent[b]:
                continue
            for x in self.nodes(b):
                self.moves(x, 0)
            if b > self.n:
                self.moves(b, 0)
                todo.append(b)
        while todo:
            b = todo.pop()
            if b > self.n and self.price[b] == 0:
                todo += self.opened(b)
        self.events.clear()
        self.soonest.clear()
        self.seen.clear()
        self.queue.clear()

    def run(self) -> None:
        for u in range(1, self.n + 1):
            if not self.mate[u]:
                # as cheap as its edges allow, so that one of them is tight
                self.price[u] = self.cheapest(u)
                v = next((v for v, w in self.near(u) if not self.mate[v] and self.price[u] + self.price[v] == 2 * w), 0)
                if v:
                    self.mate[u], self.mate[v] = v, u
        for u in range(1, self.n + 1):
            if not self.mate[u] and self.price[u]:
                self.search(u)


    def starts(self) -> list[int]:
        """Prices from which a search with more edges may start: a cycle's price goes to its nodes by halves."""
        out = self.price[1 : self.n + 1]
        for b in set(range(self.n + 1, len(self.price))).difference(self.free):
            for x in self.nodes(b):
                out[x - 1] += self.price[b] // 2
        return out


def priced_matching(edges: list[tuple]) -> tuple[set[tuple], dict]:
    """The pairs of :func:`maximum_matching`, and each node's price: no edge is worth more than its nodes' prices and the cycles around both."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: k + 1 for k, x in enumerate(names)}
    m = _Matcher(len(names), [(at[a], at[b], 2 * round(w * PARTS)) for a, b, w in edges if a != b and w > 0])
    m.run()
    return {(names[u - 1], names[m.mate[u] - 1]) for u in range(1, m.n + 1) if m.mate[u] > u}, {x: m.price[k] / (4 * PARTS) for x, k in at.items()}


def maximum_matching(edges: list[tuple]) -> set[tuple]:
    """The pairs (a, b) of the matching of largest total weight among (a, b, weight); weights of 0 and less are never taken."""
    return priced_matching(edges)[0]


def _solved(links: pa.Table, nodes: pa.Table) -> pa.Table:
    """node, mate, price, start of one component of links (a, b, w) and nodes (node, start, mate of the last round, if any)."""
    names = np.sort(nodes.column("node").to_numpy())
    at = lambda c, t: np.searchsorted(names, t.column(c).to_numpy()) + 1
    order = np.argsort(nodes.column("node").to_numpy())
    start = mate = None
    if not nodes.column("start").null_count:
        start = nodes.column("start").to_numpy()[order].tolist()
        last = nodes.column("mate").to_numpy()[order]
        mate = np.where(last < 0, 0, np.searchsorted(names, last) + 1).tolist()
    m = _Matcher(len(names), np.column_stack([at("a", links), at("b", links), links.column("w").to_numpy()]), start, mate)
    m.run()
    n = len(names)
    mates = np.array(m.mate[1 : n + 1])
    out = {"node": names, "mate": np.where(mates > 0, names[mates - 1], -1), "price": m.price[1 : n + 1], "start": m.starts()}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def matching(candidates: DataFrame, a: str, b: str, weight: str, write=cut) -> DataFrame:
    """a, b, weight (below 2^40) of the matching of largest total weight among candidates (a, b: bigint, 0 or more).

    Candidates may grow with the square of the nodes, so they never come to one task: each node's ``MOST`` best are matched,
    component by component, which gives every node a price. A candidate that is worth more than the prices of its two
    nodes may better the matching; each node's ``MOST`` worst of those join in, and matching goes on from the prices
    and pairs so far. When none is left, prices prove the matching for all candidates. Among equals a hash decides, so copies
    of one node do not all choose the same partner.
    """
    rows = candidates.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).cast("double").alias("weight")).filter("a <> b and weight > 0")
    whole = F.when(F.col("weight") < 2.0**40, 2 * F.rint(F.col("weight") * PARTS).cast("long")).otherwise(F.raise_error(F.lit("a weight of 2^40 or more")).cast("long"))
    best = write(rows.groupBy("a", "b").agg(F.max("weight").alias("weight")).withColumn("w", whole))

    def first(links: DataFrame, by) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("node").orderBy(by, F.xxhash64("a", "b"), "a", "b"))
        each = links.withColumn("node", F.explode(F.array("a", "b"))).withColumn("rank", rank).filter(F.col("rank") <= MOST)
        return each.select("a", "b", "weight", "w").distinct()

    work = write(first(best, -F.col("w")))
    labels = components(work, "a", "b", write)
    none = F.lit(None).cast("long")
    state = labels.select("node", none.alias("mate"), none.alias("price"), none.alias("start"))
    for k in count(1):
        links = work.join(labels.select(F.col("node").alias("a"), F.col("label").alias("part")), "a").select("part", "a", "b", "w")
        nodes = labels.join(state, "node").select(F.col("label").alias("part_"), "node", "start", "mate")
        state = write(links.groupBy("part").cogroup(nodes.groupBy("part_")).applyInArrow(_solved, "node long, mate long, price long, start long"))
        price = lambda c: state.select(F.col("node").alias(c), F.col("price").alias(f"{c}_price"))  # noqa: E731, B023
        over = (F.col("a_price") + F.col("b_price") - 2 * F.col("w")).alias("over")
        open_ = best.join(price("a"), "a").join(price("b"), "b").select("a", "b", "weight", "w", over).filter("over < 0")
        new = write(first(open_.join(work.select("a", "b"), ["a", "b"], "left_anti"), F.col("over")))
        if new.isEmpty():
            break
        work = write(work.unionByName(new))
        label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        between = write(new.join(label("a"), "a").join(label("b"), "b").filter("a_label <> b_label").select("a_label", "b_label").distinct())
        if not between.isEmpty():
            into = components(between, "a_label", "b_label", write).select(F.col("node").alias("label"), F.col("label").alias("into"))
            labels = write(labels.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label")))
    log.info("matching: %d rounds", k)
    return work.join(state.select(F.col("node").alias("a"), F.col("mate").alias("b")), ["a", "b"]).select("a", "b", "weight")


def skeleton_graph(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(edge, u, v, pixels) of a mask's skeleton: junction clusters are nodes 1000 + k, free ends -(k + 1); a loop has two equal ends.

    Clusters and chains are components of 8 neighbours, numbered by their first pixel.
    """
    s = thinned(mask[None])[0]
    degree = np.where(s, np.nansum(window_inside(s[None].astype(float)), axis=-1)[0] - s, 0)
    joint = s & (degree >= 3)
    cluster, part = labelled(joint[None])[0], labelled((s & ~joint)[None])[0]
    number = {int(k): n for n, k in enumerate(np.unique(cluster[cluster > 0]))}
    out, ends = [], 0
    square = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    for edge, k in enumerate(np.unique(part[part > 0]).tolist()):
        own = part == k
        near = np.unique(cluster[dilate(own[None], square)[0] & (cluster > 0)]).tolist()
        tips = [1000 + number[c] for c in near[:2]]
        inner = np.where(own, np.nansum(window_inside(own[None].astype(float)), axis=-1)[0] - own, 9)
        open_ = int((inner <= 1).sum()) + (1 if own.sum() == 1 else 0)
        if len(tips) == 1 and open_ >= 2:
            touching = dilate(joint[None], square)[0] & own & (inner <= 1)
            if int(touching.sum()) >= 2 and own.sum() > 1:
                tips.append(tips[0])  # both of its tips touch the same junction
        while len(tips) < 2 and open_ - len(tips) > 0:
            ends += 1
            tips.append(-ends)
        if not tips:
            ends += 1
            tips = [-ends, -ends]  # a ring
        if len(tips) == 1:
            tips.append(tips[0])
        out.append((edge, min(tips), max(tips), int(own.sum())))
    return out


def skeletons(df: DataFrame, level: float) -> DataFrame:
    """id, edge, u, v, pixels of the skeletons of pictures (id, height, width, v) over ``level``."""

    def task(batches):
        for batch in small(batches):
            rows = []
            for i, h, w, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v and h and w and len(v) == h * w:
                    rows += [(i, *e) for e in skeleton_graph(np.array(v, float).reshape(h, w) > level)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["id", "edge", "u", "v", "pixels"])

    return df.select(F.col("id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("v").cast("array<double>")).mapInArrow(task, "id long, edge long, u long, v long, pixels long")
