"""Chains of linked edges by contraction: every round appends about a third of the runs to their neighbours.

Ends are numbers: 2e is the first end of edge e, 2e + 1 its last. An edge is a run of one, with its first end at the left;
a run counts places from its own first edge, to both sides.
"""

from __future__ import annotations

import logging
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

log = logging.getLogger(__name__)

#: Runs, of all chains together, that are walked at once when no more are left.
REST = 4096


def _neighbours(links: DataFrame) -> DataFrame:
    """e, lo, hi, ln, ls, rn, rs of every edge with a link: a run of one edge, and the run and its side (0 left, 1 right) at either end."""
    both = links.select(F.col("a").alias("end"), F.col("b").alias("mate")).union(links.select("b", "a"))
    mate = lambda side: F.min(F.when(F.col("end") % 2 == side, F.col("mate")))
    by = both.groupBy(F.shiftright("end", 1).alias("e")).agg(mate(0).alias("l"), mate(1).alias("r"))
    zero, side = F.lit(0).cast("long"), lambda c: (F.col(c) % 2).cast("int")
    return by.select("e", zero.alias("lo"), zero.alias("hi"), F.shiftright("l", 1).alias("ln"), side("l").alias("ls"), F.shiftright("r", 1).alias("rn"), side("r").alias("rs"))


def _walked(table: pa.Table) -> pa.Table:
    """e, chain, sign, pos, ring of the last runs, by walking each chain from an end and each ring from its first run."""
    runs = {r["e"]: r for r in table.to_pylist()}
    rows, seen = [], set()
    ended = [e for e in sorted(runs) if runs[e]["ln"] is None or runs[e]["rn"] is None]
    for first in ended + sorted(runs):
        if first in seen:
            continue
        seen.add(first)
        r = runs[first]
        ring = r["ln"] is not None and r["rn"] is not None
        rows.append((first, first, 1, 0, ring))
        way, front, side = (-1, r["lo"], "l") if r["rn"] is None else (1, r["hi"], "r")
        while (e := r[side + "n"]) is not None and e not in seen:
            seen.add(e)
            by, r = r[side + "s"], runs[e]
            front += way
            rows.append((e, first, way, front - way * r["lo"], ring) if by == 0 else (e, first, -way, front + way * r["hi"], ring))
            front += way * (r["hi"] - r["lo"])
            side = "r" if by == 0 else "l"
    kinds = {"e": pa.int64(), "chain": pa.int64(), "sign": pa.int32(), "pos": pa.int64(), "ring": pa.bool_()}
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})


def _placed(links: DataFrame, write=cut) -> tuple[DataFrame, DataFrame]:
    """(e, chain, sign, pos) of every edge with a link, and (chain, ring) of every chain or ring.

    Runs are contracted: in a round, those with a smaller random number than their neighbours, about a third, are
    appended to a neighbour, which notes their places, and the next round has only the rest. Then places are handed back,
    the last round first. Both ways add up to about three times the edges, however long a chain is. The last runs, no
    more than ``REST``, are walked.
    """
    runs, rounds, roots = write(_neighbours(links)), [], None
    for k in count():
        ended = F.coalesce(F.col("ln") == F.col("e"), F.lit(False)) | F.col("ln").isNull() & F.col("rn").isNull()
        root = runs.filter(ended).select("e", F.col("ln").isNotNull().alias("ring"))
        roots = root if roots is None else roots.unionByName(root)
        runs = runs.filter(~ended)
        if runs.count() <= REST:
            break
        h = lambda c: F.xxhash64(F.col(c), F.lit(k))
        low = lambda c: F.col(c).isNull() | (h("e") < h(c))
        least = low("ln") & low("rn")
        # a run goes to its left neighbour, if there is one: by its side 0 then, else by its side 1
        gone = runs.filter(least).withColumn("by", F.when(F.col("ln").isNotNull(), 0).otherwise(1))
        left = F.col("by") == 0
        to, at = F.when(left, F.col("ln")).otherwise(F.col("rn")), F.when(left, F.col("ls")).otherwise(F.col("rs"))
        past, past_at = F.when(left, F.col("rn")), F.when(left, F.col("rs"))
        gone = gone.select("e", "lo", "hi", "by", to.alias("to"), at.alias("at"), past.alias("past"), past_at.alias("past_at"))
        edge = F.when(F.col("by") == 0, F.col("lo")).otherwise(F.col("hi"))
        same = F.col("by") == F.col("at")  # the run is turned round
        sign = F.when(same, -1).otherwise(1)
        rel = F.when(same, edge).otherwise(-edge)
        joined = gone.select(F.col("to").alias("e"), F.col("at").alias("side"), (F.col("hi") - F.col("lo") + 1).alias("n"), F.col("e").alias("x"), sign.alias("sign"), rel.alias("rel"), F.col("past").alias("nn"), F.col("past_at").alias("ns"))
        none = F.lit(None)
        passed = gone.filter("past is not null").select(F.col("past").alias("e"), F.col("past_at").alias("side"), F.lit(0).cast("long").alias("n"), none.cast("long").alias("x"), none.cast("int").alias("sign"), none.cast("long").alias("rel"), F.col("to").alias("nn"), F.col("at").alias("ns"))
        news = write(joined.unionByName(passed))
        rows = runs.filter(~least)
        for side, c in ((0, "l"), (1, "r")):
            part = news.filter(F.col("side") == side).select("e", *[F.col(m).alias(f"{c}_{m}") for m in ("n", "x", "sign", "rel", "nn", "ns")])
            rows = rows.join(part, "e", "left")
        told = lambda c: F.col(f"{c}_n").isNotNull()
        new = {f"{c}{m}": F.when(told(c), F.col(f"{c}_n{m}")).otherwise(F.col(f"{c}{m}")) for c in "lr" for m in "ns"}
        zero = F.lit(0).cast("long")
        rows = rows.select(
            "e", (F.col("lo") - F.coalesce("l_n", zero)).alias("lo"), (F.col("hi") + F.coalesce("r_n", zero)).alias("hi"), *[v.alias(n) for n, v in new.items()],
            "l_x", "l_sign", (F.col("lo") - 1 + F.col("l_rel")).alias("l_off"), "r_x", "r_sign", (F.col("hi") + 1 + F.col("r_rel")).alias("r_off"),
        )
        rows = write(rows)
        took = lambda c: rows.filter(F.col(f"{c}_x").isNotNull()).select(F.col(f"{c}_x").alias("x"), F.col("e").alias("to"), F.col(f"{c}_sign").alias("s"), F.col(f"{c}_off").alias("off"))
        rounds.append(took("l").unionByName(took("r")))
        runs = rows.select("e", "lo", "hi", "ln", "ls", "rn", "rs")
    log.info("chains: %d rounds", len(rounds))
    roots = roots.select("e", F.col("e").alias("chain"), F.lit(1).alias("sign"), F.lit(0).cast("long").alias("pos"), "ring")
    last = runs.select("e", "lo", "hi", "ln", "ls", "rn", "rs", F.lit(0).alias("all")).groupBy("all").applyInArrow(_walked, "e long, chain long, sign int, pos long, ring boolean")
    roots = write(roots.unionByName(last))
    known = roots.drop("ring")
    for k, notes in enumerate(reversed(rounds), 1):
        at = known.select(F.col("e").alias("to"), "chain", "sign", "pos")
        more = notes.join(at, "to").select(F.col("x").alias("e"), "chain", (F.col("s") * F.col("sign")).alias("sign"), (F.col("pos") + F.col("sign") * F.col("off")).alias("pos"))
        known = known.unionByName(write(more))
        known = known if k % 8 else write(known)
    return write(known), roots.filter("e = chain").select("chain", "ring")


def ranked_chains(links: DataFrame, nodes: DataFrame | None = None, write=cut) -> DataFrame:
    """chain (its first edge), place, edge, reversed of links (a, b: ends; cost); each end is in one link at most.

    A chain begins at the smaller of its two free ends. Rings are cut at their dearest link, the first of equals by its
    ends. With ``nodes`` (end, node), so are chains of two edges and more that would begin and end at one node, and what
    is left of them. Edges without a link are not listed, but for those that a cut leaves alone.
    """
    links = write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("cost").cast("double").alias("cost")))
    out = None
    while True:
        at, kinds = _placed(links, write)
        # the outer ends of a chain, where its places begin and end
        outer = lambda flip: F.col("e") * 2 + F.when((F.col("sign") == 1) == F.lit(not flip), 0).otherwise(1)
        by = at.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min_by(outer(False), "pos").alias("le"), F.max_by(outer(True), "pos").alias("re"))
        by = write(by.join(kinds, "chain"))
        cuts = by.filter("ring").select("chain")
        if nodes is not None:
            name = lambda c, k: nodes.select(F.col("end").alias(c), F.col("node").alias(k))
            closed = by.filter("not ring and n > 1").join(name("le", "begin"), "le").join(name("re", "finish"), "re").filter("begin = finish").select("chain")
            cuts = cuts.union(closed)
        dear = links.withColumn("e", F.shiftright("a", 1)).join(at.join(cuts, "chain", "left_semi").select("e", "chain"), "e")
        dear = write(dear.groupBy("chain").agg(F.min(F.struct((-F.col("cost")).alias("gain"), "a", "b")).alias("x")).select("chain", "x.a", "x.b"))
        if nodes is not None:
            broken = dear.select("chain").join(by, "chain")
            whole = by.join(dear, "chain", "left_anti").withColumn("head", F.least("le", "re"))
        else:
            whole = by.join(dear, "chain", "left").withColumn("head", F.when(F.col("ring"), F.col("a")).otherwise(F.least("le", "re")))
        # a ring's first edge is where its link was cut; the others' first edges stand at an end
        first = whole.filter("ring").select("chain", "head", F.shiftright("head", 1).alias("e")).join(at, ["chain", "e"]).select("chain", F.col("pos").alias("from"), (F.col("sign") * F.when(F.col("head") % 2 == 0, 1).otherwise(-1)).alias("way"))
        whole = whole.join(first, "chain", "left")
        ahead = F.col("le") < F.col("re")
        way = F.coalesce("way", F.when(ahead, 1).otherwise(-1))
        start = F.coalesce("from", F.when(ahead, F.col("lo")).otherwise(F.col("hi")))
        whole = write(whole.select("chain", F.col("n"), F.shiftright("head", 1).alias("name"), way.alias("way"), start.alias("start")))
        rows = at.join(whole, "chain").select(F.col("name").alias("chain"), F.pmod((F.col("pos") - F.col("start")) * F.col("way"), F.col("n")).alias("place"), F.col("e").alias("edge"), (F.col("sign") * F.col("way") == -1).alias("reversed"))
        out = rows if out is None else out.unionByName(rows)
        if nodes is None or dear.isEmpty():
            return out
        # chains that are cut are placed again without that link; edges that have no other are chains of their own
        again = write(at.join(broken.select("chain"), "chain", "left_semi").select("e"))
        mine = links.withColumn("e", F.shiftright("a", 1)).join(again, "e", "left_semi").drop("e")
        links = write(mine.join(dear.select("a", "b"), ["a", "b"], "left_anti"))
        ends = links.select(F.explode(F.array(F.shiftright("a", 1), F.shiftright("b", 1))).alias("e"))
        out = out.unionByName(again.join(ends, "e", "left_anti").select(F.col("e").alias("chain"), F.lit(0).cast("long").alias("place"), F.col("e").alias("edge"), F.lit(False).alias("reversed")))


def contracted(edges: DataFrame, edge: str, u: str, v: str, length: str, write=cut) -> DataFrame:
    """edge, u, v, length, edges: what is left when every node that joins just two edges is passed through.

    An edge that several become has the number of the first one's; a ring without any other node is one edge from a
    node to itself. Loops are not joined to anything.
    """
    e = edges.select(F.col(edge).alias("edge"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(length).alias("length"))
    ends = e.select(F.explode(F.array(F.struct((F.col("edge") * 2).alias("end"), F.col("u").alias("node")), F.struct((F.col("edge") * 2 + 1).alias("end"), F.col("v").alias("node")))).alias("x")).select("x.*")
    at = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"), F.min("end").alias("a"), F.max("end").alias("b"))
    links = write(at.filter("d = 2 and floor(a / 2) <> floor(b / 2)").select("a", "b", F.lit(0.0).alias("cost")))
    rows = e.join(ranked_chains(links, write=write), "edge", "left")
    begin, end = F.when(F.col("reversed"), F.col("v")).otherwise(F.col("u")), F.when(F.col("reversed"), F.col("u")).otherwise(F.col("v"))
    by = rows.withColumn("chain", F.coalesce("chain", "edge")).groupBy("chain")
    return by.agg(F.min_by(begin, "place").alias("u1"), F.max_by(end, "place").alias("v1"), F.first("u").alias("u0"), F.first("v").alias("v0"), F.max("place").alias("p"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("edges")).select(
        F.col("chain").alias("edge"), F.when(F.col("p").isNull(), F.col("u0")).otherwise(F.col("u1")).alias("u"), F.when(F.col("p").isNull(), F.col("v0")).otherwise(F.col("v1")).alias("v"), "length", "edges"
    )
