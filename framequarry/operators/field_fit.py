"""Joint least-squares fit of many overlapping parts to pictures: sparse normal equations as tables, conjugate gradients as joins.

A system (a picture, or all that hangs together) has rows (pixels, and penalties: rows without a target), columns
(coefficients) and owners of columns (vessels). The matrix is the table (system, row, col, a) and never leaves it: the
normal equations are one self-join on rows, whose size is the sum of squared entries a row, so a pixel that few vessels
reach gives few; a round of the solver is one join and two sums. Many right sides of many systems are solved in the same
rounds, and systems that are done leave. Systems of few columns are solved outright, each in one row, without rounds.
Tables with a row for each system grow with the data, so none of them is broadcast.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

log = logging.getLogger(__name__)

#: A vessel goes that explains less of its own picture than this alone.
UNIQUE_SHARE = 0.1
#: Systems of at most so many columns are solved outright: their normal matrix has at most the square of it.
DIRECT = 64


def _grown(df: DataFrame) -> DataFrame:
    """df, never broadcast however small its files are."""
    return df.hint("merge")


def normal_equations(entries: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(system, i, j, h) and (system, i, g) of entries (system, row, col, a) and targets (system, row, d)."""
    e = entries.groupBy("system", "row", "col").agg(F.sum("a").alias("a"))
    left, right = (e.select("system", "row", F.col("col").alias(c), F.col("a").alias(f"a{c}")) for c in "ij")
    h = left.join(_grown(right), ["system", "row"]).groupBy("system", "i", "j").agg(F.sum(F.col("ai") * F.col("aj")).alias("h"))
    g = left.join(_grown(targets), ["system", "row"]).groupBy("system", "i").agg(F.sum(F.col("ai") * F.col("d")).alias("g"))
    return h, g


def conjugate_gradients(h: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, most: int = 500, write=cut) -> DataFrame:
    """system, rhs, i, x: solutions of h x = g for right sides (system, rhs, i, g) that name every column of their system.

    Preconditioned by the diagonal. A round is written and read back, so that neither plans nor what a lost executor
    costs grow; rounds end when each residual is below ``tolerance`` of its first one. Raises if ``most`` rounds do not
    get there. A column whose diagonal is zero has no say and stays zero.
    """
    diagonal = h.filter("i = j").select("system", "i", F.col("h").alias("m"))

    def applied(s: DataFrame) -> DataFrame:
        q = h.join(_grown(s.select("system", "rhs", F.col("i").alias("j"), "p")), ["system", "j"]).groupBy("system", "rhs", "i").agg(F.sum(F.col("h") * F.col("p")).alias("q"))
        return s.join(_grown(q), ["system", "rhs", "i"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))

    z = F.when(F.col("m") > 0, F.col("r") / F.col("m")).otherwise(0.0)
    first = rhs.join(_grown(diagonal), ["system", "i"], "left").select("system", "rhs", "i", F.lit(0.0).alias("x"), F.col("g").alias("r"), F.coalesce("m", F.lit(0.0)).alias("m"))
    size = first.groupBy("system", "rhs").agg(F.sum(F.col("r") * z).alias("start"))
    state = write(applied(first.join(_grown(size), ["system", "rhs"]).withColumn("p", z)))
    done, rounds = None, 0
    while True:
        qm = F.when(F.col("m") > 0, F.col("q") / F.col("m")).otherwise(0.0)
        sums = state.groupBy("system", "rhs").agg(F.sum(F.col("r") * z).alias("rz"), F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("r") * qm).alias("rq"), F.sum(F.col("q") * qm).alias("qq"), F.first("start").alias("start"))
        sums = write(sums.select("system", "rhs", "rz", "pq", "rq", "qq", ((F.col("rz") > F.col("start") * tolerance**2) & (F.col("pq") > 0)).alias("open")))
        ended = state.join(_grown(sums.filter("not open").select("system", "rhs")), ["system", "rhs"], "left_semi").select("system", "rhs", "i", "x")
        done = ended if done is None else done.unionByName(ended)
        if sums.filter("open").isEmpty():
            log.info("conjugate gradients: %d rounds", rounds)
            return write(done)
        if rounds == most:
            raise ArithmeticError(f"{sums.filter('open').count()} right sides have not converged in {most} rounds")
        alpha = F.col("rz") / F.col("pq")
        beta = F.greatest(F.col("rz") - 2 * alpha * F.col("rq") + alpha * alpha * F.col("qq"), F.lit(0.0)) / F.col("rz")
        step = state.join(_grown(sums.filter("open")), ["system", "rhs"]).withColumn("a", alpha).withColumn("b", beta)
        step = step.withColumn("x", F.col("x") + F.col("a") * F.col("p")).withColumn("r", F.col("r") - F.col("a") * F.col("q"))
        step = step.withColumn("p", z + F.col("b") * F.col("p")).select("system", "rhs", "i", "x", "r", "m", "start", "p")
        state, rounds = write(applied(step)), rounds + 1
        if rounds % 8 == 0:
            done = write(done)


def solved_outright(h: DataFrame, g: DataFrame, write=cut) -> tuple[DataFrame, DataFrame]:
    """What :func:`fitted` gives, of systems of at most DIRECT columns: a system's equations are one row.

    As with conjugate gradients that begin at zero, the solution is the smallest of those that fit equally well, with
    columns scaled by the diagonal; a column whose diagonal is zero stays zero.
    """
    rows = h.select("system", "i", "j", F.col("h").alias("v")).unionByName(g.select("system", "i", F.lit(None).cast("long").alias("j"), F.col("g").alias("v")))
    rows = rows.groupBy("system").agg(F.collect_list("i").alias("i"), F.collect_list(F.coalesce("j", F.lit(-1))).alias("j"), F.collect_list("v").alias("v"))  # DIRECT * (DIRECT + 1) at most

    def run(batches):
        for batch in batches:
            out, alike = [], {}
            lists = [[c.values.to_numpy(zero_copy_only=False)[a:b] for a, b in zip(c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:])] for c in (batch.column(k) for k in (1, 2, 3))]
            for i, j, v in zip(*lists, strict=True):
                name = np.unique(i[j >= 0])
                m, d, right = np.zeros((len(name), len(name))), np.zeros(len(name)), j < 0
                m[np.searchsorted(name, i[~right]), np.searchsorted(name, j[~right])] = v[~right]
                d[np.searchsorted(name, i[right])] = v[right]
                alike.setdefault(len(name), []).append(len(out))
                out.append((name, m, d))
            for at in alike.values():  # systems of one size at once
                m, d = np.stack([out[k][1] for k in at]), np.stack([out[k][2] for k in at])
                size = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 0))
                s = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0)
                inverse = s[:, :, None] * np.linalg.pinv(s[:, :, None] * m * s[:, None], rcond=1e-12, hermitian=True) * s[:, None]
                x = (inverse @ d[:, :, None])[:, :, 0]
                for k, one, two in zip(at, x, inverse, strict=True):
                    out[k] = (out[k][0], one, two.ravel())
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=["system", "i", "x", "v"])

    got = write(rows.mapInArrow(run, "system long, i array<long>, x array<double>, v array<double>"))
    x = got.select("system", F.explode(F.arrays_zip("i", "x")).alias("z")).select("system", "z.i", "z.x")
    n = F.size("i")
    inverse = got.select("system", "i", n.alias("n"), F.posexplode("v").alias("p", "v"))
    return x, inverse.select("system", F.get("i", F.floor(F.col("p") / F.col("n")).cast("int")).alias("k"), F.get("i", F.col("p") % F.col("n")).alias("i"), "v")


def fitted(entries: DataFrame, targets: DataFrame, write=cut, direct: int = DIRECT) -> tuple[DataFrame, DataFrame]:
    """(system, i, x) and (system, k, i, v): the coefficients and the inverse of the normal matrix, of the same rounds.

    The inverse has the square of a system's columns; systems are what hangs together, not the whole corpus. Systems of
    more than ``direct`` columns go through :func:`conjugate_gradients`.
    """
    h, g = (write(t) for t in normal_equations(entries, targets))
    wide = write(h.filter("i = j").groupBy("system").count().filter(F.col("count") > direct).select("system"))
    if wide.isEmpty():
        return solved_outright(h, g, write)
    x, inverse = solved_outright(h.join(_grown(wide), "system", "left_anti"), g.join(_grown(wide), "system", "left_anti"), write)
    h, g = h.join(_grown(wide), "system", "left_semi"), g.join(_grown(wide), "system", "left_semi")
    every = h.select("system", "i").distinct()
    main = every.join(_grown(g), ["system", "i"], "left").select("system", F.lit(None).cast("long").alias("k"), "i", F.coalesce("g", F.lit(0.0)).alias("g"))
    unit = every.select("system", F.col("i").alias("k")).join(_grown(every), "system").select("system", "k", "i", F.when(F.col("k") == F.col("i"), 1.0).otherwise(0.0).alias("g"))
    both = main.unionByName(unit).select("system", F.coalesce("k", F.lit(-1)).alias("rhs"), "i", "g")
    solved = conjugate_gradients(h, both, write=write)
    x = x.unionByName(solved.filter("rhs = -1").select("system", "i", "x"))
    return write(x), write(inverse.unionByName(solved.filter("rhs <> -1").select("system", F.col("rhs").alias("k"), "i", F.col("x").alias("v"))))


def unique_shares(entries: DataFrame, targets: DataFrame, owners: DataFrame, x: DataFrame, inverse: DataFrame) -> DataFrame:
    """system, owner, score: how much worse the whole fit gets without an owner, all others refitted, over its own picture's energy.

    With b an owner's coefficients and M their block of the inverse that is b' M^-1 b; a block has as many rows as the
    owner has coefficients. ``owners``: col, owner.
    """
    own = entries.join(_grown(targets.select("system", "row")), ["system", "row"], "left_semi").join(_grown(x.select("system", F.col("i").alias("col"), "x")), ["system", "col"]).join(owners, "col")
    energy = own.groupBy("system", "owner", "row").agg(F.sum(F.col("a") * F.col("x")).alias("s")).groupBy("system", "owner").agg(F.sum(F.col("s") * F.col("s")).alias("energy"))
    at = lambda c: owners.select(F.col("col").alias(c), F.col("owner").alias(f"{c}_owner"))
    block = inverse.join(at("k"), "k").join(at("i"), "i").filter("k_owner = i_owner").select("system", F.col("k_owner").alias("owner"), "k", "i", "v")
    rows = block.join(_grown(x), ["system", "i"]).groupBy("system", "owner").agg(*[F.collect_list(c).alias(c) for c in ("k", "i", "v", "x")])

    def run(batches):
        for batch in batches:
            out = []
            for k, i, v, x in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                name, at = np.unique(i, return_inverse=True)
                m, b = np.zeros((len(name), len(name))), np.zeros(len(name))
                m[np.searchsorted(name, k), at] = v
                b[at] = x
                out.append(float(b @ np.linalg.lstsq(m, b, rcond=None)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["system", "owner", "gain"])

    gains = rows.mapInArrow(run, "system long, owner long, gain double")
    return gains.join(_grown(energy), ["system", "owner"]).select("system", "owner", (F.col("gain") / F.greatest("energy", F.lit(1e-12))).alias("score"))


def weakest_apart(weak: DataFrame, touching: DataFrame, write=cut) -> DataFrame:
    """system, owner: weak owners (system, owner, score) by ascending score, without those that touch one taken before.

    Each round takes those that are weaker than every undecided one that they touch and lets the touched ones wait; the
    outcome is that of going through them in order. ``touching``: system, owner, other, both ways round.
    """
    rank = lambda s: F.struct(F.col(f"{s}.score"), F.col(f"{s}.owner"))
    left, out = write(weak), None
    while out is None or not left.isEmpty():
        pairs = touching.join(_grown(left.alias("a")), ["system", "owner"]).join(_grown(left.select("system", F.col("owner").alias("other"), F.struct("score", F.col("owner").alias("owner")).alias("their"))), ["system", "other"])
        beaten = pairs.filter(F.col("their") < F.struct(F.col("score"), F.col("owner"))).select("system", "owner").distinct()
        taken = write(left.join(_grown(beaten), ["system", "owner"], "left_anti").select("system", "owner"))
        waits = touching.join(_grown(taken), ["system", "owner"]).select("system", F.col("other").alias("owner"))
        left = write(left.join(_grown(taken), ["system", "owner"], "left_anti").join(_grown(waits), ["system", "owner"], "left_anti"))
        out = taken if out is None else out.unionByName(taken)
    return out


def settle(entries: DataFrame, targets: DataFrame, owners: DataFrame, touching: DataFrame, least: float = UNIQUE_SHARE, most: int = 100, write=cut) -> tuple[DataFrame, DataFrame]:
    """((system, owner, score, dropped_in), (system, col, x)): fit, drop what is not needed, fit again, until all that is left is needed.

    ``dropped_in`` is the round that an owner went in, null for those that stay; scores are of an owner's last round. A
    round drops the weakest owners of a system that do not touch each other; systems that drop nothing are done.
    """
    fate, fits, left = None, None, write(entries)
    for k in range(1, most + 1):
        x, inverse = fitted(left, targets, write)
        scores = write(unique_shares(left, targets, owners, x, inverse))
        batch = write(weakest_apart(scores.filter(F.col("score") < least), touching, write))
        open_ = batch.select("system").distinct()
        gone = scores.join(_grown(batch), ["system", "owner"], "left_semi").withColumn("dropped_in", F.lit(k))
        stay = scores.join(_grown(open_), "system", "left_anti").withColumn("dropped_in", F.lit(None).cast("int"))
        settled = x.join(_grown(open_), "system", "left_anti").select("system", F.col("i").alias("col"), "x")
        fate = gone.unionByName(stay) if fate is None else write(fate.unionByName(gone).unionByName(stay))
        fits = settled if fits is None else write(fits.unionByName(settled))
        log.info("settle: round %d dropped %d", k, batch.count())
        if batch.isEmpty():
            return fate, fits
        names = batch.join(owners, "owner").select("system", "col")
        left = write(left.join(_grown(open_), "system", "left_semi").join(_grown(names), ["system", "col"], "left_anti"))
    raise ArithmeticError(f"not settled in {most} rounds")
