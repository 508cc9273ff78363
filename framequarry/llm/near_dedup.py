"""Near duplicates by HyperMinHash.

A document's set of word shingles falls into buckets by the leading bits of the shingles' hashes. Of each bucket's
smallest hash only the number of leading zeros and some bits after the leading one (the mantissa) are stored. Two
sketches serve two purposes: 128 registers of 6 + 10 bits, where an empty bucket borrows from a full one that a fixed
random order decides, are banded by four (at a similarity of 0.75 a pair misses all 32 bands with a chance of 5e-6);
512 registers of 3 + 5 bits, empty where the bucket is, estimate the similarity, corrected for chance collisions.

Documents of equal sets become one node first, with a number of its own, so identifiers play no part until the end. Nodes of a band are then compared in three rounds, each round only
between documents that earlier rounds have not connected: with the most central document of all their bands (the one
with most company); with each band's most central; and, exactly, every remaining pair in a band, block by block.
Before texts are read, exact set sizes and the estimate rule out pairs; texts then confirm every link on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, LEAST_HOT, discard, hot_keys, look_up, materialise
from .components import components, settle
from .text_kernels import U, chunks, mix64, shingle_sets, string_bytes

BUCKETS, BAND = 128, 4
BANDS = BUCKETS // BAND
MANTISSA = 10
#: Registers of the estimate, of 8 bits, eight in a long; chance that those of different shingles agree.
FINE, FINE_MANTISSA = 512, 5
CHANCE = 2.0**-FINE_MANTISSA / 3
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 4.0
#: Pairs that are broadcast to fetch texts; beyond that, a shuffled join does it.
MOST_BROADCAST = 300_000
#: Documents of a band that one task compares with as many others.
BLOCK = 4096


def _minima(shingles: np.ndarray, buckets: int, mantissa: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that are full, and the code of each one's smallest hash: leading zeros, then mantissa."""
    shift = 65 - int(buckets).bit_length()
    first = np.searchsorted(shingles, np.arange(buckets, dtype=U) << U(shift))
    full = np.flatnonzero(np.diff(np.append(first, len(shingles))))
    rest = (shingles[first[full]] & U((1 << shift) - 1)) | U(1)
    return full, (rest.astype(np.float64).view(np.uint64) >> U(52 - mantissa)) - U(1023 << mantissa)


def registers(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The 128 banded registers of a sorted set of mixed hashes; ``order[b, e]`` ranks full buckets that b may borrow."""
    full, code = _minima(shingles, BUCKETS, MANTISSA)
    out = np.zeros(BUCKETS, U)
    out[full] = code
    if len(full) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), full, assume_unique=True)
        out[empty] = code[np.argmin(order[np.ix_(empty, full)], axis=1)]
    return out


def fine_registers(shingles: np.ndarray) -> np.ndarray:
    """The 512 registers of the estimate as bytes; 0 is an empty bucket."""
    full, code = _minima(shingles, FINE, FINE_MANTISSA)
    out = np.zeros(FINE, np.uint8)
    out[full] = np.maximum((code & U(0xFF)).astype(np.uint8), 1)
    return out


def _sketch(words: int):
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("regs", pa.list_(pa.int64()))])

    def run(batches):
        order = mix64(np.arange(1, BUCKETS * BUCKETS + 1, dtype=U) * U(0x8CB92BA72F3D8DD7)).reshape(BUCKETS, BUCKETS)
        spread = np.argsort(order[0], kind="stable")  # buckets of a band do not neighbour each other
        lanes = U(16) * np.arange(BAND, dtype=U)
        for batch in batches:
            offsets, data = string_bytes(batch.column(2))
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                sets = shingle_sets(data[part[0] : part[-1]], part - part[0], words)
                bands, regs = np.zeros((len(sets), BANDS), U), np.zeros((len(sets), FINE), np.uint8)
                sums = np.zeros((len(sets), 2), U)
                for n, s in enumerate(sets):
                    if len(s):
                        bands[n] = (registers(s, order)[spread].reshape(BANDS, BAND) << lanes).sum(axis=1, dtype=U)
                        regs[n] = fine_registers(s)
                        sums[n] = s.sum(dtype=U), mix64(s + U(0x632BE59BD9B4E019)).sum(dtype=U)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (x.size // max(len(sets), 1))), pa.array(x.ravel())) for x in (bands.view(np.int64), regs.view(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), texts.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy().view(np.int64)), pa.array(sums[:, 1].copy().view(np.int64)), *lists], schema=schema)

    return run


def sketches(df: DataFrame, words: int) -> DataFrame:
    """id, h (the text's hash), n (set size), s1, s2 (the set's digest), bands, regs of df's id and t."""
    return df.select("id", F.xxhash64("t").alias("h"), "t").mapInArrow(_sketch(words), "id long, h long, n long, s1 long, s2 long, bands array<long>, regs array<long>")


def _full_lanes(x: Column) -> Column:
    """How many of the eight bytes of a long are not 0: the lowest bit of each gathers all of its bits."""
    for k in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def least_matches(full, sizes, percent: int, sqrt=np.sqrt, greatest=np.maximum):
    """Of ``full`` registers that either of two sets fills, how many must agree; ``sizes``: both sets' sizes summed.

    The registers are a sample without replacement of the union, whose size follows from the sizes at the threshold.
    """
    j = percent / 100
    left = greatest(1 - full * (1 + j) / sizes, 0.02)
    return full * (j + (1 - j) * CHANCE) - SLACK * sqrt(full * (j * (1 - j)) * left) - 1


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether two nodes can reach the threshold by their set sizes and by the estimate."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    add = lambda lanes: F.aggregate(F.zip_with(f"{x}.regs", f"{y}.regs", lanes), F.lit(0), lambda a, k: a + k)
    full = add(lambda a, b: _full_lanes(a.bitwiseOR(b)))
    differ = add(lambda a, b: _full_lanes(a.bitwiseXOR(b)))
    least = least_matches(full, F.col(f"{x}.n") + F.col(f"{y}.n"), percent, F.sqrt, lambda a, b: F.greatest(a, F.lit(b)))
    return (small * 100 >= large * percent) & (full - differ >= least)


def _pairs_of_block(percent: int):
    """Rows of one band's block -> pairs that the sketches do not rule out, each in the first band that they share."""

    def run(table: pa.Table) -> pa.Table:
        cols = {name: table.column(name).combine_chunks() for name in ("id", "label", "n", "minor", "left")}
        ident, label, n = (cols[k].to_numpy() for k in ("id", "label", "n"))
        minor, left = (cols[k].to_numpy(zero_copy_only=False).astype(bool) for k in ("minor", "left"))
        band = int(table.column("band")[0].as_py())
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ident), BANDS)
        regs = table.column("regs").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(ident), FINE)
        rights = np.flatnonzero(~left)
        found = []
        for i in np.flatnonzero(left).tolist():
            ok = (label[rights] != label[i]) & (~minor[rights] | (ident[rights] > ident[i]))
            ok &= (np.minimum(n[rights], n[i]) * 100 >= np.maximum(n[rights], n[i]) * percent)
            r = rights[ok]
            r = r[~(bands[r, :band] == bands[i, :band]).any(axis=1)]
            same = (regs[r] == regs[i]) & (regs[i] > 0)
            full = ((regs[r] > 0) | (regs[i] > 0)).sum(1)
            r = r[same.sum(1) >= least_matches(full, n[r] + n[i], percent)]
            found.append(np.stack([np.minimum(ident[r], ident[i]), np.maximum(ident[r], ident[i])]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def _compare(words: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            found = []
            for a, b, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = docs.values
                offsets, data = string_bytes(rows.field("t"))
                sets = shingle_sets(data[offsets[0] : offsets[-1]], offsets - offsets[0], words)
                of: dict[int, list] = {a: [], b: []}
                for i, s in zip(rows.field("id").to_pylist(), sets, strict=True):
                    of[i].append(s)
                for x in of[a]:
                    if any(100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - both) for y in of[b]):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return run


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; texts come from docs (id, t), one of each id."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
    if 2 * pairs.count() <= MOST_BROADCAST:
        both = docs.join(F.broadcast(need), "id")
    else:
        both = look_up(need, docs, ["id"], how="inner", small=False)
    both = both.groupBy("a", "b").agg(F.collect_list(F.struct("id", "t")).alias("docs"))  # two texts
    return both.mapInArrow(_compare(words, percent), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_hash.

    Words are runs of anything but ASCII white space, lower-cased in A-Z only. ``component_id`` is the smallest
    identifier reachable over links of 100 * |intersection| >= percent * |union|; ``kept`` where it is the own one.
    Null and empty texts have no shingles and no links. Rows that repeat an identifier are one document, linked by what
    any of its texts links. Rows without an identifier are documents of their own: ``component_id`` is null where no
    document of the component has one, and one row of such a component is kept; a text without shingles is kept. Texts
    are compared whole, however long; ``text_hash`` is Spark's xxhash64 of the text (null: of the empty one), which tells
    apart rows without identifier. Other columns, whatever their names, are not read. Empty input gives no rows.
    """
    docs = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    sketch = materialise(sketches(docs, words).withColumn("row", F.monotonically_increasing_id()), "sketch")
    keys = ["s1", "s2", "n"]
    same = sketch.filter("n > 0").groupBy(*keys).agg(
        F.min("id").alias("doc"),
        F.min(F.when(F.col("id").isNull(), F.col("row"))).alias("row"),
        F.min(F.struct(F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(0)).alias("i"), "h")).alias("text"),
        F.any_value(F.struct("bands", "regs")).alias("x"),
        F.count(F.lit(1)).alias("copies"),
    )
    nodes = materialise(same.select(*keys, F.monotonically_increasing_id().alias("id"), "doc", "row", "text", "x.*", "copies"), "nodes")
    total = sketch.count()
    crowded = nodes.filter(F.col("copies") > max(total * HOT, LEAST_HOT)).select("id", *keys).collect()
    members = look_up(sketch.select("row", "id", "h", *keys), nodes.select(*keys, F.col("id").alias("node")), keys, [r[1:] for r in crowded])
    members = materialise(members.select("row", "id", "h", "n", "node"), "members")
    discard(sketch)
    # documents with several rows: their nodes are linked
    again = members.filter("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    again = materialise(again, "again")
    several = again.filter("a <> z").select("id", "a")
    repeats = look_up(members.filter("id is not null and node is not null").select("id", F.col("node").alias("b")), several, ["id"], how="inner").select("a", "b").distinct()
    repeats = materialise(repeats if not several.isEmpty() else again.selectExpr("a", "z as b").limit(0), "repeats")

    banded = nodes.select("id", F.posexplode("bands").alias("band", "v")).select("id", "band", F.xxhash64("v", "band").alias("key"))
    company = materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "company")
    rows = company.agg(F.sum("m")).first()[0] or 0
    crowds = hot_keys(company, ["key"], company.withColumnRenamed("m", "n"), rows)
    met = materialise(look_up(banded, company, ["key"], crowds, "inner"), "met")
    rank = met.groupBy("id").agg(F.sum("m").alias("rank"))  # how much company a node has in all its bands
    ranked = met.join(rank, "id")
    heads = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("neg"))).alias("x")).select("key", (-F.col("x.neg")).alias("head"), F.col("x.rank").alias("head_rank"))
    shared = materialise(look_up(met, heads, ["key"], crowds), "bands")
    leaders = hot_keys(shared, ["head"])
    brief = nodes.select("id", "n", "regs")
    wanted = nodes.join(rank.select("id"), "id", "left_semi").select(F.col("id").alias("node"), "text.*")
    own = docs.select(F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(0)).alias("i"), F.xxhash64("t").alias("h"), "t")
    if members.filter("id is null").isEmpty() and again.isEmpty():
        texts = own.join(wanted, ["no", "i", "h"])
    else:  # one of the rows that repeat
        repeated = members.select(F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(0)).alias("i"), "h")
        texts = look_up(own, wanted, ["no", "i", "h"], hot_keys(repeated, ["no", "i", "h"]), "inner").groupBy("node").agg(F.min("t").alias("t"))
    texts = materialise(texts.select(F.col("node").alias("id"), "t"), "texts")

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """Links among candidate pairs (a, b)."""
        out = materialise(confirm(pairs, texts, words, percent), f"{tag}-links")
        discard(pairs)
        return out

    def with_head(pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (a, b) that sizes and estimate allow; a is a head."""
        x = look_up(pairs, brief.select(F.col("id").alias("a"), F.struct("n", "regs").alias("x")), ["a"], [(r.head,) for r in leaders], "inner")
        x = x.join(brief.select(F.col("id").alias("b"), F.struct("n", "regs").alias("y")), "b")
        return materialise(x.filter(_possible("x", "y", percent)).select("a", "b").distinct(), f"{tag}-pairs")

    def apart(labels: DataFrame) -> DataFrame:
        """The bands' rows with the labels of the node and of the band's head."""
        out = shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        out = look_up(out, labels.select(F.col("id").alias("head"), F.col("label").alias("head_label")), ["head"], leaders)
        return out.withColumn("head_label", F.coalesce("head_label", "head"))

    # 1: the most central of all its bands' heads
    best = F.max(F.struct("head_rank", (-F.col("head")).alias("neg"))).alias("x")
    first = shared.filter("id <> head").groupBy(F.col("id").alias("b")).agg(best).select((-F.col("x.neg")).alias("a"), "b")
    links = [confirmed(with_head(first, "first"), "first")]
    labels = components(links[0])
    # 2: every band's head that is not connected yet
    second = apart(labels).filter("label <> head_label").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links.append(confirmed(with_head(second, "second"), "second"))
    discard(labels)
    labels = components(links[0].union(links[1]))
    # 3: every pair of a band, one of which is not connected with the band's head; the other side has all but the head
    state = materialise(apart(labels).filter("id <> head").withColumn("minor", F.col("label") != F.col("head_label")), "state")
    minors = state.filter("minor").groupBy("key").agg(F.count(F.lit(1)).alias("minors"))
    mixed = look_up(state, minors, ["key"], crowds, "inner").join(nodes.select("id", "n", "bands", "regs"), "id")
    cols = ["key", "band", "id", "label", "n", "minor", "bands", "regs"]
    blocks = lambda m: F.ceil(F.col(m) / BLOCK).cast("int")
    part = lambda m: F.pmod(F.xxhash64("id"), blocks(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), blocks(m) - 1))
    lefts = mixed.filter("minor").select(*cols, F.lit(True).alias("left"), part("minors").alias("i"), every("m").alias("j"))
    rights = mixed.select(*cols, F.lit(False).alias("left"), every("minors").alias("i"), part("m").alias("j"))
    third = lefts.union(rights).groupBy("key", "i", "j").applyInArrow(_pairs_of_block(percent), "a long, b long")
    links.append(confirmed(materialise(third.distinct(), "third-pairs"), "third"))
    discard(labels)
    labels = components(links[0].union(links[1]).union(links[2]).union(repeats))
    discard(*links, state, shared, met, texts, repeats, company, again)

    out = settle(members, nodes, labels, [r[:1] for r in crowded])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept", F.col("h").alias("text_hash"))
