"""Copies of images, also cropped or edited, by local descriptors.

Corners are found on several scales of an image; around each, pairs of points are compared, in a frame turned to the
corner's own orientation, which gives 256 bits. The bits are split into tables of 64 bits, whatever the number of images,
so that a copy that is found among few is found among many: corners of different images that agree in a whole table
entry meet in a join. Images that share enough entries are compared in full: corners that match each other best vote for
one turn, scale and shift, and enough votes for the same make a link. Equal images are one node from the start; an entry
links its images with one of them first, and compares the others only as far as they are not connected by then, so a
large group of copies makes as many pairs as it has members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, LEAST_HOT, discard, hot_keys, look_up, materialise
from .components import components, settle
from .text_kernels import U, mix64

#: Corners of every AREA pixels of an image, the strongest of all scales; scales; radius of the compared points; bits.
AREA = 4096
CORNERS, SCALES, RADIUS, BITS = 48, (1.0, 0.7071, 0.5), 7, 256
#: Bytes of a table's entry, for every size of input. Chance agreement grows with the square of the images, and narrower entries have far more
#: of it (among 51,282 rank-one pictures 33 M pairs at 4 bytes, 3.3 M at 6, 0.9 M at 8); planted edits are found as well.
WIDTH = 8
#: Images of an entry that one task pairs with as many others.
BLOCK = 1024
#: Table entries that two images must share before they are compared in full.
SHARED = 2
#: Bits in which matching corners may differ, and corners that must agree on one transform.
FAR, LEAST = 64, 10
#: Tolerances of that transform: radians, log of scale, pixels.
TURN, STRETCH, SHIFT = 0.26, 0.3, 4.0
#: Numbers of a matrix that the consensus has in memory at once.
CELLS = 1 << 20
_CORNERS = "id long, x array<float>, y array<float>, size array<float>, turn array<float>, code binary, sum long, sum2 long"


def _tests() -> np.ndarray:
    """256 pairs of points within the radius, the same everywhere."""
    u = mix64(np.arange(1, BITS * 4 + 1, dtype=U) * U(0x9FB21C651E98DF25)).astype(np.float64) / 2.0**64
    r, a = RADIUS * np.sqrt(u[: BITS * 2]), 2 * np.pi * u[BITS * 2 :]
    return np.stack([r * np.cos(a), r * np.sin(a)]).reshape(2, BITS, 2)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared pixels; the border is repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
        n = a.shape[axis]
        a = (np.take(s, np.arange(2 * r + 1, n + 2 * r + 1), axis) - np.take(s, np.arange(n), axis)) / (2 * r + 1)
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, to the rounded size."""
    if scale == 1:
        return a
    for axis in (1, 2):
        n = a.shape[axis]
        m = max(1, round(n * scale))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(n - 2, 0))
        hi, part = np.minimum(lo + 1, n - 1), at - lo
        part = part.reshape([-1 if k == axis else 1 for k in range(3)])
        a = np.take(a, lo, axis) * (1 - part) + np.take(a, hi, axis) * part
    return a


def corners(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of grey images (n, h, w): image, x, y (pixels of the original), size, turn and 256 bits of the strongest corners."""
    tests, out = _tests(), []
    for scale in SCALES:
        a = _resized(images.astype(np.float32), scale)
        h, w = a.shape[1:]
        if min(h, w) < 2 * RADIUS + 5:
            continue
        smooth = _box(a, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 1
        inner = strength[:, m:-m, m:-m]
        peak = inner > 0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = strength[:, m + dy : h - m + dy, m + dx : w - m + dx]
                    peak &= inner > other if (dy, dx) > (0, 0) else inner >= other
        i, y, x = np.nonzero(peak)
        s = inner[i, y, x]
        y, x = y + m, x + m
        mx, my = _box(gx, 3)[i, y, x], _box(gy, 3)[i, y, x]
        out.append((i, x, y, s, np.arctan2(my, mx), np.full(len(i), scale), smooth))
    if not out:
        return (np.zeros(0, int),) * 5 + (np.zeros((0, BITS // 8), np.uint8),)
    level = np.repeat(np.arange(len(out)), [len(o[0]) for o in out])
    i, x, y, s, turn, scale = (np.concatenate([o[k] for o in out]) for k in range(6))
    by = np.lexsort((x, y, level, -s, i))
    rank = np.arange(len(by)) - np.searchsorted(i[by], i[by])
    by = by[rank < CORNERS * max(1, -(-images.shape[1] * images.shape[2] // AREA))]
    i, x, y, turn, scale, level = i[by], x[by], y[by], turn[by], scale[by], level[by]
    bits = np.zeros((len(by), BITS), bool)
    for k, o in enumerate(out):
        at = np.flatnonzero(level == k)
        smooth = o[6]
        c, sn = np.cos(turn[at])[:, None, None], np.sin(turn[at])[:, None, None]
        px = np.rint(x[at][:, None, None] + c * tests[0] - sn * tests[1]).astype(int)
        py = np.rint(y[at][:, None, None] + sn * tests[0] + c * tests[1]).astype(int)
        px, py = np.clip(px, 0, smooth.shape[2] - 1), np.clip(py, 0, smooth.shape[1] - 1)
        v = smooth[i[at][:, None, None], py, px]
        bits[at] = v[:, :, 0] < v[:, :, 1]
    return i, (x + 0.5) / scale - 0.5, (y + 0.5) / scale - 0.5, 1 / scale, turn, np.packbits(bits, axis=1)


def _describe(batches):
    """id, height, width, pixels -> _CORNERS; images of one shape are worked on together."""
    names = [c.split()[0] for c in _CORNERS.split(", ")]
    for batch in batches:
        ids, hs, ws = (batch.column(k).to_pylist() for k in range(3))
        pixels = batch.column(3).to_pylist()
        shapes: dict[tuple, list[int]] = {}
        for k, (h, w, p) in enumerate(zip(hs, ws, pixels, strict=True)):
            ok = p is not None and h and w and h > 0 and w > 0 and len(p) == h * w
            shapes.setdefault((h, w) if ok else None, []).append(k)
        for shape, members in shapes.items():
            step = max(1, (1 << 20) // (shape[0] * shape[1])) if shape else 4096
            for a in range(0, len(members), step):
                part = members[a : a + step]
                if shape is None:
                    i, x, y, size, turn, code = (np.zeros(0, int),) * 5 + (np.zeros((0, BITS // 8), np.uint8),)
                else:
                    i, x, y, size, turn, code = corners(np.stack([np.frombuffer(pixels[k], np.uint8).reshape(shape) for k in part]))
                edge = np.searchsorted(i, np.arange(len(part) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(v.astype(np.float32))) for v in (x, y, size, turn)]
                codes = [code[p:q].tobytes() for p, q in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                sums = np.array([digest_of(pixels[k], shape) for k in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in part], pa.int64()), *lists, pa.array(codes, pa.binary()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=names)


def digest_of(pixels: bytes | None, shape: tuple | None) -> tuple[int, int]:
    """128 bits of an image's digest: equal images are one node."""
    digest = hashlib.sha256(repr(shape).encode() + (pixels or b"")).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


def consensus(a: dict, b: dict) -> tuple | None:
    """(agreeing corners, scale, turn, dx, dy) of the best transform from a to b, None without matches."""
    ca, cb = (np.unpackbits(np.frombuffer(x["code"], np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) for x in (a, b))
    if not len(ca) or not len(cb):
        return None
    to, near, back, least = np.zeros(len(ca), int), np.zeros(len(ca)), np.zeros(len(cb), int), np.full(len(cb), np.inf)
    step = max(1, CELLS // len(cb))
    for r in range(0, len(ca), step):
        apart = ca[r : r + step].sum(1)[:, None] + cb.sum(1)[None] - 2 * ca[r : r + step] @ cb.T
        to[r : r + step], near[r : r + step] = apart.argmin(1), apart.min(1)
        better = apart.min(0) < least
        back[better], least[better] = r + apart.argmin(0)[better], apart.min(0)[better]
    i = np.flatnonzero((back[to] == np.arange(len(to))) & (near <= FAR))
    j = to[i]
    if len(i) < 2:
        return None
    ax, ay, at = (np.asarray(a[k], float)[i] for k in ("x", "y", "turn"))
    bx, by, bt = (np.asarray(b[k], float)[j] for k in ("x", "y", "turn"))
    turn = bt - at
    stretch = np.log(np.asarray(b["size"], float)[j] / np.asarray(a["size"], float)[i])
    c, s = np.exp(stretch) * np.cos(turn), np.exp(stretch) * np.sin(turn)
    # corners of several scales at one place are one vote
    cells = (np.rint(ax / 2).astype(int) << 20) + np.rint(ay / 2).astype(int)
    votes = np.zeros(len(i), int)
    step = max(1, CELLS // len(i))
    for r in range(0, len(i), step):  # each match's own transform, tried on all
        own = slice(r, r + step)
        gx = bx[None] - (c[own, None] * (ax[None] - ax[own, None]) - s[own, None] * (ay[None] - ay[own, None]) + bx[own, None])
        gy = by[None] - (s[own, None] * (ax[None] - ax[own, None]) + c[own, None] * (ay[None] - ay[own, None]) + by[own, None])
        turned = np.abs((turn[None] - turn[own, None] + np.pi) % (2 * np.pi) - np.pi)
        good = (np.hypot(gx, gy) <= SHIFT) & (turned <= TURN) & (np.abs(stretch[None] - stretch[own, None]) <= STRETCH)
        votes[own] = [len(np.unique(cells[g])) for g in good]
    k = int(votes.argmax())
    return int(votes[k]), float(np.exp(stretch[k])), float(turn[k]), float(bx[k] - c[k] * ax[k] + s[k] * ay[k]), float(by[k] - s[k] * ax[k] - c[k] * ay[k])


def _verify(batches):
    names = ["a", "b", "votes", "scale", "turn", "dx", "dy"]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            got = consensus(r["p"], r["q"])
            if got and got[0] >= LEAST:
                out.append((r["a"], r["b"], *got))
        kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.float64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(7)], names=names)


def image_corners(df: DataFrame, id_col: str = "id") -> DataFrame:
    """id, x, y, size, turn, code, sum, sum2 of grey images (id, height, width, pixels: a byte each, row by row)."""
    return df.select(df[id_col].cast("long").alias("id"), df["height"].cast("int"), df["width"].cast("int"), df["pixels"].cast("binary")).mapInArrow(_describe, _CORNERS)


def image_copies(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per input row: id, n_corners, n_links, component_id, kept.

    ``n_links`` counts the links found on the way to the components, by the image's node (equal images are one node);
    ``component_id`` is the smallest identifier reachable. Pixels that are null or do not fit height and width have no
    corners; such rows are linked with rows of the same pixels only. Large images have more corners and are compared a
    block at a time. Rows without an identifier are images of their own: their ``component_id`` is null where no image
    of the component has one, and one of them is kept then. Rows that repeat an identifier and differ in pixels are
    images of their own too. Other columns, whatever their names, are not read. Empty input gives no rows.
    """
    told = materialise(image_corners(df, id_col).withColumn("row", F.monotonically_increasing_id()), "corners")
    keys, points = ["sum", "sum2"], F.struct("x", "y", "size", "turn", "code")
    same = told.groupBy(*keys).agg(F.min("id").alias("doc"), F.min(F.when(F.col("id").isNull(), F.col("row"))).alias("row"), F.any_value(points).alias("p"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(same.withColumn("id", F.monotonically_increasing_id()), "nodes")
    crowded = nodes.filter(F.col("copies") > max(told.count() * HOT, LEAST_HOT)).select("id", *keys).collect()
    members = told.select("row", "id", *keys, F.size("x").alias("n_corners"))
    members = materialise(look_up(members, nodes.select(*keys, F.col("id").alias("node")), keys, [r[1:] for r in crowded]).drop(*keys), "members")
    discard(told)
    full = nodes.filter("octet_length(p.code) > 0").select("id", "p")
    tables = BITS // 8 // WIDTH
    entry = lambda t: F.xxhash64(F.lit(t), F.expr(f"substring(code, k * {BITS // 8} + {t * WIDTH + 1}, {WIDTH})"))
    each = full.select("id", "p.code", F.explode(F.sequence(F.lit(0), F.size("p.x") - 1)).alias("k"))
    # one exchange: an image's second row of a key goes, then the key's images are counted
    by = Window.partitionBy("key")
    entries = each.select("id", F.explode(F.array(*[entry(t) for t in range(tables)])).alias("key")).withColumn("before", F.lag("id").over(by.orderBy("id")))
    entries = entries.filter("before is null or before <> id").select("id", "key", F.count(F.lit(1)).over(by).alias("m"))
    met = materialise(entries.filter("m > 1"), "met")
    ranked = met.join(met.groupBy("id").agg(F.sum("m").alias("rank")), "id")
    best = F.max(F.struct("rank", (-F.col("id")).alias("neg"))).alias("x")
    heads = ranked.groupBy("key").agg(best).select("key", (-F.col("x.neg")).alias("head"), F.col("x.rank").alias("head_rank"))
    crowds = hot_keys(met, ["key"])
    shared = materialise(look_up(met, heads, ["key"], crowds), "entries")
    leaders = hot_keys(shared, ["head"])

    tried = []

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """Links among the pairs (a, b) that come SHARED times; those of an earlier call are not compared again."""
        pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= SHARED).select("a", "b")
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        many = materialise(pairs, f"{tag}-pairs")
        tried.append(many)
        x = look_up(many, full.select(F.col("id").alias("a"), "p"), ["a"], how="inner").join(full.select(F.col("id").alias("b"), F.col("p").alias("q")), "b")
        out = materialise(x.select("a", "b", "p", "q").mapInArrow(_verify, "a long, b long, votes int, scale double, turn double, dx double, dy double"), f"{tag}-links")
        return out

    def apart(labels: DataFrame) -> DataFrame:
        """The entries' rows with the labels of the image and of the entry's head."""
        out = shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        out = look_up(out, labels.select(F.col("id").alias("head"), F.col("label").alias("head_label")), ["head"], leaders)
        return out.withColumn("head_label", F.coalesce("head_label", "head"))

    # 1: the head with the most company of all its entries' heads; 2: every entry's head that is not connected yet
    nearest = F.max(F.struct("head_rank", (-F.col("head")).alias("neg"))).alias("x")
    chosen = shared.filter("id <> head").groupBy("id").agg(nearest).select("id", (-F.col("x.neg")).alias("head"))
    links = [confirmed(shared.join(chosen, ["id", "head"], "left_semi").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")), "first")]
    labels = components(links[0])
    links.append(confirmed(apart(labels).filter("label <> head_label").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")), "second"))
    discard(labels)
    labels = components(links[0].select("a", "b").union(links[1].select("a", "b")))
    # 3: what is apart still: every pair of an entry with two labels, one of them not the head's, block by block. The
    # heads take part, so a pair comes once from each entry that it shares, whoever stands at its head
    state = materialise(apart(labels), "state")
    minor = state.filter("label <> head_label")
    sizes = minor.groupBy("key").agg(F.count(F.lit(1)).alias("minors"))
    sized = look_up(state, sizes, ["key"], crowds, "inner").withColumn("is_minor", F.col("label") != F.col("head_label"))
    blocks = lambda m: F.ceil(F.col(m) / BLOCK).cast("int")
    part = lambda m: F.pmod(F.xxhash64("id"), blocks(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), blocks(m) - 1))
    left = sized.filter("is_minor").select("key", "id", "label", part("minors").alias("i"), every("m").alias("j"))
    right = sized.select("key", F.col("id").alias("id2"), F.col("label").alias("label2"), F.col("is_minor").alias("minor2"), every("minors").alias("i"), part("m").alias("j"))
    rest = left.join(right, ["key", "i", "j"]).filter((F.col("label") != F.col("label2")) & (~F.col("minor2") | (F.col("id") < F.col("id2"))))
    links.append(confirmed(rest.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")), "third"))
    links = links[0].union(links[1]).union(links[2])
    discard(labels)
    labels = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    discard(state, shared, met, *tried)
    crowded = [r[:1] for r in crowded]
    rows = look_up(settle(members, nodes, labels, crowded), degree, ["node"], crowded)
    return rows.select(F.col("id").alias(id_col), F.col("n_corners").cast("long").alias("n_corners"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("component").alias("component_id"), "kept")


def vectors_as_images(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, height, width, pixels: each vector of n numbers as a grey picture of n x n, the products of its numbers.

    Vectors with nulls, without numbers or without spread have null pixels.
    """

    def run(batches):
        for batch in batches:
            sizes, pixels = [], []
            for v in batch.column(1).to_pylist():
                if not v or any(x is None or x != x for x in v) or max(v) == min(v):
                    sizes.append(None)
                    pixels.append(None)
                    continue
                a = np.outer(v, v).astype(np.float64)
                sizes.append(len(v))
                pixels.append(np.rint((a - a.min()) / (a.max() - a.min()) * 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sizes, pa.int32()), pa.array(pixels, pa.binary())], names=["id", "height", "width", "pixels"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "id long, height int, width int, pixels binary")
