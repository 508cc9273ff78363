import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.llm import image_copies as module
from framequarry.llm.image_copies import _resized, image_copies, vectors_as_images
from framequarry.llm.toxicity import PATTERNS, fit, held_out, label_model, patterns, toxicity

IMAGES = "id long, height int, width int, pixels binary"


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    docs, labels = [], []
    for k in range(900):
        words = [rnd.choice("abcdefgh") + rnd.choice("stuvw") * rnd.randrange(1, 5) for _ in range(rnd.randrange(5, 60))]
        toxic = rnd.random() < 0.15
        if toxic:
            words += rnd.choice([["idiot", "blorgh"], ["schmarrnx", "schmarrny", "schmarrnz"]])
        elif rnd.random() < 0.1:
            words += ["schmarrnq"]
        rnd.shuffle(words)
        docs.append((k, " ".join(words), "src"))
        labels.append((k, 1, int(toxic)))
    docs += [(5000, None, None), (None, "idiot", None), (5001, "", "x"), (5001, "", "x")]
    labels += [(7777, 0, 1), (3, 0, None), (None, 0, 1), (4, 0, 7)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = toxicity(docs, fit(docs, labels))
    assert got.count() == 904
    rows = got.join(labels.filter("toxic in (0, 1)"), "doc_id").filter("held_out").collect()
    assert len(rows) > 120 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())


def test_held_out_rows_teach_nothing(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs, labels), fit(docs, flipped)
    assert (a.known == b.known).all() and np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)


def test_labels_beyond_the_bound_are_not_used(corpus):
    """Their texts are learned from by posterior labels alone, so flipped labels change nothing."""
    docs, labels = corpus
    first = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).join(docs, "doc_id", "left_semi").withColumn("p", F.xxhash64("doc_id")).orderBy("p").limit(400)
    gold = [r.doc_id for r in first.collect()]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(gold), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = fit(docs, labels, most_gold=400), fit(docs, flipped, most_gold=400)
    assert (a.known == b.known).all() and np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)
    got = toxicity(docs, a).join(labels.filter("toxic in (0, 1)"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95


def test_patterns_read_the_text():
    texts = ["what an idiot and a moron", "you utter fool", "THIS WILL NEVER STOP", "no! not! now!?", "sh*t c#ock 5 * 6", "idiot " + "word " * 300 + "idiot", "A! B", "", "you", "fool"]
    raw = [t.encode() for t in texts]
    got = patterns(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [[PATTERNS[k] for k in np.flatnonzero(r)] for r in got] == [
        ["several insults", "dense", "near each other"],
        ["dense", "addressed"],
        ["shouting"],
        ["repeated marks"],
        ["masked letters"],
        [],
        [],
        [],
        [],
        ["dense"],
    ]


def test_one_class_or_no_labels(corpus):
    docs, labels = corpus
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity(docs, fit(docs, some)).collect()} == {0}
    assert toxicity(docs.limit(0), fit(docs.limit(0), labels)).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    votes = np.stack([np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.1))], 1)
    votes = np.concatenate([votes, votes[:, :1]], 1).astype(float)  # the last is the first again
    post, weight = label_model(votes, 0.2, np.full(4, 0.6))
    assert np.mean((post > 0.5) == y) > 0.93 and abs(weight[0] - weight[3]) < 1e-6 and weight[0] < weight[2] * 2.5


def scenes(n, seed):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        a = _resized(rng.normal(size=(1, 14, 14)), 8)[0]
        for _ in range(20):
            y, x = rng.integers(0, 90, 2)
            a[y : y + rng.integers(4, 22), x : x + rng.integers(4, 22)] += rng.normal() * 2
        yield (a - a.min()) / (a.max() - a.min()) * 255


def test_image_copies(spark):
    rng, rows, group = np.random.default_rng(3), [], {}
    for g, a in enumerate(scenes(16, 3)):
        versions = [a]
        if g % 2 == 0:
            versions += [a[10:100, 14:108], np.clip(a * 0.8 + 20 + rng.normal(0, 3, a.shape), 0, 255), a.copy(), np.rot90(a), _resized(a[None], 0.75)[0]]
        for v in versions:
            v = np.ascontiguousarray(np.rint(v), np.uint8)
            group.setdefault(g, []).append(len(rows))
            rows.append((len(rows), *v.shape, v.tobytes()))
    rows += [(900, 5, 5, None), (901, 3, 3, b"123456789"), (902, 3, 3, b"1"), (None, 0, 0, b""), (903, None, 3, b"1")]
    got = image_copies(spark.createDataFrame(rows, IMAGES))
    component = {r.id: r.component_id for r in got.collect()}
    assert len(component) == len(rows)
    for ids in group.values():
        assert {component[i] for i in ids} == {ids[0]}
    assert image_copies(spark.createDataFrame([], IMAGES)).collect() == []


def test_copies_are_found_beside_many_others(spark):
    """Exact copies of another picture take no edited copy away."""
    rng, rows = np.random.default_rng(11), []
    for a in scenes(12, 11):
        a = a[20:84, 20:84]
        rows += [(len(rows) + k, 64, 64, np.rint(np.clip(v, 0, 255)).astype(np.uint8).tobytes()) for k, v in enumerate((a, a + rng.normal(0, 12, a.shape)))]
    other = np.rint(next(scenes(1, 12))[20:84, 20:84]).astype(np.uint8).tobytes()
    many = spark.range(1000, 17_000).select("id", F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(other).alias("pixels"))
    few = spark.createDataFrame(rows, IMAGES)
    alone, beside = ({r.id: r.component_id for r in image_copies(x).filter("id < 1000").collect()} for x in (few, few.union(many)))
    assert alone == beside and sum(alone[k] == alone[k + 1] for k in range(0, 24, 2)) >= 6


def test_shared_entries_count_whoever_is_at_their_head(spark, monkeypatch):
    """0 and 1 share two entries, one of them headed by 2, an image with more company."""
    rng = np.random.default_rng(4)
    far = lambda n: rng.integers(0, 256, (n, 32), dtype=np.uint8)
    x = far(14)
    y = x.copy()
    y[:, ::8] ^= 1  # a bit of each corner in each entry
    y[0, 0] ^= 1
    y[1, 8] ^= 1
    hub, others = far(14), [far(14) for _ in range(3)]
    hub[5, 8:16] = x[1, 8:16]
    for k, o in enumerate(others):
        o[k, :8] = hub[10 + k, :8]
        o[k, 16:24] = hub[10 + k, 16:24] ^ 1
    codes, place = [x, y, hub, *others], [float(v) for v in range(0, 140, 10)]
    rows = [(k, place, place, [1.0] * 14, [0.0] * 14, c.tobytes(), k + 1, k) for k, c in enumerate(codes)]
    told = spark.createDataFrame(rows, module._CORNERS)
    monkeypatch.setattr(module, "image_corners", lambda df, id_col: told)
    for block in (1024, 1):
        monkeypatch.setattr(module, "BLOCK", block)
        got = {r.id: (r.component_id, r.n_links) for r in image_copies(told).collect()}
        assert got == {0: (0, 1), 1: (0, 1)} | {k: (k, 0) for k in range(2, 6)}


def edited(n, seed):
    """(scene, image) of n scenes: as it is, cropped, noisy and darker, turned, smaller."""
    rng = np.random.default_rng(seed)
    for g, a in enumerate(scenes(n, seed)):
        for v in (a, a[10:100, 14:108], np.clip(a * 0.8 + 20 + rng.normal(0, 3, a.shape), 0, 255), np.rot90(a), _resized(a[None], 0.75)[0]):
            yield g, np.ascontiguousarray(np.rint(v), np.uint8)


def test_recall_against_all_pairs(spark):
    """Of the pairs that full comparison of everything with everything links, at least 0.9 end in one component, and no others."""
    group, rows = [], []
    for g, v in edited(14, 21):
        rows.append((len(rows), *v.shape, v.tobytes()))
        group.append(g)
    told = {r.id: {"x": r.x, "y": r.y, "size": r["size"], "turn": r.turn, "code": bytes(r.code)} for r in module.image_corners(spark.createDataFrame(rows, IMAGES)).collect()}
    linked = [(a, b) for a in told for b in told if a < b and (got := module.consensus(told[a], told[b])) and got[0] >= module.LEAST]
    assert all(group[a] == group[b] for a, b in linked) and len(linked) >= 0.9 * 14 * 10
    component = {r.id: r.component_id for r in image_copies(spark.createDataFrame(rows, IMAGES)).collect()}
    assert sum(component[a] == component[b] for a, b in linked) >= 0.9 * len(linked)
    assert all(group[i] == group[c] for i, c in component.items())


def test_image_rows_without_identifier(spark):
    a, b = (np.rint(next(scenes(1, k))).astype(np.uint8).tobytes() for k in (31, 32))
    rows = [(1, 112, 112, a), (None, 112, 112, a), (None, 112, 112, b), (None, 112, 112, b)]
    df = spark.createDataFrame(rows, IMAGES).withColumn("code", F.lit(1)).withColumn("key", F.lit("x"))
    got = sorted(((r.id, r.component_id, r.kept) for r in image_copies(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (None, 1, False), (None, None, True), (None, None, False)], key=str)


def test_small_crop_of_a_large_picture(spark):
    """A crop has its own corners in the whole picture's list, however many stronger ones stand elsewhere."""
    tiles = [next(scenes(1, k))[:96, :96] for k in range(20, 36)]
    whole = np.block([[t * (0.3 if k == r == 0 else 1) for k, t in enumerate(tiles[4 * r : 4 * r + 4])] for r in range(4)])
    rows = [(k, *a.shape, np.rint(a).astype(np.uint8).tobytes()) for k, a in enumerate((whole, np.ascontiguousarray(whole[200:290, 100:190])))]
    got = {r.id: (r.n_corners > 400, r.component_id) for r in image_copies(spark.createDataFrame(rows, IMAGES)).collect()}
    assert got == {0: (True, 0), 1: (False, 0)}


def test_vectors_as_images(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=64) for _ in range(12)]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(100 + k, (v + rng.normal(size=64) * 0.005).tolist()) for k, v in enumerate(vectors)]
    rows += [(200, None), (201, []), (202, [1.0, None]), (203, [2.0, 2.0])]
    got = image_copies(vectors_as_images(spark.createDataFrame(rows, "vec_id long, v array<float>"), "vec_id", "v"))
    component = {r.id: r.component_id for r in got.collect()}
    assert all(component[100 + k] == k for k in range(12)) and component[203] in (200, 203)
