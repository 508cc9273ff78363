import numpy as np
import pytest

from framequarry import config, plans
from framequarry.__main__ import inside, main
from framequarry.operators import fields, registration, synthetic
from framequarry.sources import results


def rotation(degrees, centre):
    a = np.radians(degrees)
    m = np.array([[np.cos(a) - 1, -np.sin(a)], [np.sin(a), np.cos(a) - 1]])
    return np.column_stack([m, -m @ np.array(centre)])


def test_field_of_a_turned_frame():
    a, grid = synthetic.scene(200, 280, 5), fields.Grid(200, 280)
    none = fields.Field.none(grid)
    turned = fields.warped(a, fields.Field(rotation(0.6, (140, 100)), none.local), grid)
    turned = np.where(np.isfinite(turned), turned, a.mean())
    f = none
    for _ in range(4):
        f = fields.absorbed(fields.composed(f, fields.measured(a, fields.warped(turned, f, grid), grid), grid), grid)
    angle = np.degrees(np.arctan2(f.affine[1, 0] - f.affine[0, 1], 2 + f.affine[0, 0] + f.affine[1, 1]))
    assert abs(angle + 0.6) < 0.01


def test_composition_is_one_after_the_other():
    grid, rng = fields.Grid(160, 200), np.random.default_rng(1)
    first, then = (fields.Field(rng.normal(0, 0.01, (2, 3)) + [[0, 0, k], [0, 0, -k]], np.full((len(grid.y), len(grid.x), 2), 0.3 * k)) for k in (1, 2))
    both = fields.composed(first, then, grid)
    x, y = np.meshgrid(grid.x, grid.y)
    dx, dy = then.at(grid, y, x)
    ex, ey = first.at(grid, y + dy, x + dx)
    gx, gy = both.at(grid, y, x)
    assert np.allclose(gx, dx + ex, atol=1e-9) and np.allclose(gy, dy + ey, atol=1e-9)
    moved = fields.absorbed(both, grid)
    assert np.allclose(moved.at(grid, y, x), (gx, gy)) and np.abs(moved.local).max() < 1e-9
    assert np.allclose(both.scaled(2).affine[:, 2], 2 * both.affine[:, 2])


def test_robust_affine_ignores_outliers():
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 100, (2, 60))
    m = np.array([[0.01, -0.02, 1.5], [0.02, 0.01, -0.7]])
    d = np.column_stack([m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2]])
    d[:8] += rng.normal(0, 20, (8, 2))
    for model in ("affine", "similarity"):
        assert np.abs(fields.robust_affine(x, y, d, np.ones(60), model, rounds=12) - m).max() < 0.2
    gaps = np.full((3, 4, 2), np.nan)
    assert (fields.smooth_grid(gaps) == 0).all()
    gaps[1, 1] = 2.0
    assert (fields.smooth_grid(gaps)[:3, :3] == 2).all() and (fields.smooth_grid(gaps)[:, 3] == 0).all()


def test_features_and_models():
    a = synthetic.scene(160, 220, 8)
    p, dp = fields.corner_patches(a)
    q, dq = fields.corner_patches(synthetic.shifted(a, 4.2, -6.1))
    m = fields.matched(dp, dq)
    s, good = fields.consensus(p[m[:, 0]], q[m[:, 1]])
    assert good.sum() >= 20 and np.abs(s - [[1, 0, -6.1], [0, 1, 4.2]]).max() < 0.5
    assert fields.consensus(p[:2], p[:2])[0] is None and len(fields.matched(dp[:1], dq)) == 0
    assert fields.chosen_model(p, p + [3, 4])[0] == "translation"
    assert fields.chosen_model(p, p @ np.array([[1.02, 0.03], [-0.02, 0.99]]) + [3, 4])[0] == "affine"
    h = np.array([[1.02, 0.01, 3], [0.01, 0.98, 2], [2e-4, -1e-4, 1]])
    w = (p @ h[:2, :2].T + h[:2, 2]) / (p @ h[2, :2] + 1)[:, None]
    name, got, misfit = fields.chosen_model(p, w)
    assert name == "homography" and np.abs(got - h).max() < 1e-6 and misfit < 1e-6


def test_recordings_from_files_to_transforms(spark, sf):
    """The error of every recording is at most 0.12 pixels; blinks go, nothing else does; frames are those of the table."""
    q = plans.queries()
    n = {r.label: r["count"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").count().collect()}
    rows = q["stabilized_recordings"](spark, sf).collect()
    assert len(rows) == sum(n.values())
    assert all(r.keep == r.registered == (not r.blink) for r in rows) and any(r.blink for r in rows)
    for label, count in n.items():
        e = [r.error for r in rows if r.burst == f"burst_{label:02d}" and r.registered]
        assert np.sqrt(np.mean(np.square(e))) <= 0.12 and len(e) > 0.8 * count
    found = {r.burst: r for r in q["recorded_bursts"](spark, sf).collect()}
    assert not found["burst_zblack"].has_data and found["burst_00"].has_data and [found[b].place for b in sorted(found)] == list(range(1, len(n) + 2))
    assert found["burst_01"].seconds == round((n[1] - 1) / 32, 6) and found["burst_02"].fps == 32.0 and found["burst_03"].frames == n[3]
    sums = q["file_checksums"](spark, sf).collect()
    assert {r.state for r in sums if r.burst != "burst_zblack"} == {"verified"} and {r.state for r in sums if r.burst == "burst_zblack"} == {"unexpected"}


def test_methods_scored_alike(spark, sf):
    q = plans.queries()
    got = {(r.burst, r.method): r.overlap for r in q["warp_methods"](spark, sf).collect()}
    for b in {k[0] for k in got}:
        assert got[b, "registered"] >= got[b, "ceiling"] - 0.01 and got[b, "none"] <= got[b, "registered"] + 0.01
    lookup = q["frame_lookup"](spark, sf).collect()
    unused = sum(not r.used for r in lookup)
    assert all(r.why for r in lookup if not r.used) and 0 < unused < 0.1 * len(lookup)
    seg = q["stabilized_for_segmenter"](spark, sf).collect()
    assert len(seg) == len(lookup) - unused and all(r.area > 0 for r in seg)
    steps = q["consecutive_steps"](spark, sf).collect()
    assert all(abs(r.drift_y) < 3 and abs(r.drift_x) < 3 for r in steps)


def test_nonrigid(spark, sf):
    q = plans.queries()
    rows = q["nonrigid_recording"](spark, sf).collect()
    n = {r.label: -(-r["count"] // 8) for r in spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").count().collect()}
    assert len(rows) == sum(n.values()) and max(abs(r.true_angle - r.angle) for r in rows) < 0.05 and not any(r.rejected for r in rows)
    spread = {tuple(r.key.split("/")): r.largest for r in q["tile_residuals"](spark, sf).collect()}
    assert len(spread) == 2 * len(n) and all(s < 0.3 * spread[b, "translation"] for (b, m), s in spread.items() if m == "nonrigid")
    features = q["feature_registration"](spark, sf).collect()
    assert len(features) == len(rows) and all(r.good for r in features)


def test_stabilize_awkward_recordings(spark):
    """Frames that do not decode, black recordings, one frame, no frames."""
    a = (synthetic.scene(48, 64, 1) * 4095).astype("<u2").tobytes()
    rows = [("one", 0, 48, 64, 12, a), ("broken", 0, 48, 64, 12, b"xx"), ("broken", 1, 48, 64, 12, a), ("broken", 2, None, None, None, None), ("black", 0, 4, 4, 12, b"\0" * 32), ("black", 1, 4, 4, 12, b"\0" * 32)]
    df = spark.createDataFrame(rows, "burst string, index int, height int, width int, bit_depth int, pixels binary")
    got = {(r.burst, r["index"]): r.registered for r in registration.stabilize(df).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows} and got["one", 0] and got["broken", 1] and not got["broken", 0] and not got["broken", 2]
    assert registration.stabilize(df.limit(0)).collect() == []


def test_results_on_disk(spark, tmp_path):
    root = f"file://{tmp_path}"
    nodes = spark.createDataFrame([(1, float("nan")), (2, 3.5)], "node int, x double")
    edges = spark.createDataFrame([(1, 2, [1.0, float("nan")], 'a<b&"c"')], "u int, v int, r array<double>, name string")
    results.write_network(nodes, edges, f"{root}/net")
    n, e = results.read_network(spark, f"{root}/net", "node int, x double", "u int, v int, r array<double>, name string")
    assert {(r.node, r.x) for r in n.collect()} == {(1, None), (2, 3.5)} and e.first().r == [1.0, None] and e.first().name == 'a<b&"c"'
    assert '"x":null' in spark.read.text(f"{root}/net/nodes.json").filter("value like '%1%'").first().value
    lines = [r.value for r in results.graphml(nodes.limit(0), edges.drop("r"), "node", "u", "v").collect()]
    assert lines == ['<edge source="1" target="2"><data key="name">a&lt;b&amp;&quot;c&quot;</data></edge>']
    made = []
    for _ in range(2):
        assert results.once(spark, f"{root}/once", lambda: made.append(1) or nodes).count() == 2
    assert made == [1]
    with pytest.raises(ValueError):
        results.write_overlay(spark, f"{root}/o.json", {"version": 2, "format": "x"})
    results.write_overlay(spark, f"{root}/o.json", {"version": 1, "format": "x", "vessels": []})
    assert results.exists(spark, f"{root}/o.json") and not results.exists(spark, f"{root}/o.json.part")
    results.write_summary(spark.createDataFrame([("a<b", 1.25)], "burst string, score double"), f"{root}/s", "T&T")
    page = (tmp_path / "s" / "summary.html").read_text()
    assert "a&lt;b" in page and "1.250" in page and "T&amp;T" in page
    assert results.enough_space(spark, root, 10) and not results.enough_space(spark, root, 1 << 62)


def test_settings_and_commands(spark, tmp_path, capsys):
    p = config.METHODS["translation"]
    q = config.overridden(p, ["tolerance=0.2", "height=300"])
    assert (q.tolerance, q.height, q.most_rounds) == (0.2, 300, p.most_rounds) and config.fingerprint(q) != config.fingerprint(p)
    with pytest.raises(KeyError):
        config.overridden(p, ["nothing=1"])
    assert inside("/a/b/c", "/a/b") and inside("/a/b", "/a/b/") and not inside("/a/bc", "/a/b")
    assert main(["list"]) == 0 and "segmenter ridges" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["stabilize", "/a/b", "/a/b/out"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"abc")
    args = ["checksums", f"file://{tmp_path}/in", f"file://{tmp_path}/out"]
    assert main(args) == 0 and main(args) == 0 and "nothing to do" in capsys.readouterr().out
    assert spark.read.parquet(f"file://{tmp_path}/out").first().sha256.startswith("ba7816bf")


def test_errors_stay_with_their_recording(spark, sf):
    rows = plans.queries()["isolated_errors"](spark, sf).collect()
    n = {r.user_id: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}
    assert all((r.status == "error") == (n[r.user_id] < 60) == (r.message is not None) for r in rows) and len(rows) == len(n)
