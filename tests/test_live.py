import numpy as np

from framequarry import plans
from framequarry.operators import synthetic
from framequarry.plans.table_frames import live_signals
from framequarry.streaming import stabilizer as S


def test_a_stream_locks_passes_blinks_loses_and_rejoins(spark, sf):
    truth = {(r.stream, r["index"]): r.truth for r in live_signals(spark, sf).select("stream", "index", "truth").collect()}
    rows = plans.queries()["live_stabilizer"](spark, sf).collect()
    assert len(rows) == len(truth)
    by = {}
    for r in sorted(rows, key=lambda r: r["index"]):
        by.setdefault(r.stream, []).append(r)
    whole = [s for s in by if len(by[s]) >= 220]
    assert len(by) == 10 and len(whole) >= 3
    for s in whole:
        own = by[s][:220]
        states = [r.state for r in own]
        assert states[:23] == ["locking"] * 23 and states[23] == "locked"
        assert not any(r.registered for r in own[60:63]) and all(x == "locked" for x in states[60:63])  # a blink
        first = states.index("lost")
        assert 90 + 16 <= first <= 90 + 22 and "rejoined" in states[150:]
        back = states.index("rejoined")
        errors = np.array([r.offset - truth[s, r["index"]] for r in own if r.registered and r["index"] < 90])
        again = np.array([r.offset - truth[s, r["index"]] for r in own if r.registered and r["index"] > back])
        assert len(again) >= 20 and np.abs(errors - np.median(errors)).max() < 0.3 and abs(np.median(again) - np.median(errors)) < 0.2


def frames(n, seed=1, scene=3):
    a = synthetic.scene(1, 256, scene)[0] + 0.05 * np.random.default_rng(seed).normal(size=256)
    rng = np.random.default_rng(seed)
    return [(S.moved(a, d) + rng.normal(0, 0.003, 256), d) for d in np.cumsum(rng.normal(0, 0.5, n))]


def test_state_survives_being_saved():
    """A stream that is stored and restored at every frame gives the same as one that is not."""
    whole, parts, saved, older = S.Stream(None, []), [], None, []
    want = [whole.step(f, k / 10) for k, (f, _) in enumerate(frames(60))]
    for k, (f, _) in enumerate(frames(60)):
        s = S.Stream(saved, older)
        parts.append(s.step(f, k / 10))
        saved, older = s.saved(), s.older
    assert all(p[1:] == w[1:] and (p[0] is None) == (w[0] is None) and abs((p[0] or 0) - (w[0] or 0)) < 1e-9 for p, w in zip(parts, want, strict=True))


def test_awkward_frames():
    s = S.Stream(None, [])
    assert s.step(np.array([]), 0.0) == (None, False, "locking") and s.step(np.array([1.0, np.nan]), 0.0) == (None, False, "locking")
    for k, (f, _) in enumerate(frames(30)):
        s.step(f, float(k))
    assert s.base is not None
    assert s.step(frames(1)[0][0][:100], 40.0) == (None, False, "locking")  # another size begins anew
    for k in range(60):
        s.step(np.random.default_rng(k).normal(size=100), 41.0 + k)
    assert len(s.older) <= S.REMEMBERED


def test_template_does_not_drift():
    """Half of it is the permanent base, so what fades in cannot carry the template away."""
    s = S.Stream(None, [])
    for k, (f, _) in enumerate(frames(24)):
        s.step(f, k / 10)
    base = s.base.copy()
    for k, (f, _) in enumerate(frames(400, seed=1)[24:]):
        s.step(f, 3 + k / 10)
    assert abs(S.registered(base, s.template())[0]) < 0.2 and s.weight < 64.5


def test_buffer_never_holds_more_than_its_slots(spark, sf):
    rows = plans.queries()["bounded_buffer"](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.stream, []).append((r["index"], r.taken, r.dropped))
    for got in by.values():
        got.sort()
        assert [d for _, _, d in got] == np.cumsum([not t for _, t, _ in got]).tolist()
