"""Intervals evaluated without pairs, against the pairs themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import book, intervals, joins

H = 10


@pytest.mark.parametrize("chunk", [1, 3, 8, 64])
def test_runs_against_loops(chunk):
    rng = np.random.default_rng(chunk)
    v = rng.integers(0, 9, 40).astype(float)
    v[[5, 17]], v[23], v[31] = np.inf, -np.inf, np.nan
    i = rng.integers(0, 41, 60)
    j = np.minimum(40, i + rng.integers(0, 30, 60))
    with np.errstate(invalid="ignore"):
        np.testing.assert_allclose(intervals.sums(v, i, j, chunk), [v[a:b].sum() for a, b in zip(i, j)])
    np.testing.assert_array_equal(intervals.extremes(v, i, j, np.maximum, -np.inf, chunk), [max([-np.inf], key=float) if a == b else np.maximum.reduce(v[a:b]) for a, b in zip(i, j)])
    np.testing.assert_array_equal(intervals.extremes(v, i, j, np.fmin, np.nan, chunk), [np.nan if a == b else np.fmin.reduce(v[a:b]) for a, b in zip(i, j)])
    w = np.nan_to_num(v, nan=1.0)
    bar = rng.integers(1, 12, 60).astype(float)
    want = [next((k for k in range(a, b) if w[k] >= x), -1) for a, b, x in zip(i, j, bar)]
    np.testing.assert_array_equal(intervals.first(w, i, j, np.maximum, lambda x, r: x >= bar[r], chunk), want)


def rows(seed):
    rng = random.Random(seed)
    ev = [(rng.choice(["A", "B", None]), rng.choice([None, *range(60)]), rng.choice([None, 0.0, 50.0, 100.0, 131.0, 200.0]), rng.choice([None, 1.0, -2.5])) for _ in range(150)]
    sig = [(i, rng.choice(["A", "B", None]), rng.choice([None, *range(60)]), rng.choice(["LONG", "SHORT"]), rng.choice([None, 100.0])) for i in range(40)]
    return [*ev, *ev[:20]], [*sig, *sig[:5]]  # some rows twice


@pytest.mark.parametrize("closed", ["[]", "(]", "[)", "()"])
def test_range_agg_without_pairs_is_range_agg(frame, closed):
    ev, sig = rows(1)
    e = frame(ev, "symbol string, ts long, price double, qty double")
    l = frame(sig, "id long, symbol string, hi long, side string, ref double").withColumn("lo", F.col("hi") - 25)
    pairs = joins.range_agg(l, e, "lo", "hi", [F.count("r_ts").alias("n"), F.sum("r_price").alias("s"), F.max("r_price").alias("x"), F.min("r_qty").alias("m")], closed, H, ["id"])
    fast = joins.range_agg(l, e, "lo", "hi", {"n": ("count", "ts"), "s": ("sum", "price"), "x": ("max", "price"), "m": ("min", "qty")}, closed, H, ["id"])
    order = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    assert order(fast) == order(pairs) and fast.schema.simpleString() == pairs.schema.simpleString()


def test_pulse_against_pairs(frame):
    ev, sig = rows(2)
    got = book.pulse(frame(sig, "signal_id long, symbol string, ts long, side string, reference_mid double"), frame(ev, "symbol string, ts long, mid double, signed double"), [5, 12, 30], 3000, 30)
    want = {}
    for i, sym, t0, side, ref in sig:
        for h in (5, 12, 30):
            near = [x for x in ev if sym and t0 is not None and x[0] == sym and x[1] is not None and t0 <= x[1] <= t0 + h]
            for _, t, mid, signed in near:
                k = 1.0 if side == "LONG" else -1.0
                want.setdefault((i, h), []).append((t, None if mid is None or ref is None else k * (mid / ref - 1) * 10000, signed, k))
    res = {(r.signal_id, r.horizon): r for r in got.collect()}
    assert set(res) == set(want)
    for at, p in want.items():
        r, ms = res[at], [m for _, m, _, _ in p if m is not None]
        assert r.mfe_bps == (max(ms) if ms else None) and r.mae_bps == (-min(ms) if ms else None)
        flow = [s for _, _, s, _ in p if s is not None]
        assert r.signed_flow == (p[0][3] * sum(flow) if flow else None)
        assert r.ret_bps in [m for t, m, _, _ in p if t == max(x[0] for x in p)]
        f, a = (min((t for t, m, _, _ in p if m is not None and hit(m)), default=None) for hit in (lambda m: m >= 3000, lambda m: m <= -3000))
        assert r.barrier == ("NEITHER" if f is None and a is None else "FAVORABLE_FIRST" if a is None or (f is not None and f < a) else "ADVERSE_FIRST")


def test_no_pairs_are_formed(frame):
    """The rows that meet in a bucket stay queries and events: the plan has a cogroup and no join of the two."""
    e, s = frame([("A", i, 1.0, 1.0) for i in range(9)], "symbol string, ts long, mid double, signed double"), frame([(1, "A", 2, "LONG", 1.0)], "signal_id long, symbol string, ts long, side string, reference_mid double")
    plan = book.pulse(s, e, [5], 3000, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
