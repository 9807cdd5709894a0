"""Rules at their edges: ties, gaps, closedness, validation, causality, matching."""

import io
import itertools
import zipfile

import pytest
from pyspark.sql import Window, functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book, controls, events, joins, panel, paths, quality, resample, splits, stats, windows
from tickloom.sources import readers, sinks

B = "symbol string, ts long, open double, high double, low double, close double, volume double, buy_volume double, trades long"
H = S.HOUR


def bar(i, o, h, l, c, v=1.0, sym="A"):
    return (sym, i * H, float(o), float(h), float(l), float(c), float(v), float(v) / 2, 1)


def labelled(frame, bars, side, f=0.1, a=0.1):
    d = paths.forward_path(frame(bars, B), H, len(bars) - 1).withColumn("side", F.lit(side))
    return d


def test_same_bar_counts_as_adverse(frame):
    d = labelled(frame, [bar(0, 100, 100, 100, 100), bar(1, 100, 112, 88, 100), bar(2, 100, 100, 100, 100)], "LONG")
    assert paths.triple_barrier(d, 0.1, 0.1, 0.0).collect()[0].outcome == "ADVERSE_FIRST_OR_SAME"
    assert paths.barrier_ambiguous(d, 0.1, 0.1, 0.0).collect()[0].outcome == "SAME_BAR_AMBIGUOUS"


def test_barriers_first_and_sides(frame):
    bars = [bar(0, 100, 100, 100, 100), bar(1, 100, 105, 99, 104), bar(2, 104, 115, 103, 110)]
    up, dn = (paths.triple_barrier(labelled(frame, bars, s), 0.1, 0.1, 0.01).collect()[0] for s in ("LONG", "SHORT"))
    assert (up.outcome, up.event_bar, round(up.utility, 9)) == ("FAVORABLE_FIRST", 2, 0.09)
    assert (dn.outcome, dn.event_bar, round(dn.utility, 9)) == ("ADVERSE_FIRST_OR_SAME", 2, -0.11)


def test_gapped_and_short_paths_are_quarantined(frame):
    d = paths.forward_path(frame([bar(i, 1, 1, 1, 1) for i in (0, 1, 2, 4, 5)], B), H, 2, strict=False)
    got = {r.ts // H: r.quarantine_reason for r in d.collect()}
    assert got == {0: None, 1: "FUTURE_GAP", 2: "FUTURE_GAP", 4: "INCOMPLETE_HORIZON", 5: "INCOMPLETE_HORIZON"}


def test_future_change_leaves_earlier_labels(frame):
    bars = [bar(i, 100 + i, 101 + i, 99 + i, 100 + i) for i in range(12)]
    wild = [b if b[1] <= 6 * H else bar(b[1] // H, 1, 900, 1, 500) for b in bars]
    f = lambda x: sorted(tuple(r) for r in paths.next_open_outcome(frame(x, B), H, 3, 5, 2, 1).filter(f"ts <= {3 * H}").select("ts", "side", "net").collect())
    assert f(bars) == f(wild) and len(f(bars)) == 8


def test_resample_drops_incomplete_and_misaligned(frame):
    good = [bar(i, 1, 2, 1, 1) for i in range(4)]
    assert resample.resample_complete(frame(good + [bar(4, 1, 1, 1, 1)], B), H, 4).count() == 1
    off = [(s, t + (60 if t == 2 * H else 0), *r) for s, t, *r in good]
    assert resample.resample_complete(frame(off, B), H, 4).count() == 0
    assert resample.resample_complete(frame(good[:3], B), H, 4).count() == 0


def test_asof_exact_match_policy(frame):
    l = frame([("A", 10), ("A", 20)], "symbol string, ts long")
    r = frame([("A", 10, 1.0), ("A", 15, 2.0), ("B", 19, 9.0)], "symbol string, ts long, v double")
    f = lambda **k: [x.v for x in joins.asof_join(l, r, slice_width=4, **k).orderBy("ts").collect()]
    assert f() == [1.0, 2.0] and f(allow_exact=False) == [None, 2.0] and f(tolerance=4) == [1.0, None]
    assert f(direction="forward") == [1.0, None]


@pytest.mark.parametrize("closed,want", [("[)", 1.0), ("(]", 10.0), ("[]", 11.0), ("()", 0.0)])
def test_interval_closedness(frame, closed, want):
    l = frame([(1, "A", 10, 20)], "id long, symbol string, lo long, hi long")
    e = frame([("A", 10, 1.0), ("A", 20, 10.0), ("A", 25, 100.0)], "symbol string, ts long, v double")
    s = joins.range_sum(l, e, "lo", "hi", {"s": "v"}, closed, by=["symbol"], slice_width=7).collect()[0].s
    a = joins.range_agg(l, e, "lo", "hi", [F.sum("r_v").alias("s")], closed, 8, ["id"]).collect()[0].s
    assert s == want and (a or 0.0) == want


def test_validated_join_fails_on_repeats(frame):
    a, b = frame([(1, "x")], "k long, a string"), frame([(1, "y"), (1, "z")], "k long, b string")
    with pytest.raises(Exception, match="repeats a join key"):
        joins.join_validated(a, b, ["k"]).collect()
    assert joins.join_validated(b, a, ["k"], "m:1").count() == 2


def test_fills_are_used_once(frame):
    s = frame([(1, "A", 0, 100.0), (2, "A", 3, 100.0), (3, "A", 50, 100.0)], "signal_id long, symbol string, ts long, ref_price double")
    f = frame([("A", 4, 99.0, 11), ("A", 6, 98.0, 12), ("A", 90, 1.0, 13)], "symbol string, ts long, price double, fill_id long")
    got = {r.signal_id: r.fill_id for r in joins.match_fills(s, f, 10).collect()}
    assert got == {1: 11, 2: 12, 3: None}


def test_bar_source_rejects_bad_rows(spark, frame, tmp_path):
    ok = [bar(i, 10, 11, 9, 10)[:7] for i in range(3)]
    def load(rows, strict=True):
        p = str(tmp_path / f"{abs(hash(str(rows)))}")
        frame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double").write.csv(p, header=True)
        return readers.load_bars_csv(spark, p, 0, 10 * H, H, strict).count()
    assert load(ok) == 3
    for bad, msg in (([*ok, bar(5, 10, 11, 9, 10)[:7]], "step differs"), ([*ok, bar(3, 10, 9, 9, 10)[:7]], "invalid bar"), ([*ok, bar(3, 10, 11, 9, 10, -1)[:7]], "invalid bar")):
        with pytest.raises(Exception, match=msg):
            load(bad)


def test_kline_archive_files(spark, tmp_path):
    def member(unit, header, n0):
        lines = ["open_time,open,high,low,close,volume,close_time,quote_volume,count,tb,tq,ignore"] if header else []
        return "\n".join(lines + [f"{(n0 + i) * 60 * unit},1,2,0.5,1.5,10,0,15,3,5,7,0" for i in range(3)])
    for name, unit, header in (("AAA-1m-2020-01", 1000, True), ("BBB-1m-2020-01", 1_000_000, False)):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr(f"{name}.csv", member(unit, header, 26_000_000))
        (tmp_path / f"{name}.zip").write_bytes(buf.getvalue())
    d = readers.load_kline_archive(spark, str(tmp_path / "*.zip"))
    assert sorted({(r.symbol, r.ts) for r in d.collect()}) == [(s, (26_000_000 + i) * 60_000_000) for s in ("AAA", "BBB") for i in range(3)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("AAA-1m-x.csv", member(1000, False, 26_000_002))
    (tmp_path / "AAA-1m-2020-02.zip").write_bytes(buf.getvalue())
    with pytest.raises(Exception, match="duplicate bar"):
        readers.load_kline_archive(spark, str(tmp_path / "*.zip")).collect()


def test_journal_conflict_fails(spark, tmp_path):
    p = tmp_path / "j.jsonl"
    p.write_text('{"id": 1, "v": 2}\n\n{"id": 1, "v": 2}\n{"id": 2, "v"\n{"id": 3, "v": 5}\n')
    assert sorted(r.id for r in readers.read_journal(spark, str(p), "id", "id long, v long").collect()) == [1, 3]
    p.write_text('{"id": 1, "v": 2}\n{"id": 1, "v": 3}\n')
    with pytest.raises(Exception, match="conflicting payloads"):
        readers.read_journal(spark, str(p), "id", "id long, v long").collect()


def test_funding_conflict_and_decimals(frame):
    ok = frame([("A", 1, "0.000100000000000000"), ("A", 1, "0.0001"), ("A", 2, "-0.5")], "symbol string, funding_time long, rate string")
    assert readers.clean_funding(ok, strict=True).count() == 2
    bad = frame([("A", 1, "0.1"), ("A", 1, "0.2")], "symbol string, funding_time long, rate string")
    with pytest.raises(Exception, match="conflicting funding"):
        readers.clean_funding(bad, strict=True).collect()
    got = [r[0] for r in frame([("12.3400",), ("0",), ("-0.50",), ("100",), ("1e-7",)], "x string").select(S.canonical_decimal("x")).collect()]
    assert got == ["12.34", "0.0", "-0.5", "100.0", "0.0000001"]


def test_export_digest_ignores_partitioning(spark, frame, tmp_path):
    d = frame([(i, f"v{i}") for i in range(250)], "id long, v string")
    a = sinks.export_sorted(d.repartition(7), "id", "id", str(tmp_path / "x")).collect()
    b = sinks.content_digest(d.coalesce(1), "id", "id").collect()
    assert a == b and a[0].rows == 250
    assert sinks.content_digest(d.filter("id <> 3"), "id", "id").collect()[0].sha256 != a[0].sha256
    import gzip
    lines = [l for p in sorted((tmp_path / "x").glob("*.gz")) for l in gzip.open(p, "rt")]
    assert [f'"id":{i},' in l for i, l in enumerate(lines)] == [True] * 250


def test_merge_conflict_fails(frame):
    a, b = frame([("A", 0, 1.0)], "symbol string, ts long, close double"), frame([("A", 0, 2.0)], "symbol string, ts long, close double")
    with pytest.raises(Exception, match="unequal overlapping"):
        quality.merge_bars(a, b).collect()
    assert quality.merge_bars(a, a).collect()[0].status == "equal"


def test_zero_volume_and_zero_range(frame):
    d = frame([(0.0, 0.0), (2.0, 3.0), (4.0, 1.0)], "v double, b double")
    assert [r[0] for r in d.select(S.taker_imbalance("v", "b")).collect()] == [0.0, None, -0.5]
    assert [r[0] for r in d.select(S.taker_imbalance("v", "b", None)).collect()] == [None, None, -0.5]
    f = frame([bar(0, 5, 5, 5, 5)], B).withColumns(S.candle_shape()).collect()[0]
    assert (f.clv, f.upper_wick_fraction, f.body_to_range) == (0.5, 0.0, 0.0)


def test_profit_factor_rules(frame):
    d = frame([("w", "A", 1.0, 0.0, 0.0), ("w", "A", 2.0, 0.0, 0.0), ("l", "A", -1.0, 0.0, 0.0)], "g string, symbol string, net double, mae double, mfe double")
    pf = lambda rule: {r.g: r.profit_factor for r in stats.economic_summary(d, "net", ["g"], rule).collect()}
    assert pf("inf_or_zero") == {"w": float("inf"), "l": 0.0} and pf("null") == {"w": None, "l": 0.0} and pf("cap99")["w"] == 99.0 and pf("zero")["w"] == 0.0


def test_drawdown_over_slices(frame):
    xs = [1, -2, 5, -1, -4, 3, -6, 8, -1]
    d = frame([(i * 10, i, float(x)) for i, x in enumerate(xs)], "ts long, id long, x double")
    c = list(itertools.accumulate(xs))
    want = max(max([0] + c[:i + 1]) - c[i] for i in range(len(c)))
    for width in (10, 25, 1000):
        assert stats.max_drawdown(d, "x", ["ts", "id"], slice_width=width).collect()[0].max_drawdown == want


def test_assignment_is_maximum_and_one_to_one(frame):
    edges = [("g", 1, 10), ("g", 1, 11), ("g", 2, 10), ("g", 3, 11), ("g", 3, 12), ("h", 5, 10), ("h", 6, 10)]
    d = frame(edges, "g string, left_id long, right_id long")
    got = {(r.g, r.left_id): r.right_id for r in controls.assign_controls(d, ["g"], strict=False).collect()}
    mine = {k: v for k, v in got.items() if v is not None}
    assert all((g, l, r) in edges for (g, l), r in mine.items())
    assert sum(k[0] == "g" for k in mine) == 3 and len({v for k, v in mine.items() if k[0] == "g"}) == 3 and sum(k[0] == "h" for k in mine) == 1
    with pytest.raises(Exception, match="unmatched left node"):
        controls.assign_controls(d, ["g"]).collect()


def test_tiered_match_against_brute_force(frame):
    pos = [(i, i % 2, i % 3, float(i % 7)) for i in range(6)]
    neg = [(100 + i, i % 2, i % 3, float(i % 5)) for i in range(90)]
    sch = "id long, a int, b int, s double"
    d = controls.tiered_match(frame(pos, sch), frame(neg, sch), [("AB", ["a", "b"]), ("A", ["a"])], "s", limit=20)
    got = {}
    for r in d.collect():
        got.setdefault(r.pos_id, []).append((r["rank"], r.control_id, r.tier))
    for p in pos:
        c = sorted((0 if n[2] == p[2] else 1, abs(n[3] - p[3]), n[0]) for n in neg if n[1] == p[1])[:20]
        assert [x[1:] for x in sorted(got[p[0]])] == [(i, "AB" if t == 0 else "A") for t, _, i in c]


def test_level_clusters_small(frame):
    piv = frame([("A", t * H, t * H, "HIGH", p) for t, p in ((0, 10.0), (3, 10.1), (4, 10.05), (8, 20.0), (12, 20.3))], "symbol string, ts long, available_at long, kind string, price double")
    dec = frame([("A", 20 * H, 1.0, 15.0)], "symbol string, ts long, atr double, price double")
    c = events.level_clusters(piv, dec, 24 * H, 0.5, 3 * H)
    # 10.0 and 10.05 join first (closest), 10.1 is too near in time to join them
    assert sorted((round(r.level, 4), r.touches) for r in c.collect()) == [(10.025, 2), (20.15, 2)]
    n = events.nearest_levels(c).collect()[0]
    assert round(n.below, 4) == 10.025 and round(n.above_atr, 4) == 5.15


def test_crossed_book_fails(frame):
    l2 = frame([("A", 0, True, "bid", 10.0, 1.0), ("A", 0, True, "ask", 11.0, 1.0), ("A", 5, False, "bid", 12.0, 1.0)], "symbol string, ts long, is_snapshot boolean, side string, price double, amount double")
    ok = book.book_as_of(l2, frame([("A", 3)], "symbol string, ts long"), 100).collect()[0]
    assert ok.mid == 10.5 and ok.obi_l1 == 0.0
    with pytest.raises(Exception, match="crossed"):
        book.book_as_of(l2, frame([("A", 6)], "symbol string, ts long"), 100).collect()


def test_book_snapshot_clears_levels(frame):
    rows = [("A", 0, True, "bid", 10.0, 1.0), ("A", 0, True, "ask", 20.0, 1.0), ("A", 2, False, "bid", 15.0, 5.0), ("A", 4, True, "bid", 11.0, 2.0), ("A", 4, True, "ask", 19.0, 2.0), ("A", 6, False, "ask", 19.0, 0.0), ("A", 6, False, "ask", 18.0, 1.0)]
    l2 = frame(rows, "symbol string, ts long, is_snapshot boolean, side string, price double, amount double")
    got = {r.ts: (r.generation, r.best_bid, r.best_ask, r.ask_depletion) for r in book.book_as_of(l2, frame([("A", t) for t in (1, 3, 4, 9)], "symbol string, ts long"), 3).collect()}
    assert got == {1: (1, 10.0, 20.0, 0.0), 3: (1, 15.0, 20.0, 0.0), 4: (2, 11.0, 19.0, 0.0), 9: (2, 11.0, 18.0, 2.0)}


def test_fold_embargo(frame):
    d = frame([(i, i * 10) for i in range(100)], "id long, ts long")
    f = splits.walk_forward(d, 3, 25).groupBy("fold", "part").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    t = {(r.fold, r.part): (r.a, r.b) for r in f}
    for k in range(3):
        assert t[k, "TRAIN"][1] + 25 <= t[k, "VALIDATION"][0] - 10 and t[k, "TRAIN"][1] < t[k, "VALIDATION"][0]
    with pytest.raises(ValueError):
        splits.explicit_folds(d, [(1, 0, 100, 110, 200, 220, 300)], 20)


def test_cross_rank_ties(frame):
    d = frame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 2.0), (1, "d", 3.0), (2, "a", 5.0)], "ts long, symbol string, x double")
    got = {(r.ts, r.symbol): r.m for r in d.select("ts", "symbol", panel.mid_rank("x").alias("m")).collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 0.5, (1, "c"): 0.5, (1, "d"): 1.0, (2, "a"): 0.0}


def test_rolling_rank_counts_finite_values(frame):
    x = [1.0, float("inf"), 3.0, None, 2.0, float("nan"), 5.0]
    d = frame([("A", i, v) for i, v in enumerate(x)], "symbol string, ts long, x double")
    w = Window.partitionBy("symbol").orderBy("ts")
    got = {r.ts: (r.a, r.e) for r in d.select("ts", windows.rolling_rank(w, "x", 4, "inclusive", 2).alias("a"), windows.rolling_rank(w, "x", 4, "exclusive", 1).alias("e")).collect()}
    assert got == {0: (None, None), 1: (None, None), 2: (1.0, 1.0), 3: (None, None), 4: (0.5, 0.5), 5: (None, None), 6: (1.0, 1.0)}


def test_digest_has_one_row_at_any_size(frame):
    d = frame([(i, i % 3) for i in range(40)], "id long, x int")
    rows = sinks.content_digest(d, "id", "id", chunk=2).collect()
    assert len(rows) == 1 and rows[0].rows == 40
    assert sinks.content_digest(d.limit(0), "id", "id", chunk=2).collect()[0].rows == 0


def test_ticks_keep_small_notionals(frame):
    t = frame([("A", i, 0.001 * (i + 1), 1.0, 1, i) for i in range(2)], "symbol string, ts long, price double, qty double, sgn int, event_id long")
    assert abs(resample.ticks_to_bars(t, 1000).collect()[0].volume - 0.003) < 1e-12


def test_regime_match_searches_the_whole_stratum(frame):
    pool = frame([("s", t) for t in range(300)], "g string, ts long")
    ev = frame([(1, "s", 150), (2, "s", 10), (3, "none", 5)], "id long, g string, ts long")
    far = {r.id: r.control_ts for r in controls.regime_matched(ev, pool, ["g"], "id", "x", 140).collect()}
    assert far[1] is not None and abs(far[1] - 150) > 140 and abs(far[2] - 10) > 140 and far[3] is None
    none = {r.id: r.control_ts for r in controls.regime_matched(ev, pool, ["g"], "id", "x", 400).collect()}
    assert none == {1: None, 2: None, 3: None}


def test_step_up_and_step_down_over_slices(spark, monkeypatch):
    """Adjusted p-values of many tests, most of them tied, against the textbook loops; no window spans the family."""
    import random

    from tickloom.operators import stats

    monkeypatch.setattr(stats, "RANKS", 50)
    rng = random.Random(8)
    rows = [(f"t{i:04}", rng.choice([0.0001, 0.001, 0.03, rng.random(), rng.random() ** 3])) for i in range(700)]
    df = spark.createDataFrame(rows, "test string, p double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    n, low, high, ok, bh, holm = len(rows), 1.0, 0.0, True, {}, {}
    for r in range(n, 0, -1):
        t, p = order[r - 1]
        low = min(low, p * n / r)
        bh[t] = low
    for r in range(1, n + 1):
        t, p = order[r - 1]
        high, ok = max(high, min(1.0, (n - r + 1) * p)), ok and p <= 0.05 / (n - r + 1)
        holm[t] = (high, ok)
    accepted = max((r for r in range(1, n + 1) if order[r - 1][1] <= 0.05 * r / n), default=0)
    d = stats.holm(stats.bh(df, "p", "test"), "p", "test")
    assert d.columns == ["test", "p", "accepted", "bh_adjusted", "holm_adjusted", "rejected"]
    got = {r.test: r for r in d.collect()}
    assert len(got) == n and {t for t, r in got.items() if r.accepted} == {t for t, _ in order[:accepted]}
    assert all(abs(got[t].bh_adjusted - bh[t]) < 1e-12 and abs(got[t].holm_adjusted - holm[t][0]) < 1e-12 and got[t].rejected == holm[t][1] for t in got)


def test_radix_selection_keeps_the_smallest_draws(spark):
    from tickloom.operators import stats

    df = spark.range(500).select("id", ((F.col("id") * 37) % 101 - 50.0).alias("net"))
    draws = {(r.rep, r.id): r.h for r in df.crossJoin(spark.range(4).withColumnRenamed("id", "rep")).select("rep", "id", stats.draw("s", F.col("rep").cast("int"), F.col("id")).alias("h")).collect()}
    net = {r.id: r.net for r in df.collect()}
    for bits in (12, 3):  # few bits leave many rows for the last step
        for r in stats.random_coverage(df, 0.3, 4, "s", bits=bits).collect():
            kept = sorted(range(500), key=lambda i: (draws[r.rep, i], i))[:150]
            assert abs(r.net - sum(net[i] for i in kept) / 150) < 1e-9
