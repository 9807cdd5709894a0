"""Order book reconstruction at sample times, book episodes and signal pulses (batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import div, side_sign
from . import intervals, joins, scan
from .quality import fail_if


def _imbalance(b: Column, a: Column) -> Column:
    return F.coalesce(div(b - a, F.nullif(b + a, F.lit(0.0))), F.lit(0.0))


COUNTERS = ("bid_replenishment", "bid_depletion", "ask_replenishment", "ask_depletion")


def _replay(depths: Sequence[int], bands: Sequence[float]):
    """Function of one slice: the books at its sample rows, and a last row (ts NULL) with the slice's counters.

    Rows come with the book that entered the slice (``_i`` -1).  A side's book is an array over the slice's own price ladder,
    best first; the writes between two samples are laid on it at once, a new generation clears it.
    """
    import numpy as np
    import pandas as pd

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", kind="stable")
        s = pdf[pdf["_kind"] == 2]
        si, sg = s["_i"].to_numpy(), s["_g"].to_numpy()
        out = {c: np.zeros(len(s) + 1) for c in COUNTERS}
        books = []
        for side, sign in (("bid", -1.0), ("ask", 1.0)):
            u = pdf[(pdf["_kind"] < 2) & (pdf["side"] == side)]
            g, raw = u["_g"].to_numpy(), u["amount"].to_numpy("float64")
            held = np.where(np.isnan(raw), 0.0, raw)
            ladder, at = np.unique(sign * u["price"].to_numpy("float64"), return_inverse=True)
            o = np.lexsort((at, g))                                     # stable: a level's writes of a generation in order
            before = np.zeros(len(u))
            before[o[1:]] = np.where((g[o[1:]] == g[o[:-1]]) & (at[o[1:]] == at[o[:-1]]), held[o[:-1]], 0.0)
            delta = np.where((u["_kind"] == 1) & (u["_i"] >= 0) & ~np.isnan(raw), raw - before, 0.0)
            pos = np.searchsorted(u["_i"].to_numpy(), si)
            for name, d in (("replenishment", delta.clip(min=0)), ("depletion", (-delta).clip(min=0))):
                out[f"{side}_{name}"] = np.append(np.append(0.0, np.cumsum(d))[pos], d.sum())
            books.append((ladder, at, held, pos, np.searchsorted(g, sg), np.zeros(len(ladder))))
        names = ["best_bid", "best_ask", "_ba", "_aa", *[f"_{x}{k}" for x in "ba" for k in depths], *[f"_{x}d{n}" for x in "ba" for n in range(len(bands))]]
        rows, at_gen, done = [], None, [0, 0]
        for k in range(len(s)):
            fresh = sg[k] != at_gen
            if not fresh and all(done[n] == b[3][k] for n, b in enumerate(books)):
                rows.append(rows[-1])
                continue
            at_gen, live = sg[k], []
            for n, (ladder, at, held, pos, start, book) in enumerate(books):
                if fresh:
                    book[:], done[n] = 0.0, start[k]
                book[at[done[n]:pos[k]]] = held[done[n]:pos[k]]       # of several writes the last stays
                done[n] = pos[k]
                on = np.flatnonzero(book > 0)
                live.append((ladder[on], book[on]))
            (bp, ba), (ap, aa) = live
            bid, ask = -bp[0] if len(bp) else np.nan, ap[0] if len(ap) else np.nan
            mid, deep = (bid + ask) / 2, []
            for (p, x), sign in zip(live, (-1.0, 1.0)):
                deep += [0.0 if np.isnan(mid) else x[:np.searchsorted(p, sign * mid * (1 + sign * d / 10000), "right")].sum() for d in bands]
            rows.append([bid, ask, ba[:1].sum(), aa[:1].sum(), *[x[:d].sum() for x in (ba, aa) for d in depths], *deep])
        e = pd.DataFrame(rows, columns=names, dtype="float64").reindex(range(len(s) + 1))
        head = pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "_slice": pdf["_slice"].iloc[0], "ts": pd.array([*s["ts"], None], "Int64"), "_g": pd.array([*sg, None], "Int64")})
        return pd.concat([head, pd.DataFrame(out), e], axis=1)

    return replay


def book_as_of(l2: DataFrame, times: DataFrame, slice_rows: int = 16_384, depths: Sequence[int] = (1, 5, 10, 20), bands: Sequence[float] = (1, 2, 5), strict: bool = True) -> DataFrame:
    """Book features per (symbol, ts) of ``times``: best levels, mid, microprice, spread, imbalance, depth, counters.

    Updates and samples are put in one order and cut into slices of ``slice_rows`` rows of a symbol.  A slice is summed up as the
    last write of each level; a write is carried to the slices after it as far as the level's next write or the end of its
    generation, so every slice starts from its own book and all are replayed at once.  Carried rows are the live levels
    once per slice: take ``slice_rows`` above the depth of a book.  Rows of one message share (symbol, ts); of several writes
    of a level in one message updates beat snapshot rows, then the largest amount stays.  A NULL amount removes a level without counting; rows
    with another side or no price are left out, and so are samples before the first snapshot or of a book without levels.
    """
    kind = F.when(F.col("is_snapshot"), 0).otherwise(1)
    t = l2.select("symbol", "ts", kind.alias("_kind"), "side", F.col("price").cast("double").alias("price"), F.col("amount").cast("double").alias("amount"))
    t = t.unionByName(times.select("symbol", "ts", F.lit(2).alias("_kind")), allowMissingColumns=True).filter("symbol is not null and ts is not null")
    t = scan.settled(t)                                                 # counted, summed and numbered below
    t = scan.prefix_scan(t, ["symbol"], ["ts", "_kind", "side", "price", "amount"], {"_i": ("count", F.lit(1)), "_g": ("max", F.when(F.col("_kind") == 0, F.col("ts")))}, most=scan.MOST)
    t = scan.settled(t.filter("_g is not null").withColumn("_slice", F.floor(F.col("_i") / slice_rows).cast("long")))
    gens = scan.row_index(t.filter("_kind = 0").select("symbol", F.col("ts").alias("_g")).distinct(), ["symbol"], ["_g"]).select("symbol", "_g", (F.col("_i") + 1).alias("generation"))
    rows = t.filter("_kind = 2 or side in ('bid', 'ask') and price is not null")
    level = ["symbol", "_g", "side", "price"]
    last = rows.filter("_kind < 2").groupBy(*level, "_slice").agg(F.max_by(F.struct("amount"), "_i")["amount"].alias("amount"))
    last = last.withColumn("_next", F.lead("_slice").over(Window.partitionBy(*level).orderBy("_slice"))).filter("amount > 0")
    ends = t.groupBy("symbol", "_g").agg(F.max("_slice").alias("_end"))
    held = last.join(ends, ["symbol", "_g"]).withColumn("_to", F.least("_next", "_end")).filter(F.col("_to") > F.col("_slice"))
    held = held.withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, F.col("_to"))))
    held = held.select("symbol", "_g", "side", "price", "amount", "_slice", F.lit(0).alias("_kind"), F.lit(-1).cast("long").alias("_i"), F.lit(None).cast("long").alias("ts"))
    sums = [*[f"_{x}{k}" for x in "ba" for k in depths], *[f"_{x}d{n}" for x in "ba" for n in range(len(bands))]]
    schema = "symbol string, _slice long, ts long, _g long, " + ", ".join(f"`{c}` double" for c in (*COUNTERS, "best_bid", "best_ask", "_ba", "_aa", *sums))
    b = scan.settled(rows.unionByName(held).groupBy("symbol", "_slice").applyInPandas(_replay(depths, bands), schema))
    w = Window.partitionBy("symbol").orderBy("_slice").rowsBetween(scan.UP, -1)
    past = b.filter("ts is null").select("symbol", "_slice", *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(f"_c_{c}") for c in COUNTERS])
    b = b.filter("ts is not null").join(past, ["symbol", "_slice"]).join(gens, ["symbol", "_g"])
    b = b.select("symbol", "ts", "generation", *[(F.col(c) + F.col(f"_c_{c}")).alias(c) for c in COUNTERS], *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("best_bid", "best_ask")], "_ba", "_aa", *sums)
    b = b.filter("best_bid is not null or best_ask is not null")
    if strict:
        b = fail_if(b, F.col("best_bid").isNull() | F.col("best_ask").isNull() | (F.col("best_bid") >= F.col("best_ask")), "book incomplete or crossed")
    b = b.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    micro = div(F.col("best_ask") * F.col("_ba") + F.col("best_bid") * F.col("_aa"), F.col("_ba") + F.col("_aa"))
    cols = {"spread_bps": (F.col("best_ask") - F.col("best_bid")) / F.col("mid") * 10000, "microprice_minus_mid_bps": (micro / F.col("mid") - 1) * 10000}
    cols |= {f"obi_l{k}": _imbalance(F.col(f"_b{k}"), F.col(f"_a{k}")) for k in depths}
    for n, d in enumerate(bands):
        cols |= {f"bid_depth_{d}bp": F.col(f"_bd{n}"), f"ask_depth_{d}bp": F.col(f"_ad{n}")}
    return b.withColumns(cols).drop("_ba", "_aa", *sums)


def book_episodes(l2: DataFrame, trades: DataFrame, anchors: DataFrame, windows: Sequence[int], large: float, band: float = 5, second: int = 1_000_000, slice_rows: int = 16_384) -> DataFrame:
    """Static, dynamics, flow, response and absorption features per anchor; anchors whose windows cross a snapshot drop."""
    times = anchors.select("symbol", F.explode(F.array(F.col("ts"), *[F.col("ts") - w for w in windows])).alias("ts")).distinct()
    b = scan.settled(book_as_of(l2, times, slice_rows, bands=(1, 2, band)))
    d = anchors.select("symbol", "ts").join(b, ["symbol", "ts"])
    scale = F.greatest(F.col(f"bid_depth_{band}bp") + F.col(f"ask_depth_{band}bp"), F.lit(1e-12))
    names = ("bid_depletion", "ask_depletion", "bid_replenishment", "ask_replenishment")
    for w in windows:
        p = b.select("symbol", (F.col("ts") + w).alias("ts"), *[F.col(c).alias(f"_{c}") for c in ("generation", "mid", "spread_bps", "microprice_minus_mid_bps", "obi_l5", *names)])
        d = d.join(p, ["symbol", "ts"]).filter(F.col("_generation") == F.col("generation"))
        d = scan.settled(d.withColumn("_lo", F.col("ts") - w))
        n = F.col("r_price") * F.col("r_amount")
        f = joins.range_agg(d.select("symbol", "ts", "_lo"), trades.select("symbol", "ts", "price", "amount", "side"), "_lo", "ts", [
            F.sum(F.when(F.col("r_side") == "buy", n).otherwise(0.0)).alias("_buy"), F.sum(F.when(F.col("r_side") == "sell", n).otherwise(0.0)).alias("_sell"), F.count(F.lit(1)).alias("_cnt"), F.avg((n >= large).cast("double")).alias("_lg")], "(]", w, ["symbol", "ts"])
        d = d.join(f.drop("_lo").na.fill({"_buy": 0.0, "_sell": 0.0, "_cnt": 0, "_lg": 0.0}), ["symbol", "ts"])
        sec, t = w / second, f"_{w // second}s"
        tot, dl = F.col("_buy") + F.col("_sell"), F.col("_buy") - F.col("_sell")
        d = d.withColumns({f"{c}{t}": (F.col(c) - F.col(f"_{c}")) / scale for c in names})
        ret = (F.col("mid") / F.col("_mid") - 1) * 10000
        norm = dl / F.greatest(tot, F.lit(1.0))
        share = lambda c: F.coalesce(div(F.col(c), F.nullif(tot, F.lit(0.0))), F.lit(0.0))
        d = d.withColumns({
            f"spread_change{t}": F.col("spread_bps") - F.col("_spread_bps"), f"microprice_velocity{t}": (F.col("microprice_minus_mid_bps") - F.col("_microprice_minus_mid_bps")) / sec, f"obi_change{t}": F.col("obi_l5") - F.col("_obi_l5"),
            f"delta_ratio{t}": _imbalance(F.col("_buy"), F.col("_sell")), f"trade_rate{t}": F.col("_cnt") / sec, f"mean_notional{t}": F.coalesce(div(tot, F.nullif("_cnt", F.lit(0))), F.lit(0.0)), f"large_fraction{t}": F.col("_lg"),
            f"price_return{t}": ret, f"flow_response{t}": norm * ret, f"impact{t}": ret / F.greatest(F.abs(dl) / 10000, F.lit(1.0)), f"flow_without_response{t}": F.abs(norm) / (F.abs(ret) + 0.1),
            f"sell_absorbed{t}": share("_sell") * F.col(f"bid_replenishment{t}") / (F.greatest(-ret, F.lit(0.0)) + 1), f"buy_absorbed{t}": share("_buy") * F.col(f"ask_replenishment{t}") / (F.greatest(ret, F.lit(0.0)) + 1)})
        d = d.drop(*[c for c in d.columns if c.startswith("_")])
    return d


def pulse(signals: DataFrame, events: DataFrame, horizons: Sequence[int], barrier_bps: float, bucket: int, key: str = "signal_id") -> DataFrame:
    """Return, MFE, MAE, signed flow and first barrier per signal and horizon; ``events(symbol, ts, mid, signed)``.

    Intervals of the longest horizon visit their time buckets; no pairs of signals and events are formed.
    """
    s = signals.select(key, "symbol", "side", "reference_mid", F.col("ts").alias("_t0"), (F.col("ts") + max(horizons)).alias("_t1"))
    j = intervals.crossings(s, events.select("symbol", "ts", "mid", "signed"), horizons, barrier_bps, bucket, [key, "side", "reference_mid"])
    bps = lambda c: side_sign() * (F.col(c) / F.col("reference_mid") - 1) * 10000
    long = side_sign() > 0
    g = j.groupBy(key, "horizon").agg(F.max_by(bps("_last"), "_at").alias("ret_bps"), F.max(F.greatest(bps("_hi"), bps("_lo"))).alias("mfe_bps"), (-F.min(F.least(bps("_hi"), bps("_lo")))).alias("mae_bps"),
                                      (F.max(side_sign()) * F.sum("_sum")).alias("signed_flow"), F.min(F.when(long, F.col("_up")).otherwise(F.col("_down"))).alias("_f"), F.min(F.when(long, F.col("_down")).otherwise(F.col("_up"))).alias("_a"))
    out = F.when(F.col("_f").isNull() & F.col("_a").isNull(), "NEITHER").when(F.coalesce(F.col("_f") < F.col("_a"), F.col("_f").isNotNull()), "FAVORABLE_FIRST").otherwise("ADVERSE_FIRST")
    return g.withColumn("barrier", out).drop("_f", "_a")


def signal_clusters(signals: DataFrame, gap: int, key: str = "signal_id") -> DataFrame:
    """Cluster number per symbol; a signal more than ``gap`` after the one before starts a new one."""
    d = scan.framed(signals, ["symbol"], ["ts", key], lambda w: {"_new": F.when(F.col("ts") - F.lag("ts", 1).over(w) <= gap, 0).otherwise(1)}, back=1)
    return scan.prefix_scan(d, ["symbol"], ["ts", key], {"cluster": ("sum", "_new")}).withColumn("cluster", F.col("cluster").cast("long")).drop("_new")


def expire(snapshots: DataFrame, outcomes: DataFrame, experts: DataFrame, drift_run: int = 3, last: int = 12, floor: float = -2.0) -> DataFrame:
    """First expiry per expert: edge decay, then regime drift, then time to live; permanent.

    ``experts(expert, created_ts, expires_ts, threshold)``, ``snapshots(expert, ts, similarity)``,
    ``outcomes(expert, ts, net)``; an evaluation happens at every snapshot and sees outcomes
    resolved by then.
    """
    from . import windows as W

    o = outcomes.join(experts.select("expert", "created_ts"), "expert").filter(F.col("ts") > F.col("created_ts")).select("expert", "ts", "net", "tie")
    o = scan.framed(scan.indexed(o, ["expert"], ["ts", "tie"]), ["expert"], ["ts", "tie"], lambda w: {"mean_last": F.avg("net").over(scan.k_rows(w, last))}, back=last)
    o = o.withColumn("decayed", (F.col("_i") >= last - 1) & (F.col("mean_last") < floor)).select("expert", "ts", "decayed", "_i")
    s = snapshots.join(experts, "expert").filter(F.col("ts") >= F.col("created_ts")).withColumn("low", F.col("similarity") < F.col("threshold"))
    s = W.run_length(s, F.col("low"), by=["expert"], out="_run")
    s = joins.asof_join(s, o, by=["expert"], columns=["decayed"], right_tie="_i")
    hit = F.when(F.coalesce("decayed", F.lit(False)), "EDGE_DECAY").when(F.col("low") & (F.col("_run") >= drift_run), "REGIME_DRIFT").when(F.col("ts") >= F.col("expires_ts"), "TTL")
    s = s.withColumn("reason", hit)
    return s.groupBy("expert").agg(F.min(F.when(F.col("reason").isNotNull(), F.col("ts"))).alias("expired_at"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("ts"))).alias("reason"))
