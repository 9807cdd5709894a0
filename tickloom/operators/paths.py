"""Forward price paths and the labels made from them.

A path is ``array<struct<ts,o,h,l,c,v,b>>`` of the bars after an event, with
``entry`` (next open) and ``side``.  Excursions are fractions of the entry; a bar
that reaches both barriers counts as adverse unless a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip, div, flag, side_sign
from . import scan

def bar_struct() -> Column:
    return F.struct("ts", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                    F.col("volume").alias("v"), F.col("buy_volume").alias("b"))


# --- attaching paths ------------------------------------------------------------------------------

def forward_path(bars: DataFrame, step: int, horizon: int, strict: bool = True, **kw) -> DataFrame:
    """Every bar with the next ``horizon`` bars as an array; short or gapped paths drop (or get a reason)."""
    d = scan.framed(bars, ["symbol"], ["ts"], lambda w: {
        "path": F.collect_list(bar_struct()).over(w.rowsBetween(1, horizon))}, ahead=horizon, **kw)
    n = F.size("path")
    last = F.get("path", n - 1)["ts"]
    reason = F.when(n < horizon, "INCOMPLETE_HORIZON").when(last != F.col("ts") + horizon * step, "FUTURE_GAP")
    d = d.withColumns({"quarantine_reason": reason, "entry": F.get("path", F.lit(0))["o"]})
    return d.filter("quarantine_reason is null").drop("quarantine_reason") if strict else d


def path_at(events: DataFrame, bars: DataFrame, start: str, step: int, horizon: int, key: Sequence[str]) -> DataFrame:
    """Paths for events off the bar grid: the wanted bar times are enumerated and joined by equality.

    ``start`` is the first bar's time.  Events without all bars drop.
    """
    want = events.select(*dict.fromkeys([*key, "symbol"]), F.posexplode(F.sequence(F.col(start), F.col(start) + (horizon - 1) * step, F.lit(step))).alias("_p", "ts"))
    got = want.join(bars.select("symbol", "ts", bar_struct().alias("_b")), ["symbol", "ts"]).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_b"))), lambda x: x["_b"]).alias("path"))
    got = got.filter(F.size("path") == horizon).withColumn("entry", F.get("path", F.lit(0))["o"])
    return events.join(got, list(key))


# --- array helpers ----------------------------------------------------------------------------------

def fav(side="side", entry="entry", path="path") -> Column:
    e = F.col(entry)
    return F.when(F.col(side) == "LONG", F.transform(path, lambda x: x["h"] / e - 1)).otherwise(F.transform(path, lambda x: 1 - x["l"] / e))


def adv(side="side", entry="entry", path="path") -> Column:
    e = F.col(entry)
    return F.when(F.col(side) == "LONG", F.transform(path, lambda x: 1 - x["l"] / e)).otherwise(F.transform(path, lambda x: x["h"] / e - 1))


def closes(side="side", entry="entry", path="path") -> Column:
    """Side-oriented close returns."""
    e, s = F.col(entry), side_sign(side)
    return F.transform(path, lambda x: s * (x["c"] / e - 1))


def first_hit(arr, level) -> Column:
    """1-based position of the first element >= level, else NULL."""
    lv = level if isinstance(level, Column) else F.lit(level)
    return F.nullif(F.array_position(F.transform(arr, lambda x: x >= lv), F.lit(True)), F.lit(0).cast("long"))


def total(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def with_excursions(df: DataFrame) -> DataFrame:
    """Arrays ``_f`` (favourable), ``_a`` (adverse), ``_r`` (close return), computed once."""
    return df.withColumns({"_f": fav(), "_a": adv(), "_r": closes()})


def clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# --- excursions and barriers ---------------------------------------------------------------------------

def excursions(df: DataFrame, floor: bool = False) -> DataFrame:
    d = with_excursions(df)
    lo = (lambda e: F.greatest(F.lit(0.0), e)) if floor else (lambda e: e)
    mf, ma = F.array_max("_f"), F.array_max("_a")
    d = d.withColumns({"mfe": lo(mf), "mae": lo(ma), "time_to_mfe": F.array_position("_f", mf), "time_to_mae": F.array_position("_a", ma)})
    return clean(d.withColumn("mfe_before_mae", F.col("time_to_mfe") < F.col("time_to_mae")))


def with_barriers(df: DataFrame, fav_level, adv_level, cost, arrays=("_f", "_a", "_r"), prefix: str = "") -> DataFrame:
    """Adverse-first triple barrier over excursion arrays; the arrays are searched once each."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    f, a = F.col("_bf"), F.col("_ba")
    out, term = F.col(prefix + "outcome"), F.col(prefix + "terminal")
    d = df.withColumns({"_bf": first_hit(arrays[0], fav_level), "_ba": first_hit(arrays[1], adv_level), prefix + "terminal": F.element_at(F.col(arrays[2]), -1)})
    d = d.withColumns({prefix + "event_bar": F.least(f, a), prefix + "outcome": F.when(a.isNotNull() & (f.isNull() | (a <= f)), "ADVERSE_FIRST_OR_SAME").when(
        f.isNotNull(), "FAVORABLE_FIRST").otherwise("NEITHER_REACHED")})
    return d.withColumn(prefix + "utility", F.when(out == "ADVERSE_FIRST_OR_SAME", -lit(adv_level)).when(out == "FAVORABLE_FIRST", lit(fav_level)).otherwise(term) - lit(cost)).drop("_bf", "_ba")


def triple_barrier(df: DataFrame, fav_level: float, adv_level: float, cost: float) -> DataFrame:
    return clean(with_barriers(with_excursions(df), fav_level, adv_level, cost))


def label_paths(df: DataFrame, keys: Sequence[str], horizon: int, fav_level: float, adv_level: float, cost: float) -> DataFrame:
    """Excursions and the adverse-first barrier for long paths, vectorised over Arrow batches.

    Same results as ``excursions`` plus ``triple_barrier``.  Higher-order functions are
    interpreted per element; for long paths whole batches of paths as matrices are
    several times faster.  Paths must all have ``horizon`` bars (see ``forward_path``).
    """
    import numpy as np
    import pyarrow as pa

    d = df.select(*keys, F.col("entry").cast("double").alias("_e"), side_sign().alias("_s"), F.col("path.h").alias("_h"), F.col("path.l").alias("_l"), F.element_at("path", -1)["c"].alias("_c"))
    types = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}
    keys = list(keys)

    def run(batches):
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            col = lambda name: b.column(b.schema.get_field_index(name))
            flat = lambda name: col(name).flatten().to_numpy(zero_copy_only=False).reshape(n, horizon)
            e, s, c = (col(x).to_numpy(zero_copy_only=False) for x in ("_e", "_s", "_c"))
            long = s > 0
            up, dn = flat("_h") / e[:, None] - 1, 1 - flat("_l") / e[:, None]
            f, a = np.where(long[:, None], up, dn), np.where(long[:, None], dn, up)
            tm, ta, row = f.argmax(1), a.argmax(1), np.arange(n)
            hf, ha = f >= fav_level, a >= adv_level
            never = horizon + 1
            kf, ka = np.where(hf.any(1), hf.argmax(1) + 1, never), np.where(ha.any(1), ha.argmax(1) + 1, never)
            bad, good = (ka < never) & (ka <= kf), (kf < never) & (kf < ka)
            term = s * (c / e - 1)
            util = np.where(bad, -adv_level, np.where(good, fav_level, term)) - cost
            out = np.where(bad, "ADVERSE_FIRST_OR_SAME", np.where(good, "FAVORABLE_FIRST", "NEITHER_REACHED"))
            ev = np.minimum(kf, ka)
            yield pa.RecordBatch.from_arrays(
                [col(k) for k in keys] + [pa.array(x) for x in (f[row, tm], a[row, ta], (tm + 1).astype("int64"), (ta + 1).astype("int64"))]
                + [pa.array(tm < ta), pa.array(out), pa.array(ev.astype("int64"), mask=ev == never), pa.array(term), pa.array(util)],
                names=keys + ["mfe", "mae", "time_to_mfe", "time_to_mae", "mfe_before_mae", "outcome", "event_bar", "terminal", "utility"])

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["mfe double, mae double, time_to_mfe long, time_to_mae long, mfe_before_mae boolean, outcome string, event_bar long, terminal double, utility double"])
    return d.mapInArrow(run, schema)


def contract_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows x (horizon, fav, adv) contracts; the grid is a short parameter table."""
    return df.crossJoin(F.broadcast(grid))


def triple_barrier_grid(df: DataFrame, grid: DataFrame, cost: float) -> DataFrame:
    """Every contract of ``grid(contract, horizon, fav, adv)`` on the same path arrays."""
    d = contract_grid(with_excursions(df), grid)
    d = d.withColumns({c: F.slice(c, F.lit(1), F.col("horizon")) for c in ("_f", "_a", "_r")})
    return clean(with_barriers(d, F.col("fav"), F.col("adv"), cost))


def barrier_ambiguous(df: DataFrame, fav_level: float, adv_level: float, cost: float) -> DataFrame:
    """Same barriers with an explicit class for a bar that reaches both."""
    d = with_excursions(df).withColumns({"_hf": first_hit("_f", fav_level), "_ha": first_hit("_a", adv_level)})
    out = F.when(F.col("_hf").isNull() & F.col("_ha").isNull(), "NEITHER_REACHED").when(
        F.col("_hf") == F.col("_ha"), "SAME_BAR_AMBIGUOUS").when(
        F.coalesce(F.col("_hf") < F.col("_ha"), F.col("_hf").isNotNull()), "FAVORABLE_FIRST").otherwise("ADVERSE_FIRST")
    d = d.withColumns({"outcome": out, "event_bar": F.least("_hf", "_ha"), "terminal": F.element_at("_r", -1)})
    u = F.when(F.col("outcome") == "FAVORABLE_FIRST", F.lit(fav_level - cost)).when(F.col("outcome") == "NEITHER_REACHED", F.col("terminal") - cost).otherwise(-adv_level - cost)
    return clean(d.withColumn("utility", u))


def first_passage(df: DataFrame, fav_levels: Sequence[float], adv_levels: Sequence[float]) -> DataFrame:
    """First bar of every level and who is first for each pair of levels (adverse wins ties)."""
    d = with_excursions(df)
    lv = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    hits = lambda arr, xs: F.transform(lv(xs), lambda q: F.struct(q.alias("level"), first_hit(arr, q).alias("bar")))
    d = d.withColumn("_fh", hits("_f", fav_levels)).withColumn("_ah", hits("_a", adv_levels))
    d = d.withColumn("_x", F.explode("_fh")).withColumn("_y", F.explode("_ah"))
    f, a = F.col("_x.bar"), F.col("_y.bar")
    who = F.when(f.isNull() & a.isNull(), "NONE").when(a.isNotNull() & (f.isNull() | (a <= f)), "ADVERSE").otherwise("FAVORABLE")
    return clean(d.withColumns({"fav_level": F.col("_x.level"), "adv_level": F.col("_y.level"), "fav_bar": f, "adv_bar": a, "first": who}))


def mid_barrier(quotes: DataFrame, anchors: DataFrame, latency: int, bps: float, horizon: int, key: str = "signal_id") -> DataFrame:
    """UP_FIRST / DOWN_FIRST / NEITHER on quote mids from anchor + latency; MISSING without a quote."""
    from . import joins

    a = anchors.select(key, "symbol", (F.col("ts") + latency).alias("ts"))
    ref = joins.asof_join(a, quotes.select("symbol", "ts", "mid"), by=["symbol"], columns=["mid"])
    ref = ref.withColumns({"_lo": F.col("ts"), "_hi": F.col("ts") + horizon})
    hits = joins.interval_join(ref.filter("mid is not null").withColumnRenamed("mid", "ref"), quotes.select("symbol", "ts", "mid"), "_lo", "_hi", "(]", horizon)
    up, dn = F.col("ref") * (1 + bps / 10000), F.col("ref") * (1 - bps / 10000)
    g = hits.groupBy(key).agg(F.min(F.when(F.col("r_mid") >= up, F.col("r_ts"))).alias("_u"), F.min(F.when(F.col("r_mid") <= dn, F.col("r_ts"))).alias("_d"),
                              F.max_by("r_mid", "r_ts").alias("_t"), F.max("r_mid").alias("_mx"), F.min("r_mid").alias("_mn"))
    j = ref.join(g, key, "left")
    out = F.when(F.col("mid").isNull(), "MISSING").when(F.col("_u").isNull() & F.col("_d").isNull(), "NEITHER").when(
        F.coalesce(F.col("_u") < F.col("_d"), F.col("_u").isNotNull()), "UP_FIRST").otherwise("DOWN_FIRST")
    move = lambda c: (div(c, "mid") - 1) * 10000
    return j.select(key, "symbol", out.alias("outcome"), move("_t").alias("terminal_bps"), move("_mx").alias("mfe_bps"), (-move("_mn")).alias("mae_bps"))


# --- labels ------------------------------------------------------------------------------------------------

def path_labels(df: DataFrame, horizon: int, cost: float, *, clean_mfe: float, clean_mae: float, clean_ratio: float, clean_time: float,
                initial3: float, bad_mae: float, bad_mfe: float, bad_initial3: float, low_mae: float, tail_mae: float) -> DataFrame:
    """Clean, bad and tail flags; rows with ``quarantine_reason`` stay with NULL labels."""
    d = df.withColumns({"_f": F.transform(fav(), lambda x: F.greatest(F.lit(0.0), x)), "_a": F.transform(adv(), lambda x: F.greatest(F.lit(0.0), x))})
    d = d.withColumns({"mfe": F.array_max("_f"), "mae": F.array_max("_a"), "_i3": F.array_max(F.slice("_a", 1, 3))})
    d = d.withColumns({"time_to_mfe": F.when(F.col("mfe") > 0, F.array_position("_f", F.col("mfe"))),
                       "time_to_mae": F.when(F.col("mae") > 0, F.array_position("_a", F.col("mae"))),
                       "ratio": F.when(F.col("mae") > 0, div("mfe", "mae")).when(F.col("mfe") > 0, float("inf")).otherwise(0.0),
                       "net_quality": F.col("mfe") - F.col("mae") - cost, "_hf": first_hit("_f", clean_mfe), "_ha": first_hit("_a", bad_mae)})
    d = d.withColumns({"mfe_before_mae": F.coalesce(F.col("time_to_mfe").isNotNull() & (F.col("time_to_mae").isNull() | (F.col("time_to_mfe") < F.col("time_to_mae"))), F.lit(False)),
                       "ambiguous": F.coalesce(F.col("_hf") == F.col("_ha"), F.lit(False))})
    ok = F.col("quarantine_reason").isNull() if "quarantine_reason" in df.columns else F.lit(True)
    c = (~F.col("ambiguous") & F.col("mfe_before_mae") & (F.col("mfe") >= clean_mfe) & (F.col("mae") <= clean_mae) & (F.col("ratio") >= clean_ratio)
         & (F.col("time_to_mfe") <= horizon * clean_time) & (F.col("net_quality") > 0) & (F.col("_i3") <= initial3))
    adverse_lead = F.col("time_to_mae").isNotNull() & (F.col("time_to_mfe").isNull() | (F.col("time_to_mae") <= F.col("time_to_mfe")))
    b = ((adverse_lead & (F.col("mae") >= bad_mae)) | ((F.col("mfe") < bad_mfe) & (F.col("mae") >= low_mae)) | (F.col("_i3") >= bad_initial3)
         | (F.col("net_quality") < 0) | ((F.col("ratio") < 1) & (F.col("mae") >= low_mae)) | F.col("ambiguous"))
    stop = F.col("_ha").isNotNull() & (F.col("_hf").isNull() | (F.col("_ha") <= F.col("_hf")))
    gate = lambda e: F.when(ok, F.coalesce(e, F.lit(False)))
    return clean(d.withColumns({"clean_entry": gate(c), "bad_entry": gate(b), "tail_event": gate(F.col("mae") >= tail_mae),
                                "stopped_before_hit": gate(stop), "hit_before_stop": gate(F.col("_hf").isNotNull() & ~stop)}))


def clean_diagnostics(df: DataFrame, adv_level: float, max_share: float, max_bar: int, cost: float) -> DataFrame:
    """After ``barrier_ambiguous``: worst adverse move up to the event bar and a clean flag."""
    d = with_excursions(df).withColumn("_n", F.coalesce("event_bar", F.size("path").cast("long")))
    d = d.withColumns({"observed_bars": F.col("_n"), "pre_event_mae": F.greatest(F.lit(0.0), F.array_max(F.slice("_a", F.lit(1), F.col("_n").cast("int")))),
                       "first_positive_bar": first_hit(F.transform("_r", lambda x: F.when(x > cost, 1.0).otherwise(0.0)), 1.0),
                       "max_favorable": F.greatest(F.lit(0.0), F.array_max("_f"))})
    ok = (F.col("outcome") == "FAVORABLE_FIRST") & (F.col("event_bar") <= max_bar) & (F.col("pre_event_mae") <= adv_level * max_share)
    return clean(d.withColumns({"mae_share_of_barrier": F.col("pre_event_mae") / adv_level, "clean_entry": F.coalesce(ok, F.lit(False))}))


def fixed_horizon(df: DataFrame, bars: DataFrame, funding: DataFrame, step: int, horizon: int, costs: dict[str, float]) -> DataFrame:
    """Entry at the next open, exit at the open ``horizon`` bars later, funding in [entry, exit)."""
    from . import joins

    o = bars.select("symbol", F.col("ts").alias("exit_ts"), F.col("open").alias("exit_price"))
    d = df.withColumn("entry_ts", F.col("ts") + step).withColumn("exit_ts", F.col("ts") + (1 + horizon) * step).join(o, ["symbol", "exit_ts"])
    d = joins.range_sum(d, funding, "entry_ts", "exit_ts", {"funding": "rate", "funding_events": F.lit(1.0)}, closed="[)")
    d = d.withColumn("gross", side_sign() * (F.col("exit_price") / F.col("entry") - 1))
    d = with_excursions(d).withColumns({"mfe": F.greatest(F.lit(0.0), F.array_max("_f")), "mae": F.greatest(F.lit(0.0), F.array_max("_a")),
                                        "first_positive_bar": first_hit(F.transform("_r", lambda x: F.when(x > 0, 1.0).otherwise(0.0)), 1.0)})
    paid = side_sign() * F.col("funding")
    return clean(d.withColumns({f"net_{n}": F.col("gross") - c - paid for n, c in costs.items()}))


def next_open_outcome(bars: DataFrame, step: int, horizon: int, fee_bps: float, slip_bps: float, funding_hour_bps: float, **kw) -> DataFrame:
    """Per bar: entry at the next open, exit at the close of bar H, both sides; plain min/max frames, no arrays."""
    fr = lambda w: w.rowsBetween(1, horizon)
    d = scan.framed(bars, ["symbol"], ["ts"], lambda w: {
        "entry": F.lead("open", 1).over(w), "exit": F.lead("close", horizon).over(w), "_last": F.lead("ts", horizon).over(w),
        "_hi": F.max("high").over(fr(w)), "_lo": F.min("low").over(fr(w))}, ahead=horizon, **kw)
    d = d.filter(F.col("_last") == F.col("ts") + horizon * step).withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    long = F.col("side") == "LONG"
    hours = horizon * step / 3_600_000_000
    cost = 2 * (fee_bps + slip_bps) / 10000 + funding_hour_bps / 10000 * hours
    up, dn = div("_hi", "entry") - 1, 1 - div("_lo", "entry")
    d = d.withColumns({"gross": side_sign() * (div("exit", "entry") - 1), "mfe": F.greatest(F.lit(0.0), F.when(long, up).otherwise(dn)), "mae": F.greatest(F.lit(0.0), F.when(long, dn).otherwise(up))})
    return d.withColumn("net", F.col("gross") - cost).drop("_last", "_hi", "_lo")


def forward_returns(bars: DataFrame, horizons: Sequence[int], threshold_bps: float, **kw) -> DataFrame:
    d = scan.framed(bars, ["symbol"], ["ts"], lambda w: {
        "entry": F.lead("open", 1).over(w), **{f"gross_{h}": (div(F.lead("close", h).over(w), F.lead("open", 1).over(w)) - 1) * 10000 for h in horizons}},
        ahead=max(horizons), **kw)
    return d.withColumns({f"opportunity_{h}": F.abs(f"gross_{h}") >= threshold_bps for h in horizons})


def hard_negative(df: DataFrame, mae_cut: float, mfe_cut: float, late: int) -> DataFrame:
    """Ordered class of a losing entry; needs mfe, mae, terminal, time_to_mfe, time_to_mae."""
    c = F.when(F.col("terminal") > 0, F.lit(None).cast("string")).when((F.col("mae") >= mae_cut) & (F.col("mfe") < mfe_cut), "FALLING_KNIFE").when(
        (F.col("mfe") >= mfe_cut) & (F.col("time_to_mfe") < F.col("time_to_mae")), "FALSE_BREAKOUT").when(
        (F.col("mfe") >= mfe_cut) & (F.col("time_to_mfe") >= late), "LATE_RECOVERY").when(
        (F.col("mfe") < mfe_cut) & (F.col("mae") < mae_cut), "NO_RESOLUTION").otherwise("WRONG_DIRECTION")
    return df.withColumn("hard_negative", c)


def pair_sides(long: DataFrame, short: DataFrame, features: Sequence[str]) -> DataFrame:
    """LONG and SHORT label sets by (ts, symbol); a missing key or differing feature fails."""
    from .quality import fail_if

    l = long.select("symbol", "ts", *[F.col(c).alias(f"l_{c}") for c in (*features, "terminal", "mfe")])
    s = short.select("symbol", "ts", *[F.col(c).alias(f"s_{c}") for c in (*features, "terminal", "mfe")])
    j = l.join(s, ["symbol", "ts"], "full_outer")
    bad = F.col("l_terminal").isNull() | F.col("s_terminal").isNull()
    for c in features:
        bad = bad | ~F.col(f"l_{c}").eqNullSafe(F.col(f"s_{c}"))
    j = fail_if(j, bad, "side label sets differ")
    row = lambda side, p: F.struct(F.lit(side).alias("side"), F.col(f"{p}_terminal").alias("terminal"), F.col(f"{p}_mfe").alias("mfe"), *[F.col(f"{p}_{c}").alias(c) for c in features])
    return j.select("symbol", "ts", F.explode(F.array(row("LONG", "l"), row("SHORT", "s"))).alias("r")).select("symbol", "ts", "r.*")


def opportunity_magnitude(df: DataFrame, cost: float) -> DataFrame:
    """max(up, down) excursion of a path and the economics of each side (needs entry, path)."""
    e = F.col("entry")
    d = df.withColumns({"up": F.greatest(F.lit(0.0), F.array_max(F.transform("path", lambda x: x["h"])) / e - 1), "down": F.greatest(F.lit(0.0), 1 - F.array_min(F.transform("path", lambda x: x["l"])) / e),
                        "terminal": F.element_at("path", -1)["c"] / e - 1})
    return d.withColumns({"magnitude": F.greatest("up", "down"), "long_net": F.col("terminal") - cost, "short_net": -F.col("terminal") - cost})


def joint_state(df: DataFrame, by=("symbol", "ts")) -> DataFrame:
    """Five-way state from outcome, agreed direction (exactly one favourable side) and the clean flag."""
    w = Window.partitionBy(*by)
    won = lambda s: F.max(F.when(F.col("side") == s, F.col("outcome") == "FAVORABLE_FIRST")).over(w)
    d = df.withColumn("direction", F.when(won("LONG") == won("SHORT"), "ABSTAIN").when(won("LONG"), "LONG").otherwise("SHORT"))
    st = F.when(F.col("outcome") == "ADVERSE_FIRST", "ADVERSE_FIRST").when(F.col("outcome") == "SAME_BAR_AMBIGUOUS", "SAME_BAR_AMBIGUOUS").when(
        (F.col("outcome") == "FAVORABLE_FIRST") & (F.col("direction") == F.col("side")),
        F.when(F.col("clean_entry"), "COHERENT_CLEAN_FAVORABLE").otherwise("COHERENT_DIRTY_FAVORABLE")).otherwise("UNRESOLVED_OR_DIRECTION_MISMATCH")
    return d.withColumn("state", st)


def labelled(conds: dict[str, Column]) -> Column:
    """Names of the true conditions, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conds.items()]))


def symmetric_label(df: DataFrame, f: float, a: float, cost: float, min_utility: float, min_advantage: float) -> DataFrame:
    """Barrier utility of both sides on one path; LONG, SHORT or SKIP (needs entry, path)."""
    d = df.withColumns({"_up": fav_of("LONG"), "_dn": fav_of("SHORT"), "_c": F.transform("path", lambda x: x["c"] / F.col("entry") - 1)})
    d = d.withColumn("_s", F.transform("_c", lambda x: -x))
    d = with_barriers(with_barriers(d, f, a, cost, ("_up", "_dn", "_c"), "long_"), f, a, cost, ("_dn", "_up", "_s"), "short_")
    d = d.withColumn("advantage", F.col("long_utility") - F.col("short_utility"))
    best = F.greatest("long_utility", "short_utility")
    lab = F.when((best >= min_utility) & (F.abs("advantage") >= min_advantage), F.when(F.col("long_utility") >= F.col("short_utility"), "LONG").otherwise("SHORT")).otherwise("SKIP")
    return clean(d.withColumn("economic_label", lab))


def fav_of(side: str) -> Column:
    e = F.col("entry")
    return F.transform("path", (lambda x: x["h"] / e - 1) if side == "LONG" else (lambda x: 1 - x["l"] / e))


def expected_utility(df: DataFrame, f: float, a: float, cost: float, unknown_penalty: float, clean_bonus: float = 0.0) -> DataFrame:
    """From p_favorable, p_adverse, p_ambiguous, p_neither, p_clean with its attributed parts."""
    d = df.withColumns({"u_favorable": F.col("p_favorable") * f, "u_adverse": -F.col("p_adverse") * a, "u_ambiguous": -F.col("p_ambiguous") * unknown_penalty * a,
                        "u_unresolved": -F.col("p_neither") * unknown_penalty * a, "u_clean": F.col("p_clean") * clean_bonus})
    return d.withColumn("utility", F.col("u_favorable") + F.col("u_adverse") + F.col("u_ambiguous") + F.col("u_unresolved") + F.col("u_clean") - cost)


def path_lengths(df: DataFrame) -> DataFrame:
    """``path_length``, ``efficiency`` and ``directional_persistence`` over entry and closes."""
    cs = F.transform("path", lambda x: x["c"])
    prev = F.concat(F.array(F.col("entry")), F.slice(cs, F.lit(1), F.size(cs) - 1))
    d = df.withColumn("path_length", total(F.zip_with(cs, prev, lambda a, b: F.abs(a - b))))
    move = F.element_at("path", -1)["c"] - F.col("entry")
    return d.withColumns({"efficiency": F.coalesce(div(F.abs(move), F.nullif("path_length", F.lit(0.0))), F.lit(0.0)),
                          "directional_persistence": F.coalesce(div(side_sign() * move, F.nullif("path_length", F.lit(0.0))), F.lit(0.0))})


def pre_mfe_adverse(d: DataFrame) -> Column:
    """Worst adverse excursion up to and including the best bar."""
    return F.array_max(F.slice("_a", F.lit(1), F.array_position("_f", F.array_max("_f")).cast("int")))


def path_quality(df: DataFrame, f: float, a: float, cost: float, min_ratio: float, min_eff: float) -> DataFrame:
    """GOOD, NEUTRAL or BAD wave measured up to the exit bar of the barriers."""
    d = with_barriers(with_excursions(df), f, a, cost)
    n = F.coalesce("event_bar", F.size("path").cast("long")).cast("int")
    d = d.withColumn("_n", n).withColumns({c: F.slice(c, F.lit(1), F.col("_n")) for c in ("_f", "_a", "_r")})
    steps = F.zip_with("_r", F.concat(F.array(F.lit(0.0)), F.slice("_r", F.lit(1), F.col("_n") - 1)), lambda x, y: F.abs(x - y))
    d = d.withColumns({"mfe": F.array_max("_f"), "mae": F.array_max("_a"), "path_efficiency": F.abs(F.element_at("_r", -1)) / F.greatest(total(steps), F.lit(1e-12)),
                       "exit_bar": F.col("_n"), "pre_mfe_adverse": pre_mfe_adverse(d)})
    ratio = F.col("mfe") / F.greatest(F.col("mae"), F.lit(1e-9))
    lab = F.when((F.col("outcome") == "FAVORABLE_FIRST") & (F.col("utility") > 0) & (F.col("mae") <= a) & (ratio >= min_ratio) & (F.col("path_efficiency") >= min_eff), "GOOD_WAVE").when(
        (F.col("outcome") == "ADVERSE_FIRST_OR_SAME") | (F.col("utility") <= -cost), "BAD_WAVE").otherwise("NEUTRAL_WAVE")
    return clean(d.withColumns({"mfe_mae_ratio": ratio, "wave_label": lab}))


def teacher_labels(df: DataFrame, horizon: int, c: dict) -> DataFrame:
    """Five votes (A-E), their consensus forms and a 0-100 quality score; amounts in basis points.

    ``c`` holds the thresholds by name, see ``TEACHER_DEFAULTS``.
    """
    d = df.withColumns({"_f": F.transform(fav(), lambda x: x * 10000), "_a": F.transform(adv(), lambda x: x * 10000), "_r": F.transform(closes(), lambda x: x * 10000)})
    d = with_barriers(path_lengths(d), c["barrier_favorable"], c["barrier_adverse"], 0.0)
    d = d.withColumns({"mfe": F.array_max("_f"), "mae": F.array_max("_a"), "time_to_mfe": F.array_position("_f", F.array_max("_f")), "pre_mfe_adverse": pre_mfe_adverse(d)})
    won, neither = F.col("outcome") == "FAVORABLE_FIRST", F.col("outcome") == "NEITHER_REACHED"
    d = d.withColumn("rr", F.col("mfe") / (F.col("mae") + c["rr_epsilon"]))
    votes = {
        "a": (F.col("mfe") >= c["min_mfe"]) & (F.col("mae") <= c["max_mae"]) & (F.col("rr") >= c["min_ratio"]), "b": won,
        "c": (F.col("rr") >= c["rr_min"]) & (F.col("mfe") - c["cost"] >= c["rr_room"]),
        "d": (F.col("efficiency") >= c["min_efficiency"]) & (F.col("time_to_mfe") <= horizon * c["max_time"]) & (F.col("pre_mfe_adverse") <= c["max_pre_adverse"]) & (F.col("directional_persistence") >= c["min_persistence"]),
        "e": (F.col("mfe") >= c["economic_mfe"]) & won}
    d = d.withColumns({f"teacher_{k}": e for k, e in votes.items()})
    n = sum((F.col(f"teacher_{k}").cast("int") for k in "bcde"), F.col("teacher_a").cast("int"))
    wsum = sum((F.col(f"teacher_{k}").cast("int") * F.lit(float(x)) for k, x in zip("abcde", c["weights"])), F.lit(0.0))
    unit = lambda e: clip(e, 0.0, 1.0)
    shape = unit((F.col("efficiency") + unit(F.col("directional_persistence")) + unit(1 - (F.col("time_to_mfe") - 1) / horizon) + unit(1 - F.col("pre_mfe_adverse") / c["adverse_span"])) / 4)
    score = 100 * (0.30 * unit((F.col("mfe") - c["cost"]) / c["mfe_span"]) + 0.25 * unit(F.col("rr") / 4) + 0.20 * F.when(won, 1.0).when(neither, 0.25).otherwise(0.0) + 0.25 * shape)
    return clean(d.withColumns({"votes": n, "majority_ideal": n >= c["majority"], "strict_ideal": n >= c["strict"], "weighted_ideal": wsum >= c["weighted"], "quality_score": score, "policy_gross": F.col("utility")}))


def ideal_zones(df: DataFrame, ideal: Column, max_gap: int, score: str, by: Sequence[str]) -> DataFrame:
    """Zones of ideal rows at most ``max_gap`` apart (inclusive) and the best row of each (score, then time)."""
    by = list(by)
    d = scan.pin(df.filter(ideal))
    d = scan.framed(d, by, ["ts"], lambda w: {"_new": F.when(F.col("ts") - F.lag("ts", 1).over(w) <= max_gap, 0).otherwise(1)}, back=1)
    d = scan.prefix_scan(d, by, ["ts"], {"zone": ("sum", "_new")}).drop("_new")
    g = d.groupBy(*by, "zone").agg(F.min("ts").alias("zone_start"), F.max("ts").alias("zone_end"), F.count(F.lit(1)).alias("zone_rows"),
                                   F.max_by("ts", F.struct(F.col(score), -F.col("ts"))).alias("best_ts"))
    return d.join(g, [*by, "zone"]).withColumn("zone_best", F.col("ts") == F.col("best_ts"))


# --- entries over time -----------------------------------------------------------------------------------

def early_path(df: DataFrame, delays: Sequence[int]) -> DataFrame:
    """Features of the bars between the signal and each later decision, one row per delay (in bars)."""
    d = df.withColumn("delay", F.explode(F.array(*[F.lit(int(x)) for x in delays]))).withColumn("_p", F.slice("path", F.lit(1), F.col("delay")))
    s = side_sign()
    cs = F.transform("_p", lambda x: s * (x["c"] / F.col("entry") - 1))
    d = d.withColumn("_c", cs)
    steps = F.zip_with("_c", F.concat(F.array(F.lit(0.0)), F.slice("_c", F.lit(1), F.col("delay") - 1)), lambda a, b: a - b)
    d = d.withColumn("_s", steps)
    vol, buy = total(F.transform("_p", lambda x: x["v"])), total(F.transform("_p", lambda x: x["b"]))
    net = F.element_at("_c", -1)
    f = F.when(F.col("side") == "LONG", F.transform("_p", lambda x: x["h"] / F.col("entry") - 1)).otherwise(F.transform("_p", lambda x: 1 - x["l"] / F.col("entry")))
    a = F.when(F.col("side") == "LONG", F.transform("_p", lambda x: 1 - x["l"] / F.col("entry"))).otherwise(F.transform("_p", lambda x: x["h"] / F.col("entry") - 1))
    half = F.greatest(F.lit(1), F.floor(F.col("delay") / 2).cast("int"))
    early = F.element_at("_c", half)
    return clean(d.withColumns({
        "net": net, "velocity": net / F.col("delay"), "acceleration": (net - early) - early, "efficiency": F.coalesce(div(F.abs(net), F.nullif(total(F.transform("_s", F.abs)), F.lit(0.0))), F.lit(0.0)),
        "flow": s * F.coalesce(div(2 * buy - vol, F.nullif(vol, F.lit(0.0))), F.lit(0.0)), "mfe": F.array_max(f), "mae": F.array_max(a),
        "favorable_move_first": F.array_position(f, F.array_max(f)) < F.array_position(a, F.array_max(a))}))


def delayed_entry(signals: DataFrame, bars: DataFrame, step: int, horizon: int, delays: Sequence[int], fav_level: float, adv_level: float, cost: float,
                  key: str = "signal_id") -> DataFrame:
    """Each signal x delay: first open at or after the decision, outcome, change against delay 0; complete episodes only."""
    d = signals.withColumn("delay", F.explode(F.array(*[F.lit(int(x)) for x in delays])))
    d = d.withColumn("_start", F.ceil((F.col("ts") + F.col("delay")) / step) * step)
    p = triple_barrier(path_at(d, bars, "_start", step, horizon, [key, "delay"]), fav_level, adv_level, cost)
    w = Window.partitionBy(key)
    p = p.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == len(delays))
    base = F.max(F.when(F.col("delay") == delays[0], F.col("utility"))).over(w)
    return p.withColumn("change", F.col("utility") - base).drop("_n", "_start")


def stop_recovery(trades: DataFrame, bars: DataFrame, step: int, windows: Sequence[int], key: str = "id") -> DataFrame:
    """After a stop at ``exit_ts``: did price come back to entry or midpoint within each window (contiguous bars only)."""
    top = max(windows)
    start = F.floor(F.col("exit_ts") / step) * step + step
    p = path_at(trades.withColumn("_start", start), bars, "_start", step, top, [key])
    long = F.col("side") == "LONG"
    reach = lambda level, k: F.when(long, F.array_max(F.transform(F.slice("path", 1, k), lambda x: x["h"])) >= F.col(level)).otherwise(
        F.array_min(F.transform(F.slice("path", 1, k), lambda x: x["l"])) <= F.col(level))
    p = p.withColumns({f"entry_{k}": reach("entry_price", k) for k in windows} | {f"midpoint_{k}": reach("midpoint", k) for k in windows})
    e, m = F.col(f"entry_{top}"), F.col(f"midpoint_{top}")
    cat = F.when(e & m, "ENTRY_AND_MIDPOINT").when(e, "ENTRY_ONLY").when(m, "MIDPOINT_ONLY").otherwise("NO_RECOVERY")
    return p.withColumn("category", cat).drop("_start")


def exploded(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per path bar with running peak ``peak`` and adverse ``worst`` (fractions) for long-form rules."""
    d = with_excursions(df).select(*key, "side", "entry", F.posexplode(F.arrays_zip("_f", "_a", "_r", "path")).alias("bar", "_z"))
    d = d.select(*key, "side", "entry", (F.col("bar") + 1).alias("bar"), F.col("_z._f").alias("fav"), F.col("_z._a").alias("adv"), F.col("_z._r").alias("ret"))
    w = Window.partitionBy(*key, "side").orderBy("bar").rowsBetween(scan.UP, 0)
    return d.withColumns({"peak": F.greatest(F.lit(0.0), F.max("fav").over(w)), "worst": F.greatest(F.lit(0.0), F.max("adv").over(w))})


def exit_rules(df: DataFrame, rules: DataFrame, key: Sequence[str], hard_stop: float, gate: float, cost: float, arm: float = 0.0, lock: float = 0.0) -> DataFrame:
    """Exit of each episode under each rule of ``rules(rule, param)``, hard stop first, else the last close.

    FIXED_TP exits at its level; FIXED_TRAILING, PERCENT_GIVEBACK, TIME_EXIT and
    BREAK_EVEN act at closes from the bar whose peak reached ``gate``.
    """
    x = exploded(df, key)
    w = Window.partitionBy(*key, "side")
    x = x.withColumn("_g", F.coalesce(F.min(F.when(F.col("peak") >= gate, F.col("bar"))).over(w), F.max("bar").over(w))).withColumn("_last", F.max("bar").over(w))
    x = x.crossJoin(F.broadcast(rules))
    rule, p, live = F.col("rule"), F.col("param"), F.col("bar") >= F.col("_g")
    floor = F.greatest(F.lit(lock), F.col("peak") - p)
    met = F.when(rule == "FIXED_TP", F.col("fav") >= p).when(~live, False).when(rule == "FIXED_TRAILING", F.col("peak") - F.col("ret") >= p).when(
        rule == "PERCENT_GIVEBACK", (F.col("peak") > 0) & (F.col("peak") - F.col("ret") >= p * F.col("peak"))).when(
        rule == "TIME_EXIT", F.col("bar") - F.col("_g") >= p).when(rule == "BREAK_EVEN", (F.col("peak") >= arm) & (F.col("ret") <= floor)).otherwise(False)
    stop = F.col("adv") >= hard_stop
    why = F.when(stop, "COMMON_HARD_STOP").when(met, rule).when(F.col("bar") == F.col("_last"), "BOUNDED_HOLD")
    gross = F.when(stop, F.lit(-hard_stop)).when(met & (rule == "FIXED_TP"), p).otherwise(F.col("ret"))
    x = x.withColumns({"_why": why, "_gross": gross}).filter("_why is not null")
    g = x.groupBy(*key, "side", "rule", "param").agg(F.min_by(F.struct("_why", "_gross", "bar", "peak", "worst"), "bar").alias("e"))
    g = g.select(*key, "side", "rule", "param", F.col("e.bar").alias("exit_bar"), F.col("e._why").alias("reason"), F.col("e._gross").alias("gross"), F.col("e.peak").alias("peak"), F.col("e.worst").alias("mae"))
    return g.withColumns({"net": F.col("gross") - cost, "capture": F.coalesce(div(F.greatest(F.lit(0.0), F.col("gross")), F.nullif("peak", F.lit(0.0))), F.lit(0.0)), "giveback": F.greatest(F.lit(0.0), F.col("peak") - F.col("gross"))})


def trade_extrema(trades: DataFrame, bars: DataFrame, step: int, bucket: int, key: str = "id") -> DataFrame:
    """Extremes of the bars in [entry_ts, exit_ts], time to each, distances and a midpoint flag (fractions of the entry)."""
    from . import joins

    t = trades.withColumns({"_lo": F.floor(F.col("entry_ts") / step) * step, "_hi": F.col("exit_ts")})
    j = joins.interval_join(t, bars.select("symbol", "ts", "high", "low"), "_lo", "_hi", "[]", bucket)
    long = F.col("side") == "LONG"
    f = F.when(long, F.col("r_high") / F.col("entry_price") - 1).otherwise(1 - F.col("r_low") / F.col("entry_price"))
    a = F.when(long, 1 - F.col("r_low") / F.col("entry_price")).otherwise(F.col("r_high") / F.col("entry_price") - 1)
    inner = (F.col("r_ts") > F.col("_lo")) & (F.col("r_ts") + step <= F.col("exit_ts"))
    mid = (F.col("r_low") <= F.col("midpoint")) & (F.col("midpoint") <= F.col("r_high"))
    g = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("bars"), F.max(f).alias("mfe_full"), F.max(a).alias("mae_full"), F.max(F.when(inner, f)).alias("mfe_open"), F.max(F.when(inner, a)).alias("mae_open"),
        (F.max_by("r_ts", F.struct(f, -F.col("r_ts"))) - F.min("_lo")).alias("time_to_mfe"), (F.max_by("r_ts", F.struct(a, -F.col("r_ts"))) - F.min("_lo")).alias("time_to_mae"),
        F.max(mid.cast("int")).alias("_m"))
    return trades.join(g, key).withColumns({"midpoint_hit": F.col("_m") == 1, "midpoint_distance": side_sign() * (F.col("midpoint") / F.col("entry_price") - 1)}).drop("_m")


def episode_tables(df: DataFrame, key: Sequence[str], gate: float) -> tuple[DataFrame, DataFrame]:
    """One row per episode with its totals and path, and one row per bar once the peak reached ``gate``."""
    d = with_excursions(df).withColumns({"peak_mfe": F.greatest(F.lit(0.0), F.array_max("_f")), "mae": F.greatest(F.lit(0.0), F.array_max("_a")), "gross": F.element_at("_r", -1)})
    x = exploded(df, key)
    w = Window.partitionBy(*key, "side").orderBy("bar")
    x = x.withColumns({"bars_in_trade": F.col("bar"), "giveback_now": F.col("peak") - F.col("ret"), "future_best": F.max("fav").over(w.rowsBetween(1, Window.unboundedFollowing))})
    return clean(d), x.filter(F.col("peak") >= gate)


def giveback_targets(df: DataFrame, key: Sequence[str], gate: float, unit: float, ahead: int = 3) -> DataFrame:
    """Per decision bar: giveback and new extremes within the next bars, in multiples of ``unit`` (a fraction of the entry)."""
    x = exploded(df, key)
    w = Window.partitionBy(*key, "side").orderBy("bar")
    low = -F.col("adv")
    cols = {f"giveback_next_{h}": F.coalesce(F.col("ret") - F.min(low).over(w.rowsBetween(1, h)) >= 0.25 * unit, F.lit(False)) for h in range(1, ahead + 1)}
    lows = F.collect_list(low).over(w.rowsBetween(1, ahead))
    highs = F.collect_list("fav").over(w.rowsBetween(1, ahead))
    x = x.withColumns(cols).withColumns({"_lows": lows, "_highs": highs})
    g = first_hit(F.transform("_lows", lambda v: F.col("ret") - v), 0.25 * unit)
    n = first_hit(F.transform("_highs", lambda v: v - F.col("peak")), 0.25 * unit)
    x = x.withColumns({"giveback_first": g.isNotNull() & (n.isNull() | (g <= n)), "extreme_first": n.isNotNull() & (g.isNull() | (n < g)),
                       "additional_mfe": F.greatest(F.lit(0.0), F.coalesce(F.array_max("_highs"), F.col("peak")) - F.col("peak")) / unit,
                       "future_giveback": F.greatest(F.lit(0.0), F.col("ret") - F.coalesce(F.array_min("_lows"), F.col("ret"))) / unit})
    return clean(x.filter(F.col("peak") >= gate))


# --- costs and execution ----------------------------------------------------------------------------------

def cost_scenarios(trades: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Adverse fills, fees on both notionals, funding by mark/entry per ``scenarios(scenario, fee_bps, slip_bps, funding_bps)``."""
    d = trades.crossJoin(F.broadcast(scenarios))
    s, slip = side_sign(), F.col("slip_bps") / 10000
    d = d.withColumns({"entry_fill": F.col("entry_price") * (1 + s * slip), "exit_fill": F.col("exit_price") * (1 - s * slip)})
    gross = s * (F.col("exit_fill") / F.col("entry_fill") - 1)
    fee = F.col("fee_bps") / 10000 * (1 + F.col("exit_fill") / F.col("entry_fill"))
    fund = s * F.col("funding_rate") * F.col("mark") / F.col("entry_fill") + F.col("funding_bps") / 10000
    return d.withColumns({"gross": gross, "fees": fee, "funding_paid": fund, "net": gross - fee - fund})


def execution_quality(df: DataFrame) -> DataFrame:
    """Microprice, shortfall, adverse selection and total cost in bps; needs bid, ask, bid_size, ask_size, fill, side, mid_after, fee_bps."""
    d = df.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "microprice": div(F.col("ask") * F.col("bid_size") + F.col("bid") * F.col("ask_size"), F.col("bid_size") + F.col("ask_size"))})
    s = side_sign()
    bps = lambda x: div(x, "mid") * 10000
    d = d.withColumns({"spread_bps": bps(F.col("ask") - F.col("bid")), "shortfall_bps": s * bps(F.col("fill") - F.col("mid")), "adverse_bps": -s * bps(F.col("mid_after") - F.col("mid"))})
    return d.withColumn("total_cost_bps", F.col("shortfall_bps") + F.col("adverse_bps") + F.col("fee_bps"))


def entry_class(df: DataFrame, good_mfe: float, good_mae: float, bad_mae: float, min_ratio: float) -> DataFrame:
    ratio = F.coalesce(div("mfe", F.nullif("mae", F.lit(0.0))), F.lit(float("inf")))
    c = F.when((F.col("net") > 0) & (F.col("mfe") >= good_mfe) & (F.col("mae") <= good_mae) & (ratio >= min_ratio), "GOOD_CLEAN").when(
        (F.col("net") <= 0) & ((F.col("mae") >= bad_mae) | (ratio < 1)), "BAD").otherwise("MIXED")
    return df.withColumn("entry_class", c)


def mature(signals: DataFrame, bars: DataFrame, horizon: int, existing: DataFrame | None = None, key: str = "signal_id") -> DataFrame:
    """Signals with at least ``horizon`` later bars become outcomes once; the rest stay premature (left out).

    The bars of a symbol are numbered in one skew-free pass, an as-of lookup gives
    the last bar at or before the signal, and the outcome bars join by number.
    """
    from . import joins

    num = scan.row_index(bars.select("symbol", "ts", "open", "high", "low", "close"), ["symbol"], ["ts"], "n")
    s = signals if existing is None else signals.join(existing.select(key), key, "left_anti")
    s = joins.asof_join(s, num.select("symbol", "ts", "n"), by=["symbol"], columns=["n"]).withColumn("n", F.coalesce("n", F.lit(-1)))
    want = s.select(key, "symbol", "side", F.posexplode(F.sequence(F.col("n") + 1, F.col("n") + horizon)).alias("_k", "n"))
    j = want.join(num, ["symbol", "n"]).groupBy(key, "symbol", "side").agg(
        F.count(F.lit(1)).alias("_c"), F.min_by("open", "n").alias("entry"), F.max_by("close", "n").alias("exit"), F.max("high").alias("_h"), F.min("low").alias("_l"), F.max("ts").alias("matured_ts"))
    j = j.filter(F.col("_c") == horizon)
    long = F.col("side") == "LONG"
    up, dn = F.col("_h") / F.col("entry") - 1, 1 - F.col("_l") / F.col("entry")
    return j.withColumns({"gross": side_sign() * (F.col("exit") / F.col("entry") - 1), "mfe": F.when(long, up).otherwise(dn), "mae": F.when(long, dn).otherwise(up)}).drop("_c", "_h", "_l")
