"""Rolling, lagged and recursive features over ordered bars.

Stage builders take a WindowSpec (see ``scan.framed``) and return columns, so many
features share one sort.  Recursive ones (EMA family) use ``scan.affine_scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip, div, flag, safe_div
from . import scan
from .scan import k_rows

_FN = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std_pop": F.stddev_pop, "std_samp": F.stddev_samp,
       "median": lambda c: F.percentile(c, F.lit(0.5))}


def c_(x):
    return F.col(x) if isinstance(x, str) else x


def rolling(w, c, k: int, fn: str, lag: int = 0, min_periods: int | None = None) -> Column:
    """Rolling statistic of the last k rows; NULL until ``min_periods`` values (default k) are present."""
    fr = k_rows(w, k, lag)
    return F.when(F.count(c_(c)).over(fr) >= (k if min_periods is None else min_periods), _FN[fn](c_(c)).over(fr))


def ret(w, k: int, c="close") -> Column:
    return div(c_(c), F.lag(c_(c), k).over(w)) - 1


def returns(w, ks=(1, 3, 6), c="close") -> dict[str, Column]:
    r1, r1p = ret(w, 1, c), div(F.lag(c_(c), 1).over(w), F.lag(c_(c), 2).over(w)) - 1
    return {**{f"ret_{k}": ret(w, k, c) for k in ks}, "log_ret_1": F.log(div(c_(c), F.lag(c_(c), 1).over(w))),
            "ret_1_bps": r1 * 10000, "accel": r1 - r1p}


def true_range(w) -> Column:
    """max(h-l, |h-pc|, |l-pc|); the first bar uses its own open as previous close."""
    pc = F.coalesce(F.lag("close", 1).over(w), F.col("open"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def efficiency(w, k: int, c="close", diff="_d") -> dict[str, Column]:
    """Needs column ``diff`` = one-bar change."""
    path = rolling(w, F.abs(F.col(diff)), k, "sum")
    eff = div(F.abs(c_(c) - F.lag(c_(c), k).over(w)), path)
    return {f"efficiency_{k}": eff, f"persistence_{k}": rolling(w, F.signum(diff), k, "mean"), f"chop_{k}": 1 - eff}


def breakout(w, k: int) -> dict[str, Column]:
    """Levels exclude the current bar."""
    hi, lo = rolling(w, "high", k, "max", 1), rolling(w, "low", k, "min", 1)
    return {"prior_high": hi, "prior_low": lo, "breakout_up": div("close", hi) - 1,
            "breakout_down": div(lo, "close") - 1, "dist_high": div(hi - F.col("close"), "close"),
            "dist_low": div(F.col("close") - lo, "close"),
            "swept_low": flag((F.col("low") < lo) & (F.col("close") >= lo)),
            "swept_high": flag((F.col("high") > hi) & (F.col("close") <= hi))}


def acceptance(w, k: int, level="prior_high") -> Column:
    return F.avg(flag(F.col("close") > F.col(level))).over(k_rows(w, k)) - 0.5


def zscore(w, c, k: int) -> Column:
    """Against the k rows before the current one, population std; zero std gives NULL."""
    fr = k_rows(w, k, 1)
    sd = F.stddev_pop(c_(c)).over(fr)
    return F.when((F.count(c_(c)).over(fr) >= k) & (sd > 0), div(c_(c) - F.avg(c_(c)).over(fr), sd))


def rolling_rank(w, c, k: int, mode: str, min_periods: int | None = None) -> Column:
    """Percentile of the current value in the trailing k rows.

    average: average-tie rank / n, current included; inclusive: share <= current,
    current included; exclusive: share of the k rows before it that are <= current.
    Only finite values count, a value that is not finite has no percentile, and ``min_periods`` (k if not given)
    finite values must be there.
    """
    x = c_(c).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vals = F.collect_list(F.when(finite, x)).over(k_rows(w, k, 1 if mode == "exclusive" else 0))
    n = F.size(vals)
    le = F.size(F.filter(vals, lambda x: x <= c_(c)))
    lt = F.size(F.filter(vals, lambda x: x < c_(c)))
    pct = div(lt + (le - lt + 1) / 2.0, n) if mode == "average" else div(le, n)
    return F.when(finite & (n >= max(1, k if min_periods is None else min_periods)), pct)


def beta_corr(w, x="ret", ref="ref_ret", k: int = 24, lag: int = 0, limit: float | None = None) -> dict[str, Column]:
    fr = k_rows(w, k, lag)
    both = c_(x).isNotNull() & c_(ref).isNotNull()
    a, b = F.when(both, c_(x)), F.when(both, c_(ref))
    ok = F.count(a).over(fr) >= k
    var = F.var_samp(b).over(fr)
    beta = F.when(ok, div(F.covar_samp(a, b).over(fr), var))
    return {"beta": clip(beta, -limit, limit) if limit else beta, "corr": F.when(ok, F.corr(a, b).over(fr))}


def ema_columns(df: DataFrame, specs: dict[str, tuple[str, float]], by=("symbol",), skip: int = 0, **kw) -> DataFrame:
    return scan.affine_scan(df, list(by), ["ts"], specs, skip=skip, **kw)


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def _unindexed(df: DataFrame, d: DataFrame) -> DataFrame:
    return d if "_i" in df.columns else d.drop("_i")


def rsi(df: DataFrame, n: int, by=("symbol",), c: str = "close", out: str = "rsi", **kw) -> DataFrame:
    """Wilder RSI; no losses gives 100, no gains gives 0."""
    by = list(by)
    d = scan.framed(scan.indexed(df, by, ["ts"]), by, ["ts"], lambda w: {"_d": c_(c) - F.lag(c, 1).over(w)}, back=1)
    d = d.withColumns({"_g": F.greatest(F.col("_d"), F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    d = scan.affine_scan(d, by, ["ts"], {"_ag": ("_g", 1.0 / n), "_al": ("_l", 1.0 / n)}, skip=1, **kw)
    v = F.when(F.col("_al") <= 0, 100.0).when(F.col("_ag") <= 0, 0.0).otherwise(100 - 100 / (1 + div("_ag", "_al")))
    return _unindexed(df, d.withColumn(out, F.when(F.col("_ag").isNotNull(), v)).drop("_d", "_g", "_l", "_ag", "_al"))


def atr(df: DataFrame, n: int, kind: str = "mean", by=("symbol",), **kw) -> DataFrame:
    """ATR as rolling mean, Wilder from the first bar, or Wilder seeded with the mean of the first n ranges."""
    by = list(by)
    d = scan.framed(scan.indexed(df, by, ["ts"]), by, ["ts"], lambda w: {"tr": true_range(w)},
                    lambda w: {"_m": rolling(w, "tr", n, "mean")}, back=n)
    if kind == "mean":
        d = d.withColumnRenamed("_m", "atr")
    else:
        skip = n - 1 if kind == "wilder_sma" else 0
        d = d.withColumn("_x", F.when((F.col("_i") == n - 1) & F.lit(kind == "wilder_sma"), F.col("_m")).otherwise(F.col("tr")))
        d = scan.affine_scan(d, by, ["ts"], {"atr": ("_x", 1.0 / n)}, skip=skip, **kw).drop("_m", "_x")
    return _unindexed(df, d.withColumns({"atr_fraction": F.col("atr") / F.col("close"), "atr_bps": F.col("atr") / F.col("close") * 10000}))


def run_length(df: DataFrame, state: Column, by=("symbol",), out: str = "run", slice_width: int = scan.DAY, order=("ts",), **kw) -> DataFrame:
    """Number of consecutive rows, ending here, that share ``state``."""
    return scan.recurrences(df, list(by), list(order), runs={out: state}, slice_width=slice_width, **kw)


def candle_runs(w, length: int) -> dict[str, Column]:
    """Exactly ``length`` same-colour bars ending here (the bar before them differs), with what follows."""
    col_ = F.signum(F.col("close") - F.col("open"))
    prev = [F.lag(col_, i).over(w) for i in range(1, length + 1)]
    same = F.lit(True)
    for p in prev[:-1]:
        same = same & (p == col_)
    exact = same & (prev[-1] != col_) & (col_ != 0)
    entry = F.lead("open", 1).over(w)
    return {"color": col_, "exact_run": exact, "next_color": F.lead(col_, 1).over(w),
            "second_color": F.lead(col_, 2).over(w), "h1_ret": div(F.lead("close", 1).over(w), entry) - 1,
            "h2_ret": div(F.lead("close", 2).over(w), entry) - 1,
            "h2_mfe": div(F.max("high").over(w.rowsBetween(1, 2)), entry) - 1,
            "h2_mae": div(F.min("low").over(w.rowsBetween(1, 2)), entry) - 1}


def flow_features(w, k: int, buy="buy_volume", total="volume") -> dict[str, Column]:
    """Needs ``flow_1`` (bar imbalance) and ``ret_1``; windows end at the current bar."""
    b, t = F.sum(buy).over(k_rows(w, k)), F.sum(total).over(k_rows(w, k))
    imb = div(2 * b - t, t)
    half = max(1, k // 2)
    recent, older = F.avg("flow_1").over(k_rows(w, half)), F.avg("flow_1").over(k_rows(w, half, half))
    r = F.sum("ret_1").over(k_rows(w, k))
    return {f"flow_{k}": imb, f"flow_persistence_{k}": F.abs(F.avg(F.signum("flow_1")).over(k_rows(w, k))),
            f"flow_slope_{k}": F.col("flow_1") - F.lag("flow_1", k - 1).over(w), f"flow_accel_{k}": recent - older,
            f"flow_impact_{k}": safe_div(r, F.abs(imb)), f"flow_decay_{k}": safe_div(F.abs(recent), F.abs(older))}


def sequence_features(w, n: int) -> dict[str, Column]:
    """Shape of the last n candles; needs ``_up`` (close>open), ``_hc/_hh/_hl`` (higher than the bar before),
    ``_ov`` (overlap with the bar before), ``_alt`` (colour differs), ``_d`` (close change), ``_rg`` (range)."""
    fr, pairs = k_rows(w, n), k_rows(w, n - 1)
    ok = F.count("ts").over(fr) >= n
    first_open = F.lag("open", n - 1).over(w)
    disp, travel = F.col("close") - first_open, F.sum(F.abs(F.col("close") - F.col("open"))).over(fr)
    cols = {
        "bull_fraction": F.avg("_up").over(fr), "higher_close": F.avg("_hc").over(pairs),
        "higher_high": F.avg("_hh").over(pairs), "higher_low": F.avg("_hl").over(pairs),
        "overlap": F.avg("_ov").over(pairs), "alternation": F.avg("_alt").over(pairs), "displacement": div(disp, first_open),
        "travel": div(travel, first_open), "efficiency": safe_div(F.abs(disp), travel),
        "impulse_dominance": safe_div(F.max(F.abs(F.col("close") - F.col("open"))).over(fr), travel),
        "range_compression": safe_div("_rg", F.avg("_rg").over(fr)),
        "relative_volume": safe_div("volume", F.avg("volume").over(fr)),
        "buy_ratio": safe_div(F.sum("buy_volume").over(fr), F.sum("volume").over(fr))}
    return {f"{k}_{n}": F.when(ok, v) for k, v in cols.items()}


def sequence_inputs(w) -> dict[str, Column]:
    pc, ph, pl, po = (F.lag(x, 1).over(w) for x in ("close", "high", "low", "open"))
    shared = F.greatest(F.lit(0.0), F.least(F.col("high"), ph) - F.greatest(F.col("low"), pl))
    span_ = F.greatest(F.col("high"), ph) - F.least(F.col("low"), pl)
    return {"_up": flag(F.col("close") > F.col("open")), "_hc": flag(F.col("close") > pc),
            "_hh": flag(F.col("high") > ph), "_hl": flag(F.col("low") > pl), "_ov": safe_div(shared, span_),
            "_alt": flag((F.col("close") > F.col("open")) != (pc > po)), "_d": F.col("close") - pc,
            "_rg": F.col("high") - F.col("low")}


def multi_horizon(w, ks=(3, 6, 12)) -> dict[str, Column]:
    """Needs ``ret_1`` and ``flow_1``."""
    out = {}
    for k in ks:
        hi, lo = F.max("high").over(k_rows(w, k)), F.min("low").over(k_rows(w, k))
        out[f"ret_{k}"] = ret(w, k)
        out[f"flow_{k}"] = rolling(w, "flow_1", k, "mean")
        out[f"vol_{k}"] = rolling(w, "ret_1", k, "std_pop")
        out[f"loc_{k}"] = F.when(hi > lo, div(F.col("close") - lo, hi - lo)).otherwise(0.5)
        out[f"sma_gap_{k}"] = div("close", rolling(w, "close", k, "mean")) - 1
    return out


def pressure(w, atr_col="atr") -> dict[str, Column]:
    """Taker pressure; needs ``buy_ratio`` (buy/total) and ``avg_trade`` (volume/trades)."""
    m = {k: rolling(w, "buy_ratio", k, "mean") for k in (1, 3, 12)}
    return {"taker_1": m[1], "taker_3": m[3], "taker_12": m[12], "taker_change": m[3] - m[12],
            "count_ratio": safe_div("trades", rolling(w, "trades", 12, "mean")),
            "quote_ratio": safe_div("volume", rolling(w, "volume", 12, "mean")),
            "trade_size_ratio": safe_div("avg_trade", rolling(w, "avg_trade", 12, "mean")),
            "impulse": (m[1] - 0.5) * F.tanh(safe_div(F.col("close") - F.lag("close", 1).over(w), atr_col))}


def flow_sequence(short: str, medium: str, rs: str, rm: str) -> dict[str, Column]:
    """Flow (short/medium) against response columns, side neutral expressions."""
    s, m, a, b = (F.col(x) for x in (short, medium, rs, rm))
    return {"flow_response_short": s * a, "flow_response_medium": m * b,
            "flow_without_response": F.abs(s) * flag(F.signum(s) != F.signum(a)),
            "adverse_resistance": F.greatest(-(s * F.signum(a)), F.lit(0.0)), "short_minus_medium": s - m,
            "flow_accel": s - m / 2, "flow_reversal": flag(s * m < 0), "flow_persist": flag(s * m > 0)}
