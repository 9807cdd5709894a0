"""Cross-sectional panels, scaling, ranking and selection.

Per-timestamp windows are bounded by the symbol universe.  Ranks over a whole
table or a strategy go through ``scan.global_index``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip, div, flag, side_sign
from . import order_stats, scan


def at_ts(*extra):
    return Window.partitionBy("ts", *extra)


# --- orientation and scaling ------------------------------------------------------------------

def orient_sides(df: DataFrame, signed: Sequence[str] = (), swapped: Sequence[tuple[str, str]] = (),
                 complement: Sequence[str] = (), rsi: str | None = None) -> DataFrame:
    """One LONG and one SHORT row per input row: signed features flip, pairs swap, shares become 1-x."""
    d = df.withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    long = F.col("side") == "LONG"
    cols = {c: F.when(long, F.col(c)).otherwise(-F.col(c)) for c in signed}
    for a, b in swapped:
        cols[a], cols[b] = F.when(long, F.col(a)).otherwise(F.col(b)), F.when(long, F.col(b)).otherwise(F.col(a))
    cols |= {c: F.when(long, F.col(c)).otherwise(1 - F.col(c)) for c in complement}
    if rsi:
        cols["rsi_room"] = F.when(long, 100 - F.col(rsi)).otherwise(F.col(rsi))
    return d.withColumns(cols)


def fit_normaliser(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of mean and population std per feature; a tiny std becomes 1."""
    sd = lambda n: F.when(F.stddev_pop(n) > 1e-12, F.stddev_pop(n)).otherwise(1.0)
    return train.agg(*[F.avg(n).alias(f"_m_{n}") for n in names], *[sd(n).alias(f"_s_{n}") for n in names])


def apply_normaliser(df: DataFrame, fit: DataFrame, names: Sequence[str], limit: float = 12.0) -> DataFrame:
    d = df.crossJoin(F.broadcast(fit))
    z = {n: (F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}") for n in names}
    hits = [(F.abs(e) > limit).cast("int") for e in z.values()]
    d = d.withColumn("clipped", sum(hits[1:], hits[0]))
    return d.withColumns({n: clip(e, -limit, limit) for n, e in z.items()}).drop(*fit.columns)


def fit_robust_scale(train: DataFrame, names: Sequence[str], min_rows: int = 100) -> DataFrame:
    """One row: median, scale (IQR, or q99-q01 when the IQR is degenerate) and winsor bounds per feature."""
    from .quality import fail_if

    q = order_stats.feature_quantiles(train, names, {"lo": 0.001, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "hi": 0.999})
    iqr = F.col("q75") - F.col("q25")
    q = q.withColumn("scale", F.when(iqr > 1e-12, iqr).otherwise(F.col("q99") - F.col("q01")))
    q = fail_if(q, (F.col("n") < min_rows) | ~(F.col("scale") > 1e-12), "scale is degenerate or has too few rows")
    pick = lambda n, c: F.max(F.when(F.col("feature") == n, F.col(c)))
    return q.agg(*[pick(n, c).alias(f"_{t}_{n}") for n in names for c, t in (("q50", "c"), ("scale", "s"), ("lo", "l"), ("hi", "h"))])


def apply_robust_scale(df: DataFrame, fit: DataFrame, names: Sequence[str], limit: float = 8.0) -> DataFrame:
    d = df.crossJoin(F.broadcast(fit))
    wins = lambda n: F.when(F.col(n).isNotNull(), F.greatest(F.col(f"_l_{n}"), F.least(F.col(f"_h_{n}"), F.col(n))))
    return d.withColumns({n: clip((wins(n) - F.col(f"_c_{n}")) / F.col(f"_s_{n}"), -limit, limit) for n in names}).drop(*fit.columns)


# --- cross section ------------------------------------------------------------------------------

def mid_rank(c: str, by: Sequence[str] = ("ts",), lower_is_better: bool = False, single: float = 0.0) -> Column:
    """(values beaten + (ties - 1)/2) / (n - 1); rank, ties and n come from one sort."""
    w = Window.partitionBy(*by).orderBy(F.col(c).desc() if lower_is_better else F.col(c))
    n = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    beaten = F.rank().over(w) - 1
    tie = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - beaten
    return F.when(n == 1, F.lit(single)).otherwise(div(beaten + (tie - 1) / 2.0, n - 1))


def pct_rank(c: str, by: Sequence[str] = ("ts",)) -> Column:
    """Average-tie rank divided by the number of non-NULL values."""
    n = F.count(c).over(Window.partitionBy(*by))
    tie = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    r = F.rank().over(Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()))
    return F.when(F.col(c).isNotNull(), (r + (tie - 1) / 2.0) / n)


def cross_stats(c: str, ref: str, ddof: int = 0) -> dict[str, Column]:
    w = at_ts()
    ref_v = F.max(F.when(F.col("symbol") == ref, F.col(c))).over(w)
    return {"breadth": F.avg(flag(F.col(c) > 0)).over(w), "dispersion": (F.stddev_pop if ddof == 0 else F.stddev_samp)(c).over(w),
            "market": F.avg(c).over(w), "concentration": div(F.max(F.abs(c)).over(w), F.greatest(F.sum(F.abs(c)).over(w), F.lit(1e-15))),
            "relative": F.col(c) - F.avg(c).over(w), "vs_reference": F.col(c) - ref_v,
            "alt_basket": F.avg(F.when(F.col("symbol") != ref, F.col(c))).over(w)}


def residualise(df: DataFrame, ref: str, cost: float = 0.0014, risk: float = 0.25) -> DataFrame:
    """Beta-neutral future minus the median of the other symbols, per side; needs beta, future, mae, side."""
    w = at_ts("side")
    d = df.withColumn("_rf", F.max(F.when(F.col("symbol") == ref, F.col("future"))).over(w))
    d = d.withColumn("neutral", F.col("future") - F.col("beta") * F.col("_rf"))
    d = d.withColumn("common", F.percentile(F.when(F.col("symbol") != ref, F.col("neutral")), F.lit(0.5)).over(w))
    d = d.withColumn("residual", side_sign() * (F.col("neutral") - F.col("common")))
    return d.withColumn("utility", F.col("residual") - cost - risk * F.col("mae")).drop("_rf").filter(
        F.col("beta").isNotNull() & F.col("common").isNotNull())


# --- selection ------------------------------------------------------------------------------------

def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """n is literal, so Spark keeps n rows per task (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_fraction(df: DataFrame, score: str, tie: str, fraction: float) -> DataFrame:
    d = scan.ranked(df, [], F.col(score), tie, descending=True)
    return d.filter(F.col("_rank") < F.greatest(F.lit(1), F.ceil(F.round(F.col("_total") * fraction, 9)))).drop("_rank", "_total")


def top_k_per(df: DataFrame, by: Sequence[str], k: int, *order) -> DataFrame:
    """Spark pushes the row_number limit below the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def winners(df: DataFrame) -> DataFrame:
    return top_k_per(df, ["ts"], 1, F.col("score").desc(), F.col("symbol"), F.col("id"))


def gated_selection(df: DataFrame, gates: Column, k: int, *order) -> DataFrame:
    return top_k_per(df.filter(gates), ["ts"], k, *order)


def equal_budget(df: DataFrame, strategy: str, caps: DataFrame | None = None) -> DataFrame:
    """Every strategy keeps its best rows up to the smallest strategy's count (or ``caps(fold, budget)`` with a status)."""
    if caps is None:
        n = df.groupBy(strategy).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_budget"))
        d = scan.global_index(df, [strategy], F.col("score"), ["ts", "symbol", "id"], descending=True)
        return d.crossJoin(F.broadcast(n)).filter(F.col("_rank") < F.col("_budget")).drop("_rank", "_budget")
    d = scan.ranked(df, [strategy, "fold"], F.col("score"), ["ts", "symbol", "id"], descending=True).join(caps, "fold")
    return d.filter(F.col("_rank") < F.col("budget")).withColumn(
        "status", F.when(F.col("_total") >= F.col("budget"), "COMPLETE").otherwise("SHORTFALL")).drop("_rank", "_total")


def survivors(df: DataFrame, risk: str, veto: float, tie: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The bround((1-veto)*n) rows with the lowest risk."""
    d = scan.ranked(df, by, F.col(risk), tie)
    return d.filter(F.col("_rank") < F.bround((1 - veto) * F.col("_total"))).drop("_rank", "_total")


def ecdf(ref: DataFrame, target: DataFrame, score: str = "score", key: str = "symbol", ident: str = "id") -> DataFrame:
    """Share of the key's reference scores <= the target score; keys without reference use all of it.

    A running count over (score, reference first) replaces the comparison of all pairs.
    """
    u = ref.select(key, F.col(score).alias("_s"), F.lit(0).alias("_t"), F.lit(None).cast("long").alias(ident)).unionByName(
        target.select(key, F.col(score).alias("_s"), F.lit(1).alias("_t"), F.col(ident).cast("long").alias(ident)))
    u = scan.ordered_slices(u, F.col("_s"), "_t")
    is_ref = F.when(F.col("_t") == 0, 1)
    d = scan.prefix_scan(u, [key], ["_s", "_t"], {"_k": ("count", is_ref)}, slice_col=F.col("_slice_key"))
    d = scan.prefix_scan(d, [], ["_s", "_t"], {"_g": ("count", is_ref)}, slice_col=F.col("_slice_key"))
    n = ref.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    d = d.filter("_t = 1").join(n, key, "left").crossJoin(F.broadcast(ref.agg(F.count(F.lit(1)).alias("_all"))))
    return d.select(ident, key, F.col("_s").alias(score), F.when(F.col("_n") > 0, div("_k", "_n")).otherwise(div("_g", "_all")).alias("percentile"),
                    F.col("_n").isNull().alias("fallback"))


def buckets(df: DataFrame, score: str, tie: Sequence[str], n: int = 10, descending: bool = False, out: str = "bucket") -> DataFrame:
    """Ascending: 1 + floor(i*n/N) over min(n, N) buckets; descending: n - floor(i*n/N) from the best score down."""
    d = scan.ranked(df, [], F.col(score), tie, descending=descending)
    if descending:
        b = n - F.floor(F.col("_rank") * n / F.col("_total"))
    else:
        m = F.least(F.lit(n), F.col("_total"))
        b = 1 + F.least(m - 1, F.floor(F.col("_rank") * m / F.col("_total")))
    return d.withColumn(out, b.cast("int")).drop("_rank", "_total")


def bucket_economics(df: DataFrame, score: str, net: str = "net", bucket: str = "bucket") -> DataFrame:
    g = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(net).alias("mean_net"))
    ends = g.agg((F.max_by("mean_net", bucket) - F.min_by("mean_net", bucket)).alias("top_minus_bottom"))
    return g.crossJoin(F.broadcast(ends))


def terciles(df: DataFrame, by: Sequence[str], value: str, out: str = "tercile") -> DataFrame:
    """LOW up to the floor(n/3)-th order statistic, MID up to the floor(2n/3)-th, else HIGH."""
    q = order_stats.quantiles(df, by, value, {"_lo": 1 / 3, "_hi": 2 / 3}, "count_floor").drop("n")
    return df.join(F.broadcast(q) if not by else q, list(by)).withColumn(
        out, F.when(F.col(value) <= F.col("_lo"), "LOW").when(F.col(value) <= F.col("_hi"), "MID").otherwise("HIGH")).drop("_lo", "_hi")


def causal_terciles(metrics: DataFrame, at: Sequence[str], value: str, eligible: Column) -> DataFrame:
    """Tercile by rank among eligible symbols of one decision; fewer than three give no tercile."""
    d = metrics.withColumn("_e", F.coalesce(eligible, F.lit(False)))
    n = F.sum(F.col("_e").cast("int")).over(Window.partitionBy(*at))
    r = F.row_number().over(Window.partitionBy(*at).orderBy(F.col("_e").desc(), value, "symbol")) - 1
    name = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"))
    t = F.when(~F.col("_e"), "INSUFFICIENT_HISTORY").when(n < 3, "INSUFFICIENT_CROSS_SECTION").otherwise(
        F.get(name, F.least(F.lit(2), F.floor(F.try_divide(3 * r, n)).cast("int"))))
    return d.withColumn("tercile", t).drop("_e")


def risk_coverage(df: DataFrame, score: str, tie: str, levels: Sequence[float], *aggs: Column) -> DataFrame:
    """Aggregates over the best ceil(n*c) rows for several coverages, one ranked pass."""
    d = scan.ranked(df, [], F.col(score), tie, descending=True)
    keep = [F.when(F.col("_rank") < F.greatest(F.lit(1), F.ceil(F.round(F.col("_total") * c, 9))), F.lit(c)) for c in levels]
    d = d.withColumn("coverage", F.explode(F.array_compact(F.array(*keep))))
    return d.groupBy("coverage").agg(F.count(F.lit(1)).alias("rows"), *aggs)


def best_side_symbol(df: DataFrame, threshold: float) -> DataFrame:
    """Best symbol per side and time, opportunity flag, market and residual move; needs long_net, short_net, move."""
    k = lambda c: F.struct(F.col(c), F.hash("symbol"), F.col("symbol"))
    g = df.groupBy("ts").agg(F.max_by("symbol", k("long_net")).alias("best_long"), F.max("long_net").alias("long_net"),
                             F.max_by("symbol", k("short_net")).alias("best_short"), F.max("short_net").alias("short_net"), F.avg("move").alias("market_move"))
    best = F.greatest("long_net", "short_net")
    return g.withColumns({"opportunity": best >= threshold, "best_side": F.when(F.col("long_net") >= F.col("short_net"), "LONG").otherwise("SHORT"),
                          "residual_move": best - F.abs("market_move")})


# --- similarity -------------------------------------------------------------------------------------

def fit_reference(vectors: DataFrame, ident: str, vec: str, reference: Column) -> DataFrame:
    """One row of arrays: scale over all rows; centre and variance over the reference rows (dimension is bounded)."""
    d = vectors.select(reference.alias("_r"), F.posexplode(vec).alias("p", "x")).withColumn("x", F.col("x").cast("double"))
    g = d.groupBy("p").agg(F.stddev_pop("x").alias("s"), F.avg(F.when(F.col("_r"), F.col("x"))).alias("c"), F.var_pop(F.when(F.col("_r"), F.col("x"))).alias("v"))
    one = lambda c, alt: F.when(F.col(c) > 0, F.col(c)).otherwise(alt)
    g = g.withColumn("s", one("s", F.lit(1.0)))
    g = g.withColumn("v", one("v", F.col("s") * F.col("s")))
    arr = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("p", c))), lambda e: e[c])
    return g.agg(arr("s").alias("_s"), arr("c").alias("_c"), arr("v").alias("_v"))


def similarity(vectors: DataFrame, fit: DataFrame, vec: str) -> DataFrame:
    """Negative standardised Euclid, cosine, negative diagonal-covariance distance, and median |z|."""
    d = vectors.crossJoin(F.broadcast(fit)).withColumn("_x", F.transform(vec, lambda e: e.cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e)
    z = F.zip_with(F.zip_with("_x", "_c", lambda a, b: a - b), "_s", lambda a, s: a / s)
    dist = lambda k: F.zip_with(F.zip_with("_x", "_c", lambda a, b: (a - b) * (a - b)), k, lambda q, s: q / s)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    absz = F.array_sort(F.transform(z, F.abs))
    n = F.size(absz)
    med = (F.get(absz, F.floor((n - 1) / 2).cast("int")) + F.get(absz, F.floor(n / 2).cast("int"))) / 2
    return d.withColumns({
        "euclid": -F.sqrt(total(F.transform(z, lambda e: e * e))), "cosine": div(dot("_x", "_c"), F.sqrt(dot("_x", "_x")) * F.sqrt(dot("_c", "_c"))),
        "diagonal": -F.sqrt(total(dist("_v"))), "median_abs_z": med}).drop("_x", *fit.columns)


# --- scores and policies ---------------------------------------------------------------------------

def entry_score(df: DataFrame, max_q90: float, max_tail: float, w_q90: float, w_tail: float) -> DataFrame:
    """probability * positive return - penalties; needs probability, expected_return, q90, tail, calibrated."""
    d = df.withColumns({"expected_clean": F.col("probability") * F.greatest(F.lit(0.0), F.col("expected_return")),
                        "q90_penalty": w_q90 * F.col("q90"), "tail_penalty": w_tail * F.col("tail")})
    why = F.array_compact(F.array(
        F.when(~F.col("calibrated"), "OPPORTUNITY_CALIBRATION_INVALID"), F.when(F.col("q90").isNull(), "QMAE_INVALID"),
        F.when(F.col("q90") > max_q90, "QMAE_LIMIT_EXCEEDED"), F.when(F.col("tail") > max_tail, "TAIL_RISK_LIMIT_EXCEEDED")))
    return d.withColumns({"score": F.col("expected_clean") - F.coalesce("q90_penalty", F.lit(0.0)) - F.col("tail_penalty"), "reasons": F.array_join(why, "|"), "eligible": F.size(why) == 0})


def combine_predictors(df: DataFrame, direction_threshold: float) -> DataFrame:
    """Mean over predictors per (ts, symbol), side by threshold, disagreement as population std of the side's probability."""
    g = df.groupBy("ts", "symbol").agg(
        F.count(F.lit(1)).alias("predictors"), F.avg("p_long").alias("p_long"), F.avg("p_short").alias("p_short"), F.stddev_pop("p_long").alias("_dl"),
        F.stddev_pop("p_short").alias("_ds"), F.avg("tail").alias("tail"), F.avg("expected_return").alias("expected_return"), F.avg("quality").alias("quality"))
    top = F.greatest("p_long", "p_short")
    side = F.when(top < direction_threshold, "NO_TRADE").when(F.col("p_long") >= F.col("p_short"), "LONG").otherwise("SHORT")
    d = g.withColumn("side", side)
    edge = F.when(F.col("side") == "LONG", F.col("expected_return")).when(F.col("side") == "SHORT", -F.col("expected_return")).otherwise(0.0)
    return d.withColumns({"score": clip(F.col("quality") * F.greatest(F.lit(0.0), edge), 0.0, 1.0),
                          "disagreement": F.when(F.col("side") == "LONG", F.col("_dl")).otherwise(F.col("_ds"))}).drop("_dl", "_ds")


def relative_quality(df: DataFrame) -> DataFrame:
    """Mid-rank percentiles within a candidate set; needs opportunity, danger, net_mean, mfe_q50, mae_q90."""
    d = scan.dealt(df, ["ts"]).withColumn("path_efficiency", F.col("mfe_q50") / (F.col("mfe_q50") + F.col("mae_q90") + 0.001))
    d = d.withColumns({"opportunity_pct": mid_rank("opportunity", single=1.0), "danger_pct": mid_rank("danger", lower_is_better=True, single=1.0),
                       "net_pct": mid_rank("net_mean", single=1.0), "path_pct": mid_rank("path_efficiency", single=1.0)})
    return d.withColumn("quality", (F.col("opportunity_pct") + F.col("danger_pct") + F.col("net_pct") + F.col("path_pct")) / 4)


def bounds_score(df: DataFrame, z: float, heads: Sequence[Sequence[str]] = (("success", "net", "mae", "speed", "certainty"),)) -> DataFrame:
    """Conservative bounds per head and the product over each head subset.

    Needs success, net, mae, time and their *_unc columns, atr, adverse.
    """
    d = df.withColumns({
        "success_lower": F.greatest(F.lit(0.0), F.col("success") - z * F.col("success_unc")), "net_lower": F.col("net") - z * F.col("net_unc"),
        "mae_upper": F.greatest(F.lit(0.0), F.col("mae") + z * F.col("mae_unc")), "time_upper": F.greatest(F.lit(0.0), F.col("time") + z * F.col("time_unc"))})
    cap = lambda e: F.least(F.lit(1.0), e)
    unc = F.greatest(cap(F.col("success_unc") / 0.5), cap(div("net_unc", "atr")), cap(div("mae_unc", "adverse")), cap(F.col("time_unc")))
    d = d.withColumns({"_success": F.col("success_lower"), "_net": 1 / (1 + F.exp(-clip(div("net_lower", "atr"), -30.0, 30.0))),
                       "_mae": F.exp(-div("mae_upper", "adverse")), "_speed": F.greatest(F.lit(0.0), 1 - cap(F.col("time_upper"))), "_certainty": 1 - unc})
    out = {}
    for hs in heads:
        e = F.lit(1.0)
        for h in hs:
            e = e * F.col(f"_{h}")
        out["score_" + "_".join(hs)] = e
    return d.withColumns(out).drop("_success", "_net", "_mae", "_speed", "_certainty")


def policies(df: DataFrame, masks: dict[str, Column], *aggs: Column) -> DataFrame:
    """Each row counts once in every policy that admits it; one scan for all policies."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in masks.items()]))
    return df.withColumn("policy", F.explode(names)).groupBy("policy").agg(F.count(F.lit(1)).alias("n"), *aggs)


def js_divergence(p: Column, q: Column, eps: float = 1e-12) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e)
    kl = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * F.log((x + eps) / ((x + y) / 2 + eps))))
    return 0.5 * (kl(p, q) + kl(q, p))


def consensus(p: Column, q: Column, max_divergence: float) -> dict[str, Column]:
    js = js_divergence(p, q)
    top = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    return {"divergence": js, "agree": top(p) == top(q), "blend_top": F.array_max(F.zip_with(p, q, lambda a, b: (a + b) / 2)),
            "eligible": (top(p) == top(q)) & (js <= max_divergence)}
