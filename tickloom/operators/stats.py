"""Aggregates and statistics.  Exact by default; ranks and running values are skew-free (see ``scan``)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DAY, HOUR, div, flag, hash60
from . import order_stats, scan

Z95 = 1.959963984540054


def n_(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


def _by(df, by):
    return df.groupBy(*by)


# --- economics --------------------------------------------------------------------------------------

def profit_factor(gain: Column, loss: Column, rule: str) -> Column:
    """Rules for a zero loss: inf, inf_or_zero (no gain gives 0), null, zero, cap99, cap1e9, eps."""
    pf = div(gain, F.nullif(loss, F.lit(0.0)))
    z = {"inf": F.lit(float("inf")), "inf_or_zero": F.when(gain > 0, float("inf")).otherwise(0.0), "null": F.lit(None).cast("double"), "zero": F.lit(0.0),
         "cap99": F.when(gain > 0, 99.0).otherwise(0.0), "cap1e9": F.when(gain > 0, 1e9).otherwise(0.0), "eps": F.when(gain > 0, gain / 2.220446049250313e-16).otherwise(0.0)}[rule]
    return F.when(loss > 0, pf).otherwise(z)


def gain_loss(c: str) -> tuple[Column, Column]:
    return F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col(c) < 0, -F.col(c))), F.lit(0.0))


def economic_summary(df: DataFrame, col: str, by: Sequence[str] = (), pf_rule: str = "inf_or_zero") -> DataFrame:
    """Two-level aggregate: per symbol first, so shares and positive symbols need no second scan."""
    g, l = gain_loss(col)
    s = df.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("_n"), F.sum(col).alias("_s"), g.alias("_g"), l.alias("_l"), n_(F.col(col) > 0).alias("_w"), F.sum("mae").alias("_a"), F.sum("mfe").alias("_f"))
    t = _by(s, by).agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_g").alias("_g"), F.sum("_l").alias("_l"), F.sum("_w").alias("_w"), F.sum("_a").alias("_a"), F.sum("_f").alias("_f"), F.max("_n").alias("_m"), n_(F.col("_s") > 0).alias("positive_symbols"))
    return t.select(*by, "n", (F.col("_s") / F.col("n")).alias("expectancy"), profit_factor(F.col("_g"), F.col("_l"), pf_rule).alias("profit_factor"), (F.col("_w") / F.col("n")).alias("win_rate"),
                    (F.col("_a") / F.col("n")).alias("mean_mae"), (F.col("_f") / F.col("n")).alias("mean_mfe"), (F.col("_m") / F.col("n")).alias("max_symbol_share"), "positive_symbols")


def cvar(df: DataFrame, col: str, p: float, by: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Mean of the worst ceil(p*n) rows."""
    d = scan.ranked(df.select(*by, col, tie), by, F.col(col), tie)
    d = d.filter(F.col("_rank") < F.greatest(F.lit(1), F.ceil(F.round(F.col("_total") * p, 9))))
    return _by(d, by).agg(F.count(F.lit(1)).alias("tail_rows"), F.avg(col).alias("cvar"))


def expected_shortfall(df: DataFrame, col: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the values at or below the type-7 quantile (a different rule from ``cvar``)."""
    q = order_stats.quantiles(df, by, col, {"_q": p}).drop("n")
    d = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    return _by(d.filter(F.col(col) <= F.col("_q")), by).agg(F.max("_q").alias("cut"), F.avg(col).alias("shortfall"))


def max_drawdown(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), slice_width: int = HOUR) -> DataFrame:
    """Largest fall of the running sum below its running peak (the start counts as 0).

    Each slice reduces to total, highest and lowest prefix and inner drawdown; the
    slice table combines them, so no key is walked in one task.
    """
    by = list(by)
    d = df.select(*by, *order, F.col(col).alias("_x")).withColumn("_slice", scan.bucket_no(order[0], slice_width))
    w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(scan.UP, 0)
    d = d.withColumn("_c", F.sum("_x").over(w)).withColumn("_p", F.max("_c").over(w))
    s = d.groupBy(*by, "_slice").agg(F.sum("_x").alias("_t"), F.max("_c").alias("_hi"), F.min("_c").alias("_lo"), F.max(F.col("_p") - F.col("_c")).alias("_dd"), F.count(F.lit(1)).alias("_n"))
    ws = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(scan.UP, -1)
    s = s.withColumn("_off", F.coalesce(F.sum("_t").over(ws), F.lit(0.0))).withColumn("_pk", F.col("_off") + F.col("_hi"))
    s = s.withColumn("_before", F.greatest(F.lit(0.0), F.max("_pk").over(ws)))
    return _by(s, by).agg(F.greatest(F.lit(0.0), F.max("_dd"), F.max(F.col("_before") - F.col("_off") - F.col("_lo"))).alias("max_drawdown"), F.sum("_t").alias("total"), F.sum("_n").alias("n"))


def sortino(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    neg = F.when(F.col(col) < 0, F.col(col))
    g = _by(df, by).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("_m"), F.stddev_pop(neg).alias("_s"), F.count(neg).alias("negatives"))
    return g.withColumn("sortino", F.when((F.col("negatives") > 1) & (F.col("_s") > 0), div("_m", "_s"))).drop("_m", "_s")


# --- time blocks -----------------------------------------------------------------------------------------

def _dense_ts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct times with 0-based position and their number."""
    t = scan.row_index(df.select(ts).distinct(), [], [ts], "_k", HOUR, most=scan.MOST)
    return t.crossJoin(F.broadcast(df.agg(F.count_distinct(ts).alias("_n"))))


def temporal_thirds(df: DataFrame, col: str, variant: str, order: Sequence[str] = ("ts", "symbol", "id"), by=()) -> DataFrame:
    """rows: index*n//3 cuts; split: first blocks one longer; boundary: cuts at times n//3 and 2n//3."""
    if variant == "rows":
        return equal_folds(df, 3, col, order).withColumnRenamed("fold", "third")
    t = _dense_ts(df)
    k, n = F.col("_k"), F.col("_n")
    if variant == "split":
        q, r = F.floor(n / 3), n % 3
        big = r * (q + 1)
        third = F.when(k < big, F.floor(F.try_divide(k, q + 1))).otherwise(r + F.floor(F.try_divide(k - big, F.greatest(q, F.lit(1)))))
    else:
        third = F.when(k < F.floor(n / 3), 0).when(k < F.floor(2 * n / 3), 1).otherwise(2)
    d = df.join(t.select("ts", (third + 1).cast("int").alias("third")), "ts")
    return d.groupBy("third").agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"))


def equal_folds(df: DataFrame, k: int, col: str, order: Sequence[str]) -> DataFrame:
    """Fold f holds rows n*f//k up to n*(f+1)//k in order; mean and sign per fold."""
    d = scan.row_index(df, [], list(order), "_r", HOUR, total="_total", most=scan.MOST)
    f = F.floor(((F.col("_r") + 1) * k - 1) / F.col("_total")) + 1
    g = d.groupBy(f.cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"))
    return g.withColumn("positive", F.col("mean") > 0)


# --- intervals -------------------------------------------------------------------------------------------

def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    p = div(k, n)
    d = 1 + Z95 * Z95 / n
    c = (p + Z95 * Z95 / (2 * n)) / d
    m = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / d
    return c - m, c + m


def wilson_ci(df: DataFrame, by: Sequence[str], success: Column) -> DataFrame:
    g = _by(df, by).agg(n_(success).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"rate": div("k", "n"), "lower": lo, "upper": hi})


def cluster_mean_ci(df: DataFrame, col: str, unit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of unit means +- 1.96 * sample std / sqrt(units)."""
    u = df.groupBy(*by, unit.alias("_u")).agg(F.avg(col).alias("_m"))
    g = _by(u, by).agg(F.count(F.lit(1)).alias("units"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("_s"))
    m = F.when(F.col("units") > 1, Z95 * F.col("_s") / F.sqrt("units"))
    return g.withColumns({"lower": F.col("mean") - m, "upper": F.col("mean") + m}).drop("_s")


# --- resampling ---------------------------------------------------------------------------------------------

def draw(seed: str, *parts) -> Column:
    """Reproducible 60-bit draw from a seed and key columns."""
    return hash60(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def blocks(df: DataFrame, unit: Column, col: str) -> DataFrame:
    """Sufficient statistics per block with a dense 0-based index ``_b`` and the block count ``_k``."""
    x = F.col(col)
    b = df.groupBy(unit.cast("long").alias("block")).agg(F.sum(x).alias("s"), F.count(F.lit(1)).alias("c"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("g"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("l"))
    return scan.pin(scan.row_index(b, [], ["block"], "_b", 4096, total="_k"))


def bootstrap_draws(b: DataFrame, reps: int, seed: str) -> DataFrame:
    """reps x blocks picks joined to the block statistics by index, reduced per repetition."""
    k = b.select("_k").limit(1)
    d = b.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(k)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    d = d.select("rep", (draw(seed, F.col("rep"), F.col("j")) % F.col("_k")).alias("_b"))
    m = d.join(b.select("_b", "s", "c", "g", "l"), "_b")
    return m.groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("g").alias("g"), F.sum("l").alias("l"), F.avg(F.col("s") / F.col("c")).alias("mean_of_means"))


def block_bootstrap(df: DataFrame, unit: Column, col: str, reps: int, seed: str, mode: str = "pooled", pf_kind: str = "inverted_cdf") -> DataFrame:
    """Percentile interval of the mean and the profit factor over resampled blocks, P(mean <= 0) with +1 correction."""
    d = bootstrap_draws(blocks(df, unit, col), reps, seed)
    d = d.withColumns({"m": F.col("s") / F.col("c") if mode == "pooled" else F.col("mean_of_means"), "pf": profit_factor(F.col("g"), F.col("l"), "inf_or_zero")})
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY pf)")
    return d.agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.5)).alias("median"), F.percentile("m", F.lit(0.975)).alias("upper"), disc(0.025).alias("pf_lower"), disc(0.975).alias("pf_upper"),
                 ((n_(F.col("m") <= 0) + 1) / (F.count(F.lit(1)) + 1)).alias("p_not_positive"))


def prefix_sums(df: DataFrame, cols: dict[str, Column], order: Sequence[str], slice_width: int = HOUR) -> DataFrame:
    """Exclusive running sums P_name and the row position ``_r``; one extra last row holds the totals."""
    d = df.select(*order, *[c.cast("double").alias(n) for n, c in cols.items()])
    d = scan.prefix_scan(d, [], list(order), {**{f"P_{n}": ("sum", n) for n in cols}, "_r": ("count", F.lit(1))}, slice_width, most=scan.MOST)
    out = d.select(F.col("_r"), *[f"P_{n}" for n in cols])
    zero = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("_r"), *[F.lit(0.0).alias(f"P_{n}") for n in cols])
    return out.unionByName(zero)


def moving_block(df: DataFrame, col: str, size: int, reps: int, seed: str, order: Sequence[str]) -> DataFrame:
    """Overlapping row blocks until n rows, the last cut short; a block is a difference of two running sums."""
    x = F.col(col)
    p = scan.pin(prefix_sums(df, {"s": x, "g": F.greatest(x, F.lit(0.0)), "l": F.greatest(-x, F.lit(0.0))}, order))
    n = p.agg(F.max("_r").alias("_n"))
    d = df.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n))
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / size) - 1)))
    d = d.withColumn("a", draw(seed, F.col("rep"), F.col("j")) % F.greatest(F.lit(1), F.col("_n") - size + 1))
    d = d.withColumn("b", F.col("a") + F.least(F.lit(size), F.col("_n") - F.col("j") * size))
    at = lambda k, t: p.select(F.col("_r").alias(k), *[F.col(f"P_{c}").alias(f"{t}{c}") for c in "sgl"])
    d = d.join(at("a", "x"), "a").join(at("b", "y"), "b")
    m = d.groupBy("rep").agg(*[F.sum(F.col(f"y{c}") - F.col(f"x{c}")).alias(c) for c in "sgl"], F.max("_n").alias("_n"))
    m = m.withColumns({"m": F.col("s") / F.col("_n"), "pf": profit_factor(F.col("g"), F.col("l"), "null")})
    return m.agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"), F.percentile("pf", F.lit(0.025)).alias("pf_lower"), F.percentile("pf", F.lit(0.975)).alias("pf_upper"))


def calendar_bootstrap(df: DataFrame, col: str, reps: int, seed: str, first_day: int, days: int, block_days: int = 7, year: int = 365) -> DataFrame:
    """Blocks of ``block_days`` days from any start laid on a synthetic year; days past its end are cut.

    ``first_day`` is the first calendar day number, ``days`` the length of the source.
    """
    from ..functions.scalars import day_no

    daily = df.withColumn("_d", day_no("ts") - first_day).filter(F.col("_d").between(0, days - 1)).groupBy("_d").agg(F.sum(col).alias("s"), F.count(F.lit(1)).alias("c"))
    d = df.sparkSession.range(reps).withColumnRenamed("id", "rep").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(-(-year // block_days) - 1))))
    d = d.withColumn("_st", draw(seed, F.col("rep"), F.col("j")) % (days - block_days + 1)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block_days - 1))))
    d = d.filter(F.col("j") * block_days + F.col("_o") < year).withColumn("_d", F.col("_st") + F.col("_o"))
    m = d.join(daily, "_d", "left").groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).withColumn("m", F.coalesce(div("s", "c"), F.lit(0.0)))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY m)")
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.5)).alias("median"), disc(0.05).alias("p5"), disc(0.95).alias("p95"))


def circular_shift(df: DataFrame, fold: str, week: str, value: str, other: str, shifts: int, seed: str) -> DataFrame:
    """Weekly series of ``value`` shifted circularly against ``other`` inside each fold, statistic per shift (0 is observed)."""
    w = df.groupBy(fold, week).agg(F.avg(value).alias("v"), F.avg(other).alias("o"))
    w = scan.pin(scan.row_index(w, [fold], [week], "_i", 520, total="_n"))
    s = w.select(fold, "_n").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(shifts))))
    s = s.withColumn("_s", F.when(F.col("rep") == 0, 0).otherwise(1 + draw(seed, F.col(fold), F.col("rep")) % F.greatest(F.lit(1), F.col("_n") - 1)))
    a = w.select(fold, "_i", "v").join(s, fold).withColumn("_i", (F.col("_i") + F.col("_s")) % F.col("_n"))
    m = a.join(w.select(fold, "_i", "o"), [fold, "_i"])
    return m.groupBy("rep").agg(F.corr("v", "o").alias("statistic"), F.count(F.lit(1)).alias("weeks"))


def _holding(counts: DataFrame, digit: str) -> DataFrame:
    """Per rep, the digit whose rows hold the k-th of counts(rep, digit, n, k), and k within it."""
    w = Window.partitionBy("rep").orderBy(digit).rowsBetween(scan.UP, 0)
    c = counts.withColumn("_upto", F.sum("_c").over(w))
    return c.filter((F.col("_upto") - F.col("_c") < F.col("_k")) & (F.col("_k") <= F.col("_upto"))).withColumn("_k", F.col("_k") - F.col("_upto") + F.col("_c")).select("rep", digit, "_k")


def random_coverage(df: DataFrame, keep: float, reps: int, seed: str, col: str = "net", ident: str = "id", bits: int = 12) -> DataFrame:
    """Permutation baseline: the rows with the smallest round(keep*n) hash ranks per repetition.

    The last row kept is found by radix selection: counts by the first ``bits`` of the 60-bit hash, then by the next, leave a
    few of n rows to be put in order.  Rows are never shuffled once a repetition: what moves is at most 2^bits counts a
    repetition and task, and those few rows.
    """
    d = df.select(F.col(ident).alias("_id"), F.col(col).alias("_x")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_h", draw(seed, F.col("rep"), F.col("_id")))
    d = d.withColumns({"_d1": F.shiftright("_h", 60 - bits), "_d2": F.shiftright("_h", 60 - 2 * bits)})
    whole = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(col).alias("_all"), n_(F.col(col) <= 0).alias("_bad"))
    k = whole.select(F.greatest(F.lit(1), F.bround(F.col("_n") * keep)).cast("long").alias("_k"))
    one = _holding(d.groupBy("rep", "_d1").agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(k)), "_d1")
    in_one = d.join(F.broadcast(one), ["rep", "_d1"])  # one row a repetition
    two = _holding(in_one.groupBy("rep", "_d2", "_k").agg(F.count(F.lit(1)).alias("_c")), "_d2")
    rest = d.join(F.broadcast(two), ["rep", "_d2"]).withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("_h", "_id")))
    last = rest.filter("_r = _k").select("rep", F.struct("_h", "_id").alias("_last"))
    kept = F.struct("_h", "_id") <= F.col("_last")
    g = d.join(F.broadcast(last), "rep").crossJoin(F.broadcast(whole)).groupBy("rep")
    return g.agg(F.avg(F.when(kept, F.col("_x"))).alias("net"), (n_(~kept & (F.col("_x") <= 0)) / F.max("_bad")).alias("bad_rejected"), (F.sum(F.when(kept, F.col("_x"))) - F.max("_all")).alias("guard_value"))


# --- multiple testing, association --------------------------------------------------------------------------

RANKS = 65_536


def _tests(df: DataFrame, p: str, ident: str) -> DataFrame:
    """df with the rank ``_r`` (from 1) of each test by (p, ident), and their number ``_n``."""
    part = F.coalesce(F.floor(F.col(p) * 4096), F.lit(-1)).cast("long")
    return scan.row_index(df, [], [p, ident], "_r", slice_col=part, total="_n", most=RANKS).withColumn("_r", F.col("_r") + 1)


def bh(df: DataFrame, p: str, ident: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg accept set and adjusted p.  The running minimum comes from the far end, over slices of RANKS tests."""
    d = _tests(df, p, ident).withColumn("_back", -F.col("_r"))
    cut = d.agg(F.max(F.when(F.col(p) <= alpha * F.col("_r") / F.col("_n"), F.col("_r"))).alias("_cut"))
    d = scan.prefix_scan(d, [], ["_back"], {"bh_adjusted": ("min", F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_r")))}, RANKS)
    d = d.crossJoin(F.broadcast(cut))  # one row
    return d.withColumn("accepted", F.coalesce(F.col("_r") <= F.col("_cut"), F.lit(False))).select(*df.columns, "accepted", "bh_adjusted")


def holm(df: DataFrame, p: str, ident: str, alpha: float = 0.05) -> DataFrame:
    """Holm's adjusted p and reject set, by a running maximum and minimum over slices of RANKS tests."""
    d = _tests(df, p, ident).withColumn("_m", F.col("_n") - F.col("_r") + 1)
    d = scan.prefix_scan(d, [], ["_r"], {"holm_adjusted": ("max", F.least(F.lit(1.0), F.col("_m") * F.col(p))), "_ok": ("min", (F.col(p) <= alpha / F.col("_m")).cast("int"))}, RANKS)
    return d.select(*df.columns, "holm_adjusted", (F.col("_ok") == 1).alias("rejected"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """NULL under three rows or without variance."""
    g = _by(df, by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("_c"), F.var_pop(x).alias("_x"), F.var_pop(y).alias("_y"))
    return g.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("_x") > 0) & (F.col("_y") > 0), F.col("_c")).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    d = order_stats.average_rank(df.select(*by, x, y), by, x, "_rx")
    d = order_stats.average_rank(d, by, y, "_ry")
    return _by(d, by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def mean_spearman_by_ts(df: DataFrame, x: str, y: str, min_rows: int = 3) -> DataFrame:
    """Mean of the per-timestamp rank correlations (a cross section is bounded by the universe)."""
    from .panel import pct_rank

    d = df.withColumns({"_rx": pct_rank(x), "_ry": pct_rank(y)})
    g = d.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"), F.corr("_rx", "_ry").alias("_c"), F.var_pop("_rx").alias("_vx"), F.var_pop("_ry").alias("_vy"))
    g = g.filter((F.col("_n") >= min_rows) & (F.col("_vx") > 0) & (F.col("_vy") > 0))
    return g.agg(F.count(F.lit(1)).alias("timestamps"), F.avg("_c").alias("mean_ic"), F.avg(flag(F.col("_c") > 1e-12)).alias("positive_share"))


def threshold_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the best down: cumulative positives and rows."""
    by = list(by)
    vc = scan.pin(df.groupBy(*by, score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_c")).withColumn("_ns", -F.col(score)))
    return scan.prefix_scan(vc, by, ["_ns"], {"_tp": ("sum", "_p"), "_all": ("sum", "_c")}, slice_col=scan.log_slice(F.col("_ns").cast("double")), totals={"_np": "_tp", "_n": "_all"})


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """ROC AUC with tie credit, average precision, precision and recall at ``cut``, from one cumulative pass."""
    d = threshold_counts(df, score, label, by)
    neg, prior_neg = F.col("_c") - F.col("_p"), F.col("_all") - F.col("_tp") - (F.col("_c") - F.col("_p"))
    # positives of this score beat the negatives below it and half of those at it
    below = (F.col("_n") - F.col("_np")) - prior_neg - neg
    hit = F.col(score) >= cut
    g = _by(d, by).agg(F.max("_np").alias("_np"), F.max("_n").alias("n"), F.sum(F.col("_p") * (below + neg / 2.0)).alias("_u"), F.sum(div(F.col("_p") * F.col("_tp"), F.col("_all"))).alias("_ap"),
                       F.sum(F.when(hit, F.col("_p"))).alias("_hp"), F.sum(F.when(hit, F.col("_c"))).alias("_hc"))
    return g.select(*by, "n", F.col("_np").alias("positives"), div("_u", F.col("_np") * (F.col("n") - F.col("_np"))).alias("auc"), div("_ap", "_np").alias("average_precision"),
                    F.coalesce(div("_hp", "_hc"), F.lit(0.0)).alias("precision_at_cut"), F.coalesce(div("_hp", "_np"), F.lit(0.0)).alias("recall_at_cut"))


def reliability(df: DataFrame, prob: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(label).alias("rate"))


def probability_metrics(df: DataFrame, prob: str, label: str, bins: int = 10, by: Sequence[str] = (), eps: float = 1e-12) -> DataFrame:
    """Brier, log loss and ECE (last bin closed) from one binned aggregate."""
    p, y = F.col(prob), F.col(label)
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    b = F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")
    g = df.groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"), F.sum((p - y) * (p - y)).alias("_br"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("_ll"))
    return _by(g, by).agg(F.sum("_n").alias("n"), (F.sum("_br") / F.sum("_n")).alias("brier"), (F.sum("_ll") / F.sum("_n")).alias("log_loss"), (F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"), (F.sum("_y") / F.sum("_n")).alias("prevalence"))


def equal_frequency_ece(df: DataFrame, prob: str, label: str, tie: str, bins: int = 10) -> DataFrame:
    from .panel import buckets

    d = buckets(df.select(prob, label, tie), prob, [tie], bins)
    g = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.avg(prob).alias("_p"), F.avg(label).alias("_y"))
    return g.agg(F.sum("_n").alias("n"), (F.sum(F.abs(F.col("_p") - F.col("_y")) * F.col("_n")) / F.sum("_n")).alias("ece"))


def pinball(df: DataFrame, q: str, y: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """Pinball loss, coverage, baseline loss at the group's own quantile."""
    loss = lambda pred: F.when(F.col(y) >= pred, level * (F.col(y) - pred)).otherwise((1 - level) * (pred - F.col(y)))
    base = order_stats.quantiles(df, by, y, {"_q": level}).drop("n")
    d = df.join(base, list(by)) if by else df.crossJoin(F.broadcast(base))
    return _by(d, by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss(F.col(q))).alias("pinball"), F.avg(loss(F.col("_q"))).alias("baseline"), F.avg(flag(F.col(y) <= F.col(q))).alias("coverage"))


def conformal(df: DataFrame, q: str, y: str, level: float, tie: str) -> DataFrame:
    """Residual of 0-based rank ceil((n+1)*level)-1 (the last one if beyond)."""
    d = df.select((F.col(y) - F.col(q)).alias("_e"), tie)
    d = scan.ranked(d, [], F.col("_e"), tie)
    k = F.least(F.ceil(F.round((F.col("_total") + 1) * level, 9)) - 1, F.col("_total") - 1)
    return d.filter(F.col("_rank") == k).select(F.col("_total").alias("n"), F.col("_e").alias("adjustment"))


def class_metrics(df: DataFrame, pred: str, true: str, classes: Sequence[str]) -> DataFrame:
    """Confusion counts per class and macro precision, recall, F1."""
    conf = df.groupBy(pred, true).agg(F.count(F.lit(1)).alias("_n"))
    cs = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    d = conf.crossJoin(F.broadcast(cs)).groupBy("class").agg(*[F.coalesce(F.sum(F.when(e, F.col("_n"))), F.lit(0)).alias(n) for n, e in {
        "tp": (F.col(pred) == F.col("class")) & (F.col(true) == F.col("class")), "fp": (F.col(pred) == F.col("class")) & (F.col(true) != F.col("class")),
        "fn": (F.col(pred) != F.col("class")) & (F.col(true) == F.col("class"))}.items()])
    z = lambda a, b: F.coalesce(div(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    d = d.withColumns({"precision": z(F.col("tp"), F.col("tp") + F.col("fp")), "recall": z(F.col("tp"), F.col("tp") + F.col("fn"))})
    d = d.withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    w = Window.partitionBy(F.lit(0))
    return d.withColumns({f"macro_{c}": F.avg(c).over(w) for c in ("precision", "recall", "f1")})


def feature_separation(df: DataFrame, names: Sequence[str], good: str) -> DataFrame:
    """Each feature against a 0/1 label: difference of medians over the pooled population deviation, rank-biserial, and the
    two-sided Mann-Whitney p-value (normal approximation with tie and continuity correction).

    NULL where a class is empty or the feature does not vary.
    """
    long = scan.pin(df.select(F.col(good).alias("_y"), *names).unpivot(["_y"], list(names), "feature", "v").filter("v is not null and _y in (0, 1)"))
    q = order_stats.quantiles(long, ["feature", "_y"], "v", {"m": 0.5})
    med = q.groupBy("feature").agg(F.max(F.when(F.col("_y") == 1, F.col("m"))).alias("_g"), F.max(F.when(F.col("_y") == 0, F.col("m"))).alias("_b"))
    spread = long.groupBy("feature").agg(F.stddev_pop("v").alias("_s"), F.sum(F.col("_y").cast("double")).alias("_n1"), F.sum(1.0 - F.col("_y")).alias("_n0"))
    ties = long.groupBy("feature", "v").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy("feature").agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_t3"))
    auc = ranking_metrics(long, "v", "_y", ["feature"]).select("feature", "auc")
    d = med.join(spread, "feature").join(auc, "feature", "left").join(ties, "feature")
    n, prod = F.col("_n1") + F.col("_n0"), F.col("_n1") * F.col("_n0")
    sd = F.sqrt(prod / 12 * (n + 1 - F.col("_t3") / (n * (n - 1))))
    z = (F.abs(F.col("auc") * prod - prod / 2) - 0.5) / sd
    return d.select("feature", div(F.col("_g") - F.col("_b"), F.nullif(F.col("_s"), F.lit(0.0))).alias("median_difference"), (2 * F.col("auc") - 1).alias("rank_biserial"),
                    F.when((prod > 0) & (sd > 0), F.least(F.lit(1.0), _two_sided(z))).alias("mann_whitney_p"))


def _two_sided(z: Column) -> Column:
    """P(|N| > z) for a standard normal N, by the Abramowitz-Stegun 7.1.26 form of erfc (error below 1.5e-7)."""
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def value_bins(df: DataFrame, feature: str, n: int = 10) -> DataFrame:
    """Rows with ``bin``: n quantile bins closed above, equal edges merged, the lowest value in the first bin."""
    edges = order_stats.quantiles(df.filter(F.col(feature).isNotNull()).withColumn("_all", F.lit(0)), ["_all"], feature, {f"q{i}": i / n for i in range(n + 1)})
    e = edges.select(F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n + 1)]))).alias("_edges"))  # one row
    d = df.filter(F.col(feature).isNotNull()).crossJoin(F.broadcast(e))
    below = F.size(F.filter("_edges", lambda x: x < F.col(feature)))
    return d.withColumn("bin", F.greatest(below - 1, F.lit(0))).drop("_edges")


def decile_monotonicity(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Correlation of bin number and label rate over value deciles with merged edges; NULL under two bins or without variation."""
    g = value_bins(df.select(feature, label), feature).groupBy("bin").agg(F.avg(label).alias("_y"))
    return g.agg(F.when((F.count(F.lit(1)) >= 2) & (F.count_distinct("_y") > 1), F.corr(F.col("bin").cast("double"), "_y")).alias("monotonicity"))


def binned_mutual_information(df: DataFrame, names: Sequence[str], label: str, n: int = 10) -> DataFrame:
    """Mutual information in nats of each feature's value bins with a label, from one grouped count over all rows."""
    out = None
    for name in names:
        c = value_bins(df.select(name, label), name, n).groupBy("bin", label).agg(F.count(F.lit(1)).cast("double").alias("_c"))
        c = c.select(F.lit(name).alias("feature"), "bin", F.col(label).alias("_l"), "_c")
        out = c if out is None else out.unionByName(c)
    w = lambda *k: Window.partitionBy("feature", *k)  # at most n bins per label value
    p = out.withColumns({"_n": F.sum("_c").over(w()), "_b": F.sum("_c").over(w("bin")), "_y": F.sum("_c").over(w("_l"))})
    return p.groupBy("feature").agg(F.sum(F.col("_c") / F.col("_n") * F.log(F.col("_c") * F.col("_n") / (F.col("_b") * F.col("_y")))).alias("mutual_information"))


# --- breakdowns ------------------------------------------------------------------------------------------------

def label_alignment(df: DataFrame, labels: Sequence[str], net: str, dims: Sequence[str]) -> DataFrame:
    """Per label and one-way dimension: prevalence, economics inside and outside, recall of positive utility, lift.

    One scan: labels melt to rows and GROUPING SETS cover all dimensions at once.
    """
    d = df.select(net, *dims, F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).cast("int").alias("on")) for l in labels])).alias("_l")).select(net, *dims, "_l.*")
    sets = [[F.col("label")]] + [[F.col("label"), F.col(c)] for c in dims]
    x, on = F.col(net), F.col("on") == 1
    g = d.groupingSets(sets, "label", *dims).agg(
        F.count(F.lit(1)).alias("n"), F.avg("on").alias("prevalence"), F.avg(F.when(on, x)).alias("selected_mean"), F.avg(F.when(~on, x)).alias("other_mean"),
        div(n_(on & (x > 0)), F.nullif(n_(x > 0), F.lit(0))).alias("positive_recall"), F.avg(x).alias("_all"), F.grouping_id("label", *dims).alias("_gid"))
    return g.withColumn("lift", F.col("selected_mean") - F.col("_all")).drop("_all", "_gid")


def guard_metrics(df: DataFrame, allowed: Column, net: str, tail: Column, by: Sequence[str] = ()) -> DataFrame:
    x, a = F.col(net), allowed
    b = ~a
    return _by(df, by).agg(
        F.count(F.lit(1)).alias("n"), n_(a).alias("executed"), div(n_(b & (x <= 0)), F.nullif(n_(x <= 0), F.lit(0))).alias("bad_rejected"), div(n_(b & (x > 0)), F.nullif(n_(x > 0), F.lit(0))).alias("good_destroyed"),
        div(n_(b & tail), F.nullif(n_(tail), F.lit(0))).alias("tail_rejected"), F.sum(F.when(b & (x <= 0), -x).otherwise(0.0)).alias("loss_avoided"), F.sum(F.when(b & (x > 0), x).otherwise(0.0)).alias("profit_destroyed"),
        F.sum(F.when(b, -x).otherwise(0.0)).alias("net_guard_value"), (F.sum(F.when(a, x).otherwise(0.0)) / F.count(F.lit(1))).alias("per_signal"), F.avg(F.when(a, x)).alias("per_executed"))


def baseline_slices(train: DataFrame, val: DataFrame, net: str, volatility: str, persistence: Column, seed: str, ident: str = "id") -> DataFrame:
    """Unconditional, by side, persistence-filtered, top-decile volatility by the train quantile, hash-random tenth."""
    cut = order_stats.quantiles(train, [], volatility, {"_cut": 0.9}).drop("n")
    d = val.crossJoin(F.broadcast(cut))
    masks = {"UNCONDITIONAL": F.lit(True), "LONG": F.col("side") == "LONG", "SHORT": F.col("side") == "SHORT", "PERSISTENCE": persistence, "TOP_VOLATILITY": F.col(volatility) >= F.col("_cut"), "RANDOM_10": draw(seed, F.col(ident)) % 10 == 0}
    d = d.withColumn("slice", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))))
    return d.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg(net).alias("net"), F.avg(flag(F.col(net) > 0)).alias("win_rate"))


def symbol_scoring(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Probability and ranking metrics per symbol and for ALL: each row counts once for each."""
    d = df.select(prob, label, F.explode(F.array(F.col("symbol"), F.lit("ALL"))).alias("symbol"))
    return probability_metrics(d, prob, label, by=["symbol"]).join(ranking_metrics(d, prob, label, ["symbol"]).select("symbol", "average_precision"), "symbol")


def mse_per_target(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    d = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("target"), ((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).alias("e")) for n, (a, b) in pairs.items()])).alias("x")).select("x.*")
    return d.groupBy("target").agg(F.avg("e").alias("mse"))


def funnel(df: DataFrame, gates: dict[str, Column], net: str) -> DataFrame:
    """Rows reaching and passing each gate in turn, and the economics of pass minus fail."""
    items, reach = [], F.lit(True)
    for i, (n, c) in enumerate(gates.items()):
        ok = F.coalesce(c, F.lit(False))
        items.append(F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("gate"), reach.alias("reached"), ok.alias("ok")))
        reach = reach & ok
    d = df.select(F.col(net).alias("_x"), F.explode(F.array(*items)).alias("g")).select("_x", "g.*")
    r = F.col("reached")
    p, f = r & F.col("ok"), r & ~F.col("ok")
    return d.groupBy("stage", "gate").agg(n_(r).alias("reached"), n_(p).alias("passed"), (F.avg(F.when(p, F.col("_x"))) - F.avg(F.when(f, F.col("_x")))).alias("pass_minus_fail"))


def stability(df: DataFrame, dims: dict[str, Column], net: str) -> DataFrame:
    """Mean per value of each one-way dimension, leave-one-out mean, share of positive values."""
    d = df.select(F.col(net).alias("_x"), F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dims.items()])).alias("k")).select("_x", "k.*")
    g = d.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("_s"))
    w = Window.partitionBy("dimension")
    return g.withColumns({"mean": F.col("_s") / F.col("n"), "leave_one_out": div(F.sum("_s").over(w) - F.col("_s"), F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))), "positive_share": F.avg(flag(F.col("_s") > 0)).over(w)}).drop("_s")


def concentration(df: DataFrame, by: str, net: str) -> DataFrame:
    g = df.groupBy(by).agg(F.sum(F.greatest(F.col(net), F.lit(0.0))).alias("_p"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(div(F.max("_p"), F.nullif(F.sum("_p"), F.lit(0.0))), F.lit(0.0)).alias("concentration"), F.max_by(by, F.struct("_p", by)).alias("top"))


def weighted_economics(df: DataFrame, w: str, net: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted means; break-even cost is the weighted gross mean.  Needs gross, exit_reason."""
    x, k = F.col(net), F.col(w)
    s = lambda e: F.sum(k * e)
    g = _by(df, by).agg(F.count(F.lit(1)).alias("rows"), F.sum(k).alias("weight"), s(x).alias("_x"), s(F.when(x > 0, x).otherwise(0.0)).alias("_g"), s(F.when(x < 0, -x).otherwise(0.0)).alias("_l"), s(flag(x > 0)).alias("_w"),
                        s(flag(F.col("exit_reason") == "STOP")).alias("_st"), s(flag(F.col("exit_reason") == "TARGET")).alias("_tg"), s(F.col("gross")).alias("_gr"))
    r = lambda c: div(c, "weight")
    return g.select(*by, "rows", "weight", r("_x").alias("expectancy"), profit_factor(F.col("_g"), F.col("_l"), "null").alias("profit_factor"), r("_w").alias("win_rate"), r("_st").alias("stop_rate"), r("_tg").alias("target_rate"), r("_gr").alias("break_even_cost"))


def canonical_means(df: DataFrame, ident: str, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(ident).agg(*[F.avg(c).alias(c) for c in cols], *[F.max(c).alias(c) for c in keep])


def candidate_metrics(trades: DataFrame, majors: Sequence[str]) -> DataFrame:
    """Per candidate and scenario: episode-first and trade expectancy, months, symbols, majors against the rest."""
    e = trades.groupBy("candidate", "scenario", "episode").agg(F.sum("net").alias("_s"), F.count(F.lit(1)).alias("_n"), F.collect_set("month").alias("_m"), F.collect_set("symbol").alias("_y"),
                                                               F.sum(F.when(F.col("symbol").isin(*majors), F.col("net"))).alias("_ms"), n_(F.col("symbol").isin(*majors)).alias("_mn"))
    g = e.groupBy("candidate", "scenario").agg(F.count(F.lit(1)).alias("episodes"), F.sum("_n").alias("trades"), F.avg(F.col("_s") / F.col("_n")).alias("episode_expectancy"), (F.sum("_s") / F.sum("_n")).alias("trade_expectancy"),
                                               div(F.sum("_ms"), F.nullif(F.sum("_mn"), F.lit(0))).alias("majors"), div(F.sum("_s") - F.coalesce(F.sum("_ms"), F.lit(0.0)), F.nullif(F.sum("_n") - F.sum("_mn"), F.lit(0))).alias("alts"))
    k = trades.groupBy("candidate", "scenario").agg(F.count_distinct("month").alias("months"), F.count_distinct("symbol").alias("symbols"))
    return g.join(k, ["candidate", "scenario"])


def half_life(df: DataFrame, key: str, age: str, net: str, edges: Sequence[float]) -> DataFrame:
    """Initial edge, first later bucket at half of it, and first cumulative age with a mean at or below zero."""
    bucket = F.array_max(F.array_compact(F.array(*[F.when(F.col(age) >= e, F.lit(i)) for i, e in enumerate(edges[:-1])])))
    b = df.filter((F.col(age) >= edges[0]) & (F.col(age) < edges[-1])).groupBy(key, bucket.alias("b")).agg(F.sum(net).alias("_s"), F.count(F.lit(1)).alias("_n"))
    hi = F.get(F.array(*[F.lit(float(e)) for e in edges[1:]]), F.col("b"))
    w = Window.partitionBy(key).orderBy("b")
    b = b.withColumns({"_m": F.col("_s") / F.col("_n"), "_hi": hi, "_first": F.first("b").over(w), "_init": F.first(F.col("_s") / F.col("_n")).over(w), "_cum": F.sum("_s").over(w.rowsBetween(scan.UP, 0))})
    half = F.when((F.col("_init") > 0) & (F.col("b") > F.col("_first")) & (F.col("_m") <= F.col("_init") / 2), F.col("_hi"))
    return b.groupBy(key).agg(F.max("_init").alias("initial"), F.min(half).alias("half_life"), F.min(F.when(F.col("_cum") <= 0, F.col("_hi"))).alias("economic_lifetime"))


def ttl_sensitivity(df: DataFrame, age: str, net: str, ttls: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    d = df.withColumn("ttl", F.explode(F.array_compact(F.array(*[F.when(F.col(age) < t, F.lit(float(t))) for t in ttls]))))
    return d.groupBy(*by, "ttl").agg(F.count(F.lit(1)).alias("n"), F.avg(net).alias("net"))


def gate(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    d = metrics.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    allok = F.lit(True)
    for n in checks:
        allok = allok & F.col(n)
    return d.withColumn("passed", allok)


def lift(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Candidate minus baseline, long form (family, metric)."""
    st = lambda df, n: df.unpivot(list(keys), list(metrics), "metric", n)
    return st(candidate, "c").join(st(baseline, "b"), [*keys, "metric"]).select(*keys, "metric", (F.col("c") - F.col("b")).alias("lift"))


def trailing_metrics(df: DataFrame, days: int, min_samples: int, value: str, maturity: int, ident: str) -> DataFrame:
    """Per decision and symbol: matured opportunities of the trailing window, after one row per opportunity.

    Prefix sums over the maturity time and two as-of lookups, so long windows do not
    multiply rows; a decision sees only rows matured by then.
    """
    from . import joins

    one = df.groupBy("symbol", ident).agg(F.min("ts").alias("ts"), F.avg(value).alias("_v"))
    ev = one.select("symbol", (F.col("ts") + maturity).alias("ts"), "_v")
    dec = df.select("symbol", "ts").distinct().withColumns({"_lo": F.col("ts") - days * DAY + maturity, "_hi": F.col("ts")})
    d = joins.range_sum(dec, ev, "_lo", "_hi", {"_s": "_v", "_c": F.lit(1.0)}, "[]", by=["symbol"], slice_width=30 * DAY)
    n = F.round("_c").cast("long")
    return d.select("symbol", "ts", n.alias("samples"), F.when(n >= min_samples, div("_s", "_c")).alias("score"), F.when(n >= min_samples, "ELIGIBLE").otherwise("INSUFFICIENT_HISTORY").alias("status"))


def paired_delta(df: DataFrame, policy: str, control: str, unit: Column) -> DataFrame:
    return cluster_mean_ci(df.withColumn("_d", F.col(policy) - F.col(control)), "_d", unit)


def guard_stats(df: DataFrame, score: str, latency: str, verdict: str = "verdict") -> DataFrame:
    """Counts, block rate, score mean/std/p50/p90/p95 and latency p95 for ALL, per symbol and per side in one melt."""
    d = df.select(score, latency, verdict, F.explode(F.array(F.struct(F.lit("ALL").alias("dim"), F.lit("ALL").alias("value")), F.struct(F.lit("symbol").alias("dim"), F.coalesce("symbol", F.lit("")).alias("value")), F.struct(F.lit("side").alias("dim"), F.coalesce("side", F.lit("")).alias("value")))).alias("k")).select(score, latency, verdict, "k.*")
    d = scan.pin(d)
    g = d.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"), n_(F.col(verdict) == "BLOCK").alias("blocked"), F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"))
    q = order_stats.quantiles(d, ["dim", "value"], score, {"p50": 0.5, "p90": 0.9, "p95": 0.95}).drop("n")
    l = order_stats.quantiles(d, ["dim", "value"], latency, {"latency_p95": 0.95}).drop("n")
    return g.join(q, ["dim", "value"]).join(l, ["dim", "value"]).withColumn("block_rate", F.col("blocked") / F.col("n"))


def capture_progress(signals: DataFrame, quality: DataFrame, key: str = "signal_id") -> DataFrame:
    from ..functions.scalars import day_no

    j = signals.join(quality.select(key, "eligible"), key, "left")
    return j.groupBy(day_no("ts").alias("day"), "symbol", "side").agg(F.count(F.lit(1)).alias("signals"), n_(F.col("eligible").isNotNull()).alias("captured"), n_(F.coalesce("eligible", F.lit(False))).alias("eligible"), n_(F.col("eligible").isNull()).alias("pending"))


def assess_entry_quality(df: DataFrame, score: str, forecast: str, net: str, mae: str, tie: str) -> DataFrame:
    """Correlations, top minus bottom tenth and the share of symbols with a negative mean."""
    d = scan.ranked(df, [], F.col(score), tie)
    size = F.greatest(F.lit(1), F.floor(F.col("_total") / 10))
    ends = d.agg(F.corr(score, net).alias("score_return_corr"), F.corr(forecast, mae).alias("forecast_mae_corr"),
                 (F.avg(F.when(F.col("_rank") >= F.col("_total") - size, F.col(net))) - F.avg(F.when(F.col("_rank") < size, F.col(net)))).alias("top_minus_bottom"))
    s = df.groupBy("symbol").agg(F.avg(net).alias("_m")).agg(F.avg(flag(F.col("_m") < 0)).alias("negative_symbol_share"))
    return ends.crossJoin(F.broadcast(s))


def fold_center(df: DataFrame, fold: str, col: str, effect: float = 0.0005) -> DataFrame:
    """Residual around the fold mean, re-based on mean + effect; the mean comes from an aggregate, not a window."""
    m = df.groupBy(fold).agg(F.avg(col).alias("_m"))
    return df.join(m, fold).withColumn("recentred", F.col("_m") + (F.col(col) - F.col("_m")) + effect).drop("_m")
