"""Data quality, contiguity, reconciliation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DAY, finite, flag
from . import scan

def bad_bar(zero: bool = False) -> Column:
    """Non-finite, non-positive or incoherent OHLC, or negative volume; with ``zero`` a price of 0 is allowed."""
    least = F.least("open", "high", "low", "close")
    return ~(finite("open") & finite("high") & finite("low") & finite("close") & finite("volume")) | (
        (least < 0) if zero else (least <= 0)) | (F.col("volume") < 0) | (
        F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def fail_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Rows pass through; an offending row fails the job, also if a later filter would remove it.

    The check is a projected column that counts as non-deterministic, so no filter or join moves below it.
    """
    ok = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.monotonically_increasing_id() >= 0)
    return df.withColumn("_checked", ok).filter("_checked").drop("_checked")


def bar_quality(bars: DataFrame, step: int, version: str | None = None) -> DataFrame:
    """Rows, span, duplicates, gaps, missing bars and invalid rows per symbol.

    Later versions of a bar win (``version`` descending, then the larger values).
    """
    rank = [F.col(version).desc()] if version else [F.col(c).desc() for c in ("close", "open", "high", "low", "volume")]
    w = Window.partitionBy("symbol", "ts").orderBy(*rank)
    d = bars.withColumn("_rn", F.row_number().over(w))
    dup = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("_rn") > 1).cast("long")).alias("duplicates"))
    one = d.filter("_rn = 1")
    one = scan.framed(one, ["symbol"], ["ts"], lambda w: {"_dt": F.col("ts") - F.lag("ts", 1).over(w)}, back=1)
    miss = F.greatest(F.lit(0), F.round(F.col("_dt") / step) - 1)
    body = one.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum((F.col("_dt") > step).cast("long")).alias("gaps"), F.coalesce(F.sum(miss), F.lit(0)).cast("long").alias("missing"),
        F.sum(bad_bar().cast("long")).alias("invalid"))
    return dup.join(body, "symbol").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def segments(bars: DataFrame, step: int, by=("symbol",), valid: Column | None = None, out: str = "segment",
             slice_width: int = DAY, position: str | None = None) -> DataFrame:
    """Segment number (from 1) that grows after every missing or invalid bar; invalid rows are removed.

    ``position`` adds the 0-based place inside the segment from the same scan.
    """
    by = list(by)
    d = bars.filter(valid) if valid is not None else bars
    d = scan.framed(scan.indexed(d, by, ["ts"], slice_width), by, ["ts"], lambda w: {"_brk": F.when(F.col("ts") - F.lag("ts", 1).over(w) == step, 0).otherwise(1)}, back=1)
    d = scan.prefix_scan(d, by, ["ts"], {out: ("sum", "_brk"), "_start": ("last", F.when(F.col("_brk") == 1, F.col("_i")))}, slice_width)
    d = d.withColumn(out, F.col(out).cast("long"))
    if position:
        d = d.withColumn(position, F.col("_i") - F.col("_start"))
    return d.drop("_brk", "_start") if "_i" in bars.columns else d.drop("_brk", "_start", "_i")


def segment_positions(bars: DataFrame, step: int, by=("symbol",)) -> DataFrame:
    """Segment, its size, and the 0-based position inside it."""
    by = list(by)
    d = segments(bars, step, by, position="position")
    sizes = segments(bars.select(*by, "ts"), step, by).groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("segment_size"))
    return d.join(sizes, [*by, "segment"])


def causal_ready(bars: DataFrame, step: int, min_size: int = 301, min_pos: int = 240) -> DataFrame:
    d = segment_positions(bars, step)
    return d.withColumn("causal_ready", (F.col("segment_size") >= min_size) & (F.col("position") >= min_pos))


def contiguous(bars: DataFrame, step: int, n: int, h: int, **kw) -> DataFrame:
    """Exact history and future contiguity by distance, never by interpolation."""
    return scan.framed(bars, ["symbol"], ["ts"], lambda w: {
        "history_ok": F.coalesce(F.col("ts") - F.lag("ts", n).over(w) == n * step, F.lit(False)),
        "future_ok": F.coalesce(F.lead("ts", h).over(w) - F.col("ts") == h * step, F.lit(False))}, back=n, ahead=h, **kw)


def merge_bars(old: DataFrame, new: DataFrame, fail: bool = True) -> DataFrame:
    """Idempotent union; ``status`` is old/new/equal/conflict, a conflict fails unless ``fail`` is off."""
    vals = [c for c in old.columns if c not in ("symbol", "ts")]
    pack = lambda df, n: df.select("symbol", "ts", F.struct(*vals).alias(n))
    j = pack(old, "_o").join(pack(new, "_n"), ["symbol", "ts"], "full_outer")
    status = F.when(F.col("_n").isNull(), "old").when(F.col("_o").isNull(), "new").when(
        F.col("_o").eqNullSafe(F.col("_n")), "equal").otherwise("conflict")
    j = j.withColumn("status", status)
    if fail:
        j = fail_if(j, F.col("status") == "conflict", "unequal overlapping bars")
    return j.select("symbol", "ts", F.coalesce("_o", "_n").alias("_v"), "status").select("symbol", "ts", "_v.*", "status")


def expected_grid(bounds: DataFrame, step: int) -> DataFrame:
    """Every expected bar time for each row of ``bounds(symbol, lo, hi)`` (inclusive)."""
    return bounds.select("symbol", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("ts"))


def gap_fill(primary: DataFrame, secondary: DataFrame, expected: DataFrame) -> DataFrame:
    """Primary wins, secondary fills only missing expected bars; ``source`` tells which, overlap mismatch is flagged."""
    vals = [c for c in primary.columns if c not in ("symbol", "ts")]
    pack = lambda df, n: df.select("symbol", "ts", F.struct(*vals).alias(n))
    j = expected.join(pack(primary, "_p"), ["symbol", "ts"], "left").join(pack(secondary, "_s"), ["symbol", "ts"], "left")
    src = F.when(F.col("_p").isNotNull(), "primary").when(F.col("_s").isNotNull(), "recovered").otherwise("missing")
    return j.select("symbol", "ts", src.alias("source"),
                    (F.col("_p").isNotNull() & F.col("_s").isNotNull() & ~F.col("_p").eqNullSafe(F.col("_s"))).alias("mismatch"),
                    F.coalesce("_p", "_s").alias("_v")).select("symbol", "ts", "source", "mismatch", "_v.*")


def coordinated(panel: DataFrame, n: int | None = None) -> DataFrame:
    """Rows at times when all symbols are present."""
    per = panel.groupBy("ts").agg(F.count_distinct("symbol").alias("_n"))
    if n is None:
        per = per.crossJoin(F.broadcast(panel.agg(F.count_distinct("symbol").alias("_u")))).filter("_n = _u")
    else:
        per = per.filter(F.col("_n") == n)
    return panel.join(per.select("ts"), "ts", "left_semi")


def availability_audit(df: DataFrame, decision: str, required: list[str], forbidden: tuple[str, ...] = ("label", "outcome")) -> DataFrame:
    """Counts of look-ahead, missing availability and non-finite features in one pass."""
    avail = [c for c in df.columns if c.startswith("available_at__")]
    leaks = [c for c in required if any(c.startswith(f) for f in forbidden)]
    if leaks:
        raise ValueError(f"outcome columns among features: {leaks}")
    late = [F.sum((F.col(c) > F.col(decision)).cast("long")) for c in avail]
    null = [F.sum(F.col(c).isNull().cast("long")) for c in avail]
    bad = [F.sum((~finite(c)).cast("long")) for c in required]
    add = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), add(late).alias("late"), add(null).alias("unavailable"), add(bad).alias("nonfinite"))


def assert_causal(df: DataFrame, decision: str) -> DataFrame:
    bad = F.lit(False)
    for c in df.columns:
        if c.startswith("available_at__"):
            bad = bad | F.col(c).isNull() | (F.col(c) > F.col(decision))
    return fail_if(df, bad, "feature used before it was available")


def tick_audit(ticks: DataFrame, local: str, exchange: str, ident: str, max_gap: int, crossed: Column | None = None) -> DataFrame:
    """Order, repetition, gap and crossing counts; ``ident`` gives the file order within the symbol."""
    d = scan.framed(ticks.withColumn("_pos", F.col(ident)), ["symbol"], ["_pos"], lambda w: {
        "_dl": F.col(local) - F.lag(local, 1).over(w), "_de": F.col(exchange) - F.lag(exchange, 1).over(w),
        "_same": F.col("price") == F.lag("price", 1).over(w)}, back=1, slice_width=4096)
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("_dl") < 0).alias("local_out_of_order"), n(F.col("_de") < 0).alias("exchange_out_of_order"),
        n(F.col("_same")).alias("adjacent_repeats"), n(F.col("_dl") > max_gap).alias("gaps"), F.max("_dl").alias("max_gap"),
        (n(crossed) if crossed is not None else F.lit(0).cast("long")).alias("crossed"))


def ts_diagnostics(df: DataFrame, ts: str, ident: str, seq: str) -> DataFrame:
    """Out-of-order rows along ``seq``, duplicate identities and invalid times; ``ok`` when all are zero."""
    d = scan.framed(df, ["symbol"], [seq], lambda w: {"_back": F.col(ts) < F.lag(ts, 1).over(w)}, back=1, slice_width=4096)
    out = d.groupBy("symbol").agg(
        F.coalesce(F.sum(F.col("_back").cast("long")), F.lit(0)).alias("out_of_order"),
        (F.count(ident) - F.count_distinct(ident)).alias("duplicate_ids"),
        F.sum((F.col(ts).isNull() | (F.col(ts) <= 0)).cast("long")).alias("invalid_ts"))
    return out.withColumn("ok", (F.col("out_of_order") + F.col("duplicate_ids") + F.col("invalid_ts")) == 0)


def coverage(df: DataFrame, by: list[str], ts="ts") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
                               ((F.max(ts) - F.min(ts)) / DAY).alias("span_days"))


def gate_blockers(obs: DataFrame, required: dict[str, int]) -> DataFrame:
    """Compare observed counts with minimums; ``blockers`` joins the failed names with '|'."""
    names = [F.when(F.col(c) < v, F.lit(c)) for c, v in sorted(required.items())]
    return obs.withColumn("blockers", F.concat_ws("|", *names)).withColumn("passed", F.col("blockers") == "")


def sample_gate(df: DataFrame, partition: str, required: dict[str, int]) -> DataFrame:
    from ..functions.scalars import day_no

    obs = df.groupBy(partition).agg(
        F.count_distinct("id").alias("episodes"), F.count_distinct("symbol").alias("symbols"),
        F.count_distinct(day_no("ts")).alias("days"), F.count_distinct("side").alias("directions"))
    return gate_blockers(obs, required)


def identity_check(df: DataFrame, ident: str, image: str, payload: str, ordinal: str) -> DataFrame:
    """Per identity: different pre-image = collision, different payload = conflict, repeated ordinal = duplicate."""
    g = df.groupBy(ident).agg(F.count_distinct(image).alias("_i"), F.count_distinct(payload).alias("_p"),
                              F.count(ordinal).alias("_n"), F.count_distinct(ordinal).alias("_o"))
    return g.select(ident, (F.col("_i") > 1).alias("collision"), (F.col("_p") > 1).alias("conflict"), (F.col("_n") > F.col("_o")).alias("duplicate"))


def feature_profile(df: DataFrame, names: list[str], tiny: float = 1e-12) -> DataFrame:
    """Distinct counts and spread per feature over its long form."""
    long = df.unpivot([], names, "feature", "value")
    return long.groupBy("feature").agg(F.count_distinct("value").alias("distinct"), F.stddev_pop("value").alias("std")).withColumns({
        "single_value": F.col("distinct") <= 1, "near_constant": F.col("std") <= tiny})


def axis_health(df: DataFrame, label: str, unknown: str = "UNKNOWN", limit: float = 0.98, min_rows: int = 20) -> DataFrame:
    """Known-label dominance and transitions per symbol, collapse when one label has at least ``limit``."""
    d = scan.framed(df, ["symbol"], ["ts", "id"], lambda w: {"_ch": F.col(label) != F.lag(label, 1).over(w)}, back=1, slice_width=30 * DAY)
    per = d.groupBy("symbol", label).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("_ch", F.lit(False)).cast("long")).alias("_t"))
    known = F.col(label) != unknown
    out = per.groupBy("symbol").agg(
        F.sum("_n").alias("rows"), F.sum(F.when(known, F.col("_n")).otherwise(0)).alias("known"),
        F.max(F.when(known, F.col("_n"))).alias("_top"), F.sum("_t").alias("transitions"),
        F.count(F.when(known, 1)).alias("labels"))
    share = F.col("_top") / F.col("known")
    return out.withColumns({"dominant_share": share, "collapsed": (F.col("known") >= min_rows) & (share >= limit)}).drop("_top")


def audit_chain(df: DataFrame, by: list[str], seq: str, prev: str, digest: str, hashed: list[str], slice_width: int = 4096) -> DataFrame:
    """Flags rows whose link to the row before, or whose recomputed digest over ``hashed``, is wrong."""
    d = scan.framed(df, by, [seq], lambda w: {"_prior": F.lag(digest, 1).over(w)}, back=1, slice_width=slice_width)
    return d.withColumns({
        "link_ok": F.col(prev).eqNullSafe(F.coalesce("_prior", F.lit(""))),
        "digest_ok": F.sha2(F.concat_ws("|", *hashed), 256).eqNullSafe(F.col(digest))}).drop("_prior")


def robust_shift(df: DataFrame, period: str, names: list[str], early: str = "early", late: str = "late") -> DataFrame:
    """|median late - median early| / max(early IQR, 1e-12) per feature, from exact quantiles."""
    from .order_stats import feature_quantiles

    q = feature_quantiles(df, names, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by=[period])
    e = q.filter(F.col(period) == early).select("feature", F.col("q50").alias("_e"), (F.col("q75") - F.col("q25")).alias("_iqr"))
    l = q.filter(F.col(period) == late).select("feature", F.col("q50").alias("_l"))
    return e.join(l, "feature").select("feature", (F.abs(F.col("_l") - F.col("_e")) / F.greatest(F.col("_iqr"), F.lit(1e-12))).alias("shift"))
