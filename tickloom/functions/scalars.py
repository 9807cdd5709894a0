"""Scalar column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Epoch microseconds of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def div(a, b) -> Column:
    """Quotient that is NULL on a zero divisor (ANSI mode would fail the job)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def floor_to(ts, width: int) -> Column:
    c = col(ts)
    return c - F.pmod(c, F.lit(width))


def bucket_no(ts, width: int) -> Column:
    return F.floor(col(ts) / F.lit(width)).cast("long")


def safe_div(num, den) -> Column:
    """0 when the denominator is (near) zero or the quotient is not finite."""
    n, d = col(num), col(den)
    q = F.try_divide(n, d)
    bad = (F.abs(d) <= 1e-15) | F.isnan(q) | (F.abs(q) == float("inf"))
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(0.0)).otherwise(q)


def flag(cond) -> Column:
    """1.0 / 0.0, with NULL conditions as 0.0."""
    return F.when(cond, 1.0).otherwise(0.0)


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(finite(c), c)


def body_top(): return F.greatest("open", "close")


def body_low(): return F.least("open", "close")


def candle_shape() -> dict[str, Column]:
    rng = F.col("high") - F.col("low")
    clv = F.when(rng > 0, div(F.col("close") - F.col("low"), rng)).otherwise(0.5)
    return {
        "range_fraction": safe_div(rng, "close"),
        "body_fraction": safe_div(F.abs(F.col("close") - F.col("open")), "close"),
        "upper_wick_fraction": safe_div(F.col("high") - body_top(), rng),
        "lower_wick_fraction": safe_div(body_low() - F.col("low"), rng),
        "body_to_range": safe_div(F.abs(F.col("close") - F.col("open")), rng),
        "clv": clv,
        "clv_long": clv,
        "clv_short": 1 - clv,
    }


def taker_imbalance(total, buy, zero_value: float | None = 0.0) -> Column:
    """(2*buy - total)/total; zero volume gives ``zero_value``; buy above total is invalid (NULL)."""
    t, b = col(total), col(buy)
    return F.when(b > t + 1e-9, F.lit(None).cast("double")).when(t > 0, div(2 * b - t, t)).otherwise(
        F.lit(zero_value).cast("double"))


def day_no(ts) -> Column:
    return bucket_no(ts, DAY)


def utc_hour(ts) -> Column:
    return F.pmod(bucket_no(ts, HOUR), F.lit(24)).cast("int")


def utc_weekday(ts) -> Column:
    """Monday is 0 (1970-01-01 was a Thursday)."""
    return F.pmod(day_no(ts) + 3, F.lit(7)).cast("int")


def utc_date(ts) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_no(ts).cast("int"))


def cyclic_time(ts) -> dict[str, Column]:
    h = utc_hour(ts) * (2 * 3.141592653589793 / 24)
    d = utc_weekday(ts) * (2 * 3.141592653589793 / 7)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "weekday_sin": F.sin(d), "weekday_cos": F.cos(d)}


def iso_week(ts) -> Column:
    """Number of the Monday-based week since the epoch's week."""
    return F.floor((day_no(ts) + 3) / F.lit(7)).cast("long")


def month_key(ts) -> Column:
    return F.date_format(utc_date(ts), "yyyy-MM")


_FIXED = {"5m": 5 * MINUTE, "15m": 15 * MINUTE, "1h": HOUR, "6h": 6 * HOUR, "12h": 12 * HOUR, "day": DAY}


def time_bucket(ts, unit: str) -> Column:
    """Start of the bucket in epoch microseconds; weeks start on Monday."""
    if unit == "week":
        return (iso_week(ts) * 7 - 3) * F.lit(DAY)
    if unit == "month":
        return F.unix_date(F.trunc(utc_date(ts), "month")).cast("long") * F.lit(DAY)
    return floor_to(ts, _FIXED[unit])


def next_open(ts, width: int) -> Column:
    """First bucket start strictly after the bucket holding ``ts`` (next complete bar open)."""
    return floor_to(ts, width) + F.lit(width)


def stable_id(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)


def hash60(text) -> Column:
    """First 60 bits of the SHA-256 as a non-negative BIGINT."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 15), 16, 10).cast("long")


def canonical_decimal(c) -> Column:
    """Fixed notation, trailing zeros cut, integers keep one zero (``0.0``, ``12.0``)."""
    shown = F.to_char(col(c).cast("decimal(38,18)"), F.lit("S99999999999999999999.999999999999999999"))
    txt = F.regexp_replace(F.regexp_replace(F.trim(shown), r"^\+", ""), r"^(-?)\.", "$10.")
    cut = F.regexp_replace(txt, r"0+$", "")
    full = F.when(cut.endswith("."), F.concat(cut, F.lit("0"))).otherwise(cut)
    return F.when(full == "-0.0", "0.0").otherwise(full)


def partition_label(ts, bounds: list[tuple[str, int, int]], default: str = "OUT_OF_SCOPE") -> Column:
    """Half-open [lo, hi) time partitions, first match wins."""
    out = None
    for name, lo, hi in bounds:
        cond = (col(ts) >= lo) & (col(ts) < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def clip(c, lo, hi) -> Column:
    """NULL stays NULL (greatest/least would skip it)."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(c))))


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def side_sign(side="side") -> Column:
    return F.when(col(side) == "LONG", 1.0).otherwise(-1.0)
