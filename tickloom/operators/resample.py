"""Resampling: ticks to bars, bars to coarser bars, anchors and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import HOUR, MINUTE, bucket_no, floor_to, safe_div
from . import scan


def ticks_to_bars(ticks: DataFrame, width: int, symbol: str = "symbol", tie: str = "event_id") -> DataFrame:
    """OHLC, notional, aggressive-buy notional and count per (symbol, bucket).

    One map-side combined aggregation; min_by/max_by keep open and close safe from
    input order.
    """
    order = F.struct("ts", tie)
    note = F.col("price") * F.col("qty")
    return ticks.groupBy(symbol, floor_to("ts", width).alias("ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum(note).alias("volume"),
        F.sum(F.when(F.col("sgn") > 0, note).otherwise(0.0)).alias("buy_volume"),
        F.count(F.lit(1)).alias("trades"))


def flow_buckets(trades: DataFrame, width: int = MINUTE) -> DataFrame:
    """Aggressive buy and sell notional and trade count per (symbol, bucket)."""
    note = F.col("price") * F.col("qty")
    return trades.groupBy("symbol", floor_to("ts", width).alias("ts")).agg(
        F.sum(F.when(F.col("sgn") > 0, note).otherwise(0.0)).alias("buy_quote"),
        F.sum(F.when(F.col("sgn") < 0, note).otherwise(0.0)).alias("sell_quote"),
        F.count(F.lit(1)).alias("trade_count"))


def resample_complete(bars: DataFrame, step: int, n: int, label: str = "left") -> DataFrame:
    """Coarser bars from ``n`` bars of ``step``; incomplete buckets are dropped.

    A bucket is complete when it holds exactly n distinct, aligned offsets.
    ``label='right'`` stamps the bucket end instead of its start.
    """
    width = step * n
    start = floor_to("ts", width)
    out = bars.groupBy("symbol", start.alias("_b")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.sum("buy_volume").alias("buy_volume"), F.sum("trades").alias("trades"),
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi"),
        F.max(F.pmod(F.col("ts"), F.lit(step))).alias("_odd"))
    ok = (F.col("_n") == n) & (F.col("_lo") == F.col("_b")) & (
        F.col("_hi") == F.col("_b") + (n - 1) * step) & (F.col("_odd") == 0)
    at = F.col("_b") + (width if label == "right" else 0)
    return out.filter(ok).select("symbol", at.alias("ts"), "open", "high", "low", "close", "volume", "buy_volume",
                                 "trades")


def resample_from_anchor(signals: DataFrame, bars: DataFrame, step: int, factor: int, n: int,
                         key: str = "signal_id") -> DataFrame:
    """``n`` bars of ``factor`` steps counted back from each signal's bar; gapped signals fail (dropped).

    The last bar used is the one that closed at or before the signal.
    """
    need = factor * n
    end = floor_to("ts", step) - step
    s = signals.select(key, "symbol", end.alias("_end"))
    # the wanted bar times are known, so this is an equality join and never a range scan
    want = s.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(need - 1))).alias("_p", "_back")).withColumn(
        "ts", F.col("_end") - F.col("_back") * step)
    j = want.join(bars, ["symbol", "ts"])
    b = F.floor(F.col("_back") / factor).cast("int")
    out = j.groupBy(key, b.alias("bars_back")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("_n"))
    whole = out.groupBy(key).agg(F.sum("_n").alias("_all")).filter(F.col("_all") == need).select(key)
    return out.join(whole, key, "left_semi").drop("_n")


def anchor_grid(bars: DataFrame, step: int, every: int, back: int, ahead: int) -> DataFrame:
    """Bars on the decision grid whose history and future are gap-free and do not overlap the next anchor's future."""
    x = scan.framed(bars, ["symbol"], ["ts"], lambda w: {
        "_past": F.lag("ts", back).over(w), "_next": F.lead("ts", ahead).over(w)}, back=back, ahead=ahead)
    on = (F.pmod(F.col("ts") + step, F.lit(every)) == 0)
    return x.filter(on & (F.col("ts") - F.col("_past") == back * step) & (
        F.col("_next") - F.col("ts") == ahead * step)).drop("_past", "_next")


def fixed_grid(bounds: DataFrame, step: int, warmup: int, tail: int) -> DataFrame:
    """Arithmetic anchors in [start+warmup, end-tail] per row of ``bounds(symbol, start, end)``."""
    lo, hi = F.col("start") + warmup, F.col("end") - tail
    return bounds.filter(lo <= hi).select("symbol", F.explode(F.sequence(lo, hi, F.lit(step))).alias("anchor"))


def lookback_times(anchors: DataFrame, offsets: list[int]) -> DataFrame:
    return anchors.select("symbol", F.explode(F.array(*[F.col("anchor") - o for o in offsets])).alias("ts")).distinct()
