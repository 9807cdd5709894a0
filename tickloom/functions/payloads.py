"""Typed extraction of event payload JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRADE = "p string, q string, m boolean"
BOOK = "b array<array<string>>, a array<array<string>>"


def _levels(c: Column) -> Column:
    """[[price, amount], ...] text pairs as structs of doubles."""
    return F.transform(c, lambda x: F.struct(x[0].cast("double").alias("p"), x[1].cast("double").alias("q")))


def depth(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["q"])


def parse_payload(events: DataFrame, kind: str = "event_type", payload: str = "payload_json") -> DataFrame:
    """price, quantity and maker flag of TRADE; best levels and depths of BOOK; best levels of QUOTE."""
    is_ = lambda k: F.col(kind) == k
    t = F.when(is_("TRADE"), F.from_json(payload, TRADE))
    quote = lambda k: F.when(is_("QUOTE"), F.get_json_object(payload, f"$.{k}").cast("double"))
    b = F.when(is_("BOOK"), F.from_json(payload, BOOK))
    d = events.withColumns({"_t": t, "_b": b})
    bids, asks = _levels(F.col("_b.b")), _levels(F.col("_b.a"))
    live = lambda lv: F.filter(lv, lambda x: x["q"] > 0)
    return d.withColumns({
        "price": F.col("_t.p").cast("double"), "quantity": F.col("_t.q").cast("double"), "maker": F.col("_t.m"),
        "best_bid": F.coalesce(F.array_max(F.transform(live(bids), lambda x: x["p"])), quote("b")),
        "best_ask": F.coalesce(F.array_min(F.transform(live(asks), lambda x: x["p"])), quote("a")),
        "bid_depth": depth(bids), "ask_depth": depth(asks)}).drop("_t", "_b")
