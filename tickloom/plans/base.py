"""Registry of runnable queries, the stand-in views they read, and their oracle SQL.

Every view is declared twice: as a DataFrame built with this package's operators
and as plain SQL text for the DuckDB check.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import DAY, HOUR, SECOND, floor_to, micros
from ..operators import resample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
REF1, REF2 = "purchase", "signup"


def cents(bars: DataFrame) -> DataFrame:
    """Traded notionals to two decimals: the stand-in views fix them so that both engines sum alike."""
    return bars.withColumns({c: F.round(c, 2) for c in ("volume", "buy_volume")})


class Tables:
    """Lazily built inputs for one (session, folder)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            "event_id", F.col("event_type").alias("symbol"), micros("ts").alias("ts"),
            F.col("value").alias("price"), F.lit(1.0).alias("qty"),
            F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("sgn"), "user_id", "props")

    @cached_property
    def bars(self) -> DataFrame:
        return cents(resample.ticks_to_bars(self.ticks, HOUR))

    @cached_property
    def bars6(self) -> DataFrame:
        return cents(resample.resample_complete(self.bars, HOUR, 6))

    @cached_property
    def signals(self) -> DataFrame:
        """A price of 120 or more is a decision on its symbol, on the aggressor's side."""
        return self.ticks.filter("price >= 120").select(
            F.col("event_id").alias("signal_id"), "symbol", "ts", F.col("price").alias("ref_price"),
            F.when(F.col("sgn") > 0, "LONG").otherwise("SHORT").alias("side"))

    @cached_property
    def funding(self) -> DataFrame:
        """Error events stand in for funding records of every symbol."""
        return self.ticks.filter("symbol = 'error'").select("ts", (F.col("price") / 1e6).alias("rate"), "event_id")

    @cached_property
    def scored(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.read("orders").select(
            k.alias("id"), micros("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("symbol"),
            F.when(c % 2 == 0, "LONG").otherwise("SHORT").alias("side"), F.col("o_orderstatus").alias("regime"),
            ((k % 97) / 96.0).alias("score"), (F.pmod(k * 7919, F.lit(2003)) - 950).cast("double").alias("_n"),
            (F.pmod(k * 104729, F.lit(1009)) / 50000.0).alias("mae"),
            (F.pmod(k * 1299709, F.lit(1511)) / 40000.0).alias("mfe"),
            ((c % 101) / 100.0).alias("p_clean"), (F.pmod(k * 31, F.lit(89)) / 88.0).alias("p_danger"),
            F.col("o_totalprice").alias("size"),
        ).withColumn("net", F.col("_n") / 10000.0).drop("_n").withColumn("label", (F.col("net") > 0).cast("int"))

    @cached_property
    def paths(self) -> DataFrame:
        """Both sides of every bar with six gap-free bars after it; entry at the next open."""
        from ..operators import panel, paths

        d = paths.forward_path(self.bars, HOUR, 6).select("symbol", "ts", F.col("close").alias("close0"), "entry", "path")
        return panel.orient_sides(d)

    @cached_property
    def daily(self) -> DataFrame:
        return self.read("lineitem").groupBy(
            F.col("l_suppkey").alias("symbol"), micros("l_shipdate").alias("ts")).agg(
            F.round(F.sum("l_extendedprice"), 2).alias("close"), F.count(F.lit(1)).alias("trades"))


VIEWS = {
    "ticks": ((), """SELECT event_id, event_type AS symbol, epoch_us(ts) AS ts, value AS price, 1.0::DOUBLE AS qty,
        CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sgn, user_id, props FROM events"""),
    "bars": (("ticks",), """SELECT symbol, (ts // 3600000000) * 3600000000 AS ts,
        first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, event_id) AS close, round(sum(price), 2) AS volume,
        round(sum(CASE WHEN sgn > 0 THEN price ELSE 0 END), 2) AS buy_volume, count(*) AS trades
        FROM ticks GROUP BY 1, 2"""),
    "bars6": (("bars",), """SELECT symbol, (ts // 21600000000) * 21600000000 AS ts,
        first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
        round(sum(volume), 2) AS volume, round(sum(buy_volume), 2) AS buy_volume, sum(trades)::BIGINT AS trades
        FROM bars GROUP BY 1, 2 HAVING count(*) = 6"""),
    "signals": (("ticks",), """SELECT event_id AS signal_id, symbol, ts, price AS ref_price,
        CASE WHEN sgn > 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM ticks WHERE price >= 120"""),
    "funding": (("ticks",), "SELECT ts, price / 1e6 AS rate, event_id FROM ticks WHERE symbol = 'error'"),
    "scored": ((), """SELECT o_orderkey AS id, epoch_us(o_orderdate) AS ts, o_orderpriority AS symbol,
        CASE WHEN o_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, o_orderstatus AS regime,
        (o_orderkey % 97) / 96.0::DOUBLE AS score, ((o_orderkey * 7919) % 2003 - 950)::DOUBLE / 10000.0::DOUBLE AS net,
        ((o_orderkey * 104729) % 1009) / 50000.0::DOUBLE AS mae, ((o_orderkey * 1299709) % 1511) / 40000.0::DOUBLE AS mfe,
        (o_custkey % 101) / 100.0::DOUBLE AS p_clean, ((o_orderkey * 31) % 89) / 88.0::DOUBLE AS p_danger,
        o_totalprice AS size, CASE WHEN (o_orderkey * 7919) % 2003 - 950 > 0 THEN 1 ELSE 0 END AS label FROM orders"""),
    "daily": ((), """SELECT l_suppkey AS symbol, epoch_us(l_shipdate) AS ts, round(sum(l_extendedprice), 2) AS close,
        count(*) AS trades FROM lineitem GROUP BY 1, 2"""),
    "pl": (("barsi",), """SELECT e.symbol, e.ts, s.side, e.entry, b.i - e.i AS k, b.ts AS bts, b.open, b.high, b.low, b.close, b.volume, b.buy_volume,
        CASE s.side WHEN 'LONG' THEN b.high/e.entry-1 ELSE 1-b.low/e.entry END AS fav, CASE s.side WHEN 'LONG' THEN 1-b.low/e.entry ELSE b.high/e.entry-1 END AS adv,
        CASE s.side WHEN 'LONG' THEN 1 ELSE -1 END*(b.close/e.entry-1) AS r, e.close0
        FROM (SELECT symbol, ts, i, close AS close0, lead(open,1) OVER w AS entry, lead(ts,6) OVER w AS t6 FROM barsi WINDOW w AS (PARTITION BY symbol ORDER BY i)) e
        JOIN barsi b ON b.symbol=e.symbol AND b.i BETWEEN e.i+1 AND e.i+6, (VALUES ('LONG'),('SHORT')) s(side) WHERE e.t6-e.ts=6*3600000000"""),
    "barsi": (("bars",), "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars"),
}


def with_views(names: str, body: str) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        done.append(n)

    for n in names.split():
        visit(n)
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in done)
    body = body.strip()
    sep = " " if body.upper().startswith("SELECT") else ", "
    return f"WITH RECURSIVE {ctes}{sep}{body}" if ctes else (body if sep == " " else f"WITH RECURSIVE {body}")


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is the oracle body after the views' CTEs."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return deco


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double for comparison; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double"
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
