"""Section 2.4, resampling and grids."""

from pyspark.sql import functions as F

from ..functions.scalars import HOUR
from ..operators import resample as R
from .base import query, rnd


@query("ticks_to_bars", "bars", "SELECT symbol, ts, open, high, low, close, volume, buy_volume, trades FROM bars")
def _(v):
    return v.bars


@query("resample_complete_bars", "bars6", "SELECT symbol, ts, open, high, low, close, volume, buy_volume, trades FROM bars6")
def _(v):
    return v.bars6


@query("resample_right_labelled", "bars", """
SELECT symbol, (ts//14400000000)*14400000000 + 14400000000 AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
 last(close ORDER BY ts) AS close, round(sum(volume),2)+0.0 AS volume, sum(trades)::BIGINT AS trades FROM bars GROUP BY 1,2 HAVING count(*)=4""")
def _(v):
    return rnd(R.resample_complete(v.bars, HOUR, 4, "right").drop("buy_volume"), 2)


@query("resample_anchor_relative", "bars signals", """
w AS (SELECT signal_id, symbol, (ts//3600000000)*3600000000-3600000000 AS e FROM signals),
j AS (SELECT w.signal_id, ((w.e-b.ts)//3600000000)//3 AS bars_back, b.* FROM w JOIN bars b ON b.symbol=w.symbol AND b.ts BETWEEN w.e-11*3600000000 AND w.e),
k AS (SELECT signal_id FROM j GROUP BY 1 HAVING count(*)=12)
SELECT signal_id, bars_back::INT AS bars_back, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, round(sum(volume),2)+0.0 AS volume
FROM j WHERE signal_id IN (SELECT signal_id FROM k) GROUP BY 1,2""")
def _(v):
    return rnd(R.resample_from_anchor(v.signals, v.bars, HOUR, 3, 4), 2)


@query("hourly_anchor_grid", "bars", """
x AS (SELECT *, lag(ts,6) OVER w AS p, lead(ts,4) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, close FROM x WHERE (ts+3600000000) % 14400000000 = 0 AND ts-p=6*3600000000 AND n-ts=4*3600000000""")
def _(v):
    return R.anchor_grid(v.bars, HOUR, 4 * HOUR, 6, 4).select("symbol", "ts", "close")


@query("fixed_anchor_grid", "bars", """
b AS (SELECT symbol, min(ts) AS s, max(ts) AS e FROM bars GROUP BY 1),
a AS (SELECT symbol, unnest(range(s+6*3600000000, e-4*3600000000+1, 5*3600000000)) AS anchor FROM b)
SELECT DISTINCT symbol, anchor - o AS ts FROM a, (VALUES (0),(3600000000),(10*3600000000)) t(o)""")
def _(v):
    b = v.bars.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return R.lookback_times(R.fixed_grid(b, 5 * HOUR, 6 * HOUR, 4 * HOUR), [0, HOUR, 10 * HOUR])
