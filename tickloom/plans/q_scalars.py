"""Section 2.3."""

from pyspark.sql import functions as F

from ..functions import payloads, scalars as S
from ..operators import order_stats, panel
from .base import query, rnd


@query("safe_div", "bars", """
SELECT symbol, ts, round(CASE WHEN abs(high-low)<=1e-15 THEN 0 ELSE (close-low)/(high-low) END,8)+0.0 AS a, round(CASE WHEN abs(volume-buy_volume)<=1e-15 THEN 0 ELSE buy_volume/(volume-buy_volume) END,8)+0.0 AS b FROM bars""")
def _(v):
    return rnd(v.bars.select("symbol", "ts", S.safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("a"),
                             S.safe_div("buy_volume", F.col("volume") - F.col("buy_volume")).alias("b")), 8)


@query("candle_shape", "bars", """
SELECT symbol, ts, round((high-low)/close,8)+0.0 AS range_fraction, round(abs(close-open)/close,8)+0.0 AS body_fraction,
 round(CASE WHEN high>low THEN (high-greatest(open,close))/(high-low) ELSE 0 END,8)+0.0 AS upper_wick_fraction,
 round(CASE WHEN high>low THEN (least(open,close)-low)/(high-low) ELSE 0 END,8)+0.0 AS lower_wick_fraction,
 round(CASE WHEN high>low THEN abs(close-open)/(high-low) ELSE 0 END,8)+0.0 AS body_to_range,
 round(CASE WHEN high>low THEN (close-low)/(high-low) ELSE 0.5 END,8)+0.0 AS clv, round(CASE WHEN high>low THEN (close-low)/(high-low) ELSE 0.5 END,8)+0.0 AS clv_long,
 round(1-CASE WHEN high>low THEN (close-low)/(high-low) ELSE 0.5 END,8)+0.0 AS clv_short FROM bars""")
def _(v):
    return rnd(v.bars.withColumns(S.candle_shape()).select("symbol", "ts", *S.candle_shape()), 8)


@query("taker_imbalance", "bars", """
SELECT symbol, ts, round((2*buy_volume-volume)/volume,8)+0.0 AS zero_variant, CASE WHEN trades>1 THEN round((2*buy_volume-volume)/volume,8)+0.0 END AS null_variant FROM bars""")
def _(v):
    total = F.when(F.col("trades") > 1, F.col("volume")).otherwise(0.0)
    buy = F.when(F.col("trades") > 1, F.col("buy_volume")).otherwise(0.0)
    return rnd(v.bars.select("symbol", "ts", S.taker_imbalance("volume", "buy_volume").alias("zero_variant"), S.taker_imbalance(total, buy, None).alias("null_variant")), 8)


@query("side_orientation", "bars", """
SELECT symbol, ts, s.side, CASE WHEN s.side='LONG' THEN 1 ELSE -1 END*(close-open) AS move, CASE WHEN s.side='LONG' THEN high-close ELSE close-low END AS room,
 CASE WHEN s.side='LONG' THEN close-low ELSE high-close END AS risk, CASE WHEN s.side='LONG' THEN buy_volume/volume ELSE 1-buy_volume/volume END AS breadth,
 CASE WHEN s.side='LONG' THEN 100-100*buy_volume/volume ELSE 100*buy_volume/volume END AS rsi_room FROM bars, (VALUES ('LONG'),('SHORT')) s(side)""")
def _(v):
    d = v.bars.select("symbol", "ts", (F.col("close") - F.col("open")).alias("move"), (F.col("high") - F.col("close")).alias("room"), (F.col("close") - F.col("low")).alias("risk"),
                      (F.col("buy_volume") / F.col("volume")).alias("breadth"), (100 * F.col("buy_volume") / F.col("volume")).alias("rsi"))
    d = panel.orient_sides(d, signed=["move"], swapped=[("room", "risk")], complement=["breadth"], rsi="rsi")
    return d.select("symbol", "ts", "side", "move", "room", "risk", "breadth", "rsi_room")


@query("cyclic_time", "ticks", """
x AS (SELECT event_id, (ts//3600000000)%24 AS h, ((ts//86400000000)+3)%7 AS d FROM ticks)
SELECT event_id, round(sin(2*pi()*h/24),8)+0.0 AS hour_sin, round(cos(2*pi()*h/24),8)+0.0 AS hour_cos, round(sin(2*pi()*d/7),8)+0.0 AS weekday_sin, round(cos(2*pi()*d/7),8)+0.0 AS weekday_cos FROM x""")
def _(v):
    return rnd(v.ticks.select("event_id", *[c.alias(n) for n, c in S.cyclic_time("ts").items()]), 8)


@query("time_buckets", "ticks", """
SELECT event_id, epoch_us(time_bucket(INTERVAL '5 minutes', make_timestamp(ts))) AS b5, epoch_us(time_bucket(INTERVAL '15 minutes', make_timestamp(ts))) AS b15, epoch_us(date_trunc('hour', make_timestamp(ts))) AS b1h,
 (ts//21600000000)*21600000000 AS b6h, (ts//43200000000)*43200000000 AS b12h, epoch_us(date_trunc('day', make_timestamp(ts))::TIMESTAMP) AS bday, epoch_us(date_trunc('week', make_timestamp(ts))::TIMESTAMP) AS bweek,
 epoch_us(date_trunc('month', make_timestamp(ts))::TIMESTAMP) AS bmonth, (ts//60000000+1)*60000000 AS next_minute, (ts//300000000+1)*300000000 AS next_5m FROM ticks""")
def _(v):
    t = v.ticks
    return t.select("event_id", *[S.time_bucket("ts", u).alias(n) for n, u in (("b5", "5m"), ("b15", "15m"), ("b1h", "1h"), ("b6h", "6h"), ("b12h", "12h"), ("bday", "day"), ("bweek", "week"), ("bmonth", "month"))],
                    S.next_open("ts", S.MINUTE).alias("next_minute"), S.next_open("ts", 5 * S.MINUTE).alias("next_5m"))


@query("stable_identity", "ticks", "SELECT event_id, sha256('episode|' || symbol || '|' || ts) AS id, ('0x' || substr(sha256('episode|' || symbol || '|' || ts),1,15))::BIGINT AS bits FROM ticks")
def _(v):
    i = S.stable_id(F.lit("episode"), "symbol", "ts")
    return v.ticks.select("event_id", i.alias("id"), S.hash60(F.concat_ws("|", F.lit("episode"), "symbol", F.col("ts").cast("string"))).alias("bits"))


@query("canonical_decimal", "ticks", """
x AS (SELECT event_id, price::VARCHAR::DECIMAL(38,18)::VARCHAR AS p, round(price)::DECIMAL(38,18)::VARCHAR AS i FROM ticks),
y AS (SELECT event_id, rtrim(p,'0') AS p, rtrim(i,'0') AS i FROM x)
SELECT event_id, CASE WHEN p LIKE '%.' THEN p || '0' ELSE p END AS price_text, CASE WHEN i LIKE '%.' THEN i || '0' ELSE i END AS whole_text FROM y""")
def _(v):
    return v.ticks.select("event_id", S.canonical_decimal(F.col("price").cast("string")).alias("price_text"), S.canonical_decimal(F.round("price")).alias("whole_text"))


@query("normalise_clip", "scored", """
f AS (SELECT avg(net) AS m, stddev_pop(net) AS s, avg(mae) AS m2, stddev_pop(mae) AS s2 FROM scored WHERE regime='F')
SELECT id, round(greatest(-1.5,least(1.5,(net-m)/CASE WHEN s<=1e-12 THEN 1 ELSE s END)),6)+0.0 AS net, round(greatest(-1.5,least(1.5,(mae-m2)/s2)),6)+0.0 AS mae,
 (abs((net-m)/s)>1.5)::INT + (abs((mae-m2)/s2)>1.5)::INT AS clipped FROM scored, f""")
def _(v):
    fit = panel.fit_normaliser(v.scored.filter("regime = 'F'"), ["net", "mae"])
    return rnd(panel.apply_normaliser(v.scored, fit, ["net", "mae"], 1.5).select("id", "net", "mae", "clipped"))


@query("robust_scale", "scored", """
f AS (SELECT median(net) AS c, quantile_cont(net,0.75)-quantile_cont(net,0.25) AS iqr, quantile_cont(net,0.001) AS lo, quantile_cont(net,0.999) AS hi,
  median(mae) AS c2, quantile_cont(mae,0.75)-quantile_cont(mae,0.25) AS iqr2, quantile_cont(mae,0.001) AS lo2, quantile_cont(mae,0.999) AS hi2 FROM scored WHERE regime='F')
SELECT id, round(greatest(-8,least(8,(greatest(lo,least(hi,net))-c)/iqr)),6)+0.0 AS net, round(greatest(-8,least(8,(greatest(lo2,least(hi2,mae))-c2)/iqr2)),6)+0.0 AS mae FROM scored, f""")
def _(v):
    fit = panel.fit_robust_scale(v.scored.filter("regime = 'F'"), ["net", "mae"])
    return rnd(panel.apply_robust_scale(v.scored, fit, ["net", "mae"]).select("id", "net", "mae"))


@query("json_payload_extract", "ticks", """
SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN symbol IN ('click','view') THEN price END AS price, CASE WHEN symbol IN ('click','view') THEN event_id%2=0 END AS maker,
 CASE WHEN symbol='purchase' AND (props->>'k')::INT>0 THEN round(price-0.5,4)+0.0 END AS best_bid, CASE WHEN symbol='purchase' AND (props->>'k')::INT>0 THEN round(price+0.5,4)+0.0 END AS best_ask, CASE WHEN symbol='purchase' THEN 3*((props->>'k')::DOUBLE) END AS bid_depth FROM ticks""")
def _(v):
    k = F.get_json_object("props", "$.k")
    p = F.col("price").cast("string")
    trade = F.concat(F.lit('{"p":"'), p, F.lit('","q":"1","m":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    lv = lambda a, q: F.concat(F.lit('["'), (F.col("price") + a).cast("string"), F.lit('","'), q, F.lit('"]'))
    twice = (2 * k.cast("int")).cast("string")
    book = F.concat(F.lit('{"b":['), lv(-1.5, twice), F.lit(","), lv(-0.5, k), F.lit('],"a":['), lv(0.5, k), F.lit(","), lv(1.5, k), F.lit("]}"))
    kind = F.when(F.col("symbol").isin("click", "view"), "TRADE").when(F.col("symbol") == "purchase", "BOOK").otherwise("OTHER")
    ev = v.ticks.select("event_id", "props", kind.alias("event_type"), F.when(kind == "TRADE", trade).when(kind == "BOOK", book).otherwise(F.col("props")).alias("payload_json"))
    out = payloads.parse_payload(ev).withColumn("k", F.from_json("props", "k long")["k"])
    return rnd(out.select("event_id", "k", "price", "maker", "best_bid", "best_ask", "bid_depth"), 4)


@query("partition_label", "ticks", """
SELECT event_id, CASE WHEN ts<1704931200000000 THEN 'DISCOVERY' WHEN ts<1705017600000000 THEN 'EMBARGO' WHEN ts<1705795200000000 THEN 'VALIDATION' WHEN ts<1706486400000000 THEN 'HOLDOUT' ELSE 'OUT_OF_SCOPE' END AS part FROM ticks""")
def _(v):
    b = [("DISCOVERY", 0, 1704931200000000), ("EMBARGO", 1704931200000000, 1705017600000000), ("VALIDATION", 1705017600000000, 1705795200000000), ("HOLDOUT", 1705795200000000, 1706486400000000)]
    return v.ticks.select("event_id", S.partition_label("ts", b).alias("part"))
