"""Section 2.8."""

from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, flag, safe_div, side_sign, taker_imbalance
from ..operators import events as E, joins as J, panel as PN, quality, scan, windows as W
from .base import REF1, query, rnd

B = dict(block=128)
KW = dict(short=3, mid=6, long=12, far=24, volume=12, fast=3, wide=12, level=12)


def feats(v):
    d = J.attach_reference(v.bars, {"spot": REF1}, ["close"])
    d = E.pattern_features(d, HOUR, KW, **B).filter(F.col("_i") >= 24)
    return d.withColumn("regime", F.when(F.col("ret_far") > 0.2, "BULL").when(F.col("ret_far") < -0.2, "BEAR").otherwise("RANGE"))


_F = """
s AS (SELECT b.*, r.close AS spot, CASE WHEN b.volume>0 THEN (2*b.buy_volume-b.volume)/b.volume ELSE 0 END AS flow_1, b.close/r.close-1 AS basis FROM barsi b LEFT JOIN bars r ON r.ts=b.ts AND r.symbol='purchase'),
f0 AS (SELECT *, close/lag(close,3) OVER o-1 AS ret_short, close/lag(close,6) OVER o-1 AS ret_mid, close/lag(close,12) OVER o-1 AS ret_long, close/lag(close,24) OVER o-1 AS ret_far, avg(flow_1) OVER w3 AS flow_3, volume/avg(volume) OVER l12 AS volume_ratio,
 (max(high) OVER w3-min(low) OVER w3)/nullif(max(high) OVER w12-min(low) OVER w12,0) AS compression, max(high) OVER l12 AS prior_high, min(low) OVER l12 AS prior_low, lag(basis,6) OVER o AS prior_basis FROM s
 WINDOW o AS (PARTITION BY symbol ORDER BY i), w3 AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY i ROWS 11 PRECEDING), l12 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, close/prior_high-1 AS breakout_up, prior_low/close-1 AS breakout_down, abs(close-open)/open AS body, (high-greatest(open,close))/open AS upper_wick, (least(open,close)-low)/open AS lower_wick, abs(prior_basis)-abs(basis) AS basis_convergence,
 abs(ret_short) AS price_response, CASE WHEN ret_far>0.2 THEN 'BULL' WHEN ret_far<-0.2 THEN 'BEAR' ELSE 'RANGE' END AS regime FROM f0 WHERE i>=24)
"""
_TR = "ts < 1705363200000000"
_TH = f"""
th AS (SELECT quantile_cont(abs(flow_3),0.9) AS min_flow, quantile_cont(volume_ratio,0.8) AS min_volume_ratio, quantile_cont(compression,0.2) AS max_compression, quantile_cont(greatest(0,breakout_up,breakout_down),0.9) AS min_breakout,
 quantile_cont(greatest(upper_wick,lower_wick)/greatest(body,1e-12),0.8) AS min_wick_body, quantile_cont(abs(ret_long),0.9) AS min_extension, quantile_cont(price_response,0.2) AS max_response, quantile_cont(abs(prior_basis),0.9) AS min_basis, quantile_cont(abs(ret_short),0.6) AS min_reclaim FROM f WHERE {_TR})
"""


@query("fit_thresholds", "barsi", _F + "," + _TH + "SELECT " + ", ".join(f"round({c},8)+0.0 AS {c}" for c in E.PATTERN_THRESHOLDS) + " FROM th")
def _(v):
    return rnd(E.fit_thresholds(feats(v).filter(_TR), E.pattern_spec()), 8)


_PAT = [("TREND_PULLBACK_CONTINUATION", "LONG", "regime='BULL' AND ret_long>0 AND ret_short>min_reclaim AND flow_3>=min_flow"), ("TREND_PULLBACK_CONTINUATION", "SHORT", "regime='BEAR' AND ret_long<0 AND ret_short<-min_reclaim AND flow_3<=-min_flow"),
        ("COMPRESSION_BREAKOUT", "LONG", "compression<=max_compression AND volume_ratio>=min_volume_ratio AND breakout_up>=min_breakout AND flow_1>=min_flow"), ("COMPRESSION_BREAKOUT", "SHORT", "compression<=max_compression AND volume_ratio>=min_volume_ratio AND breakout_down>=min_breakout AND flow_1<=-min_flow"),
        ("LIQUIDITY_SWEEP_REJECTION", "LONG", "low<prior_low AND lower_wick/greatest(body,1e-12)>=min_wick_body AND close>prior_low"), ("LIQUIDITY_SWEEP_REJECTION", "SHORT", "high>prior_high AND upper_wick/greatest(body,1e-12)>=min_wick_body AND close<prior_high"),
        ("FLOW_PRICE_ABSORPTION_REVERSAL", "LONG", "abs(flow_3)>=min_flow AND price_response<=max_response AND flow_1*flow_3<0 AND flow_3<0"), ("FLOW_PRICE_ABSORPTION_REVERSAL", "SHORT", "abs(flow_3)>=min_flow AND price_response<=max_response AND flow_1*flow_3<0 AND flow_3>0"),
        ("EXHAUSTION_REVERSAL", "LONG", "abs(ret_long)>=min_extension AND abs(ret_short)<abs(ret_mid)/4 AND flow_3*ret_long<0 AND ret_long<0"), ("EXHAUSTION_REVERSAL", "SHORT", "abs(ret_long)>=min_extension AND abs(ret_short)<abs(ret_mid)/4 AND flow_3*ret_long<0 AND ret_long>0"),
        ("SPOT_FUTURES_DIVERGENCE_CONVERGENCE", "LONG", "abs(prior_basis)>=min_basis AND basis_convergence>=min_reclaim AND prior_basis<0"), ("SPOT_FUTURES_DIVERGENCE_CONVERGENCE", "SHORT", "abs(prior_basis)>=min_basis AND basis_convergence>=min_reclaim AND prior_basis>0"),
        ("MULTITIMEFRAME_RECLAIM", "LONG", "regime='BULL' AND ret_far>0 AND ret_long<0 AND ret_mid>=min_reclaim"), ("MULTITIMEFRAME_RECLAIM", "SHORT", "regime='BEAR' AND ret_far<0 AND ret_long>0 AND ret_mid<=-min_reclaim")]


@query("pattern_events", "barsi", _F + "," + _TH + " UNION ALL ".join(f"SELECT symbol, ts, regime, '{p}' AS pattern, '{s}' AS side FROM f, th WHERE {c}" for p, s, c in _PAT))
def _(v):
    f = scan.pin(feats(v))
    return E.detect_patterns(f, E.fit_thresholds(f.filter(_TR), E.pattern_spec()), F.lit(True)).select("symbol", "ts", "regime", "pattern", "side")


@query("registered_flow_events", "bars", """
a AS (SELECT *, CASE WHEN volume>0 THEN (2*buy_volume-volume)/volume ELSE 0 END AS f1, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS r1 FROM bars),
b AS (SELECT *, CASE WHEN count(*) OVER l>=12 AND stddev_pop(f1) OVER l>0 THEN (f1-avg(f1) OVER l)/stddev_pop(f1) OVER l END AS fz, CASE WHEN count(*) OVER l>=12 AND stddev_pop(trades) OVER l>0 THEN (trades-avg(trades) OVER l)/stddev_pop(trades) OVER l END AS cz,
 avg(f1) OVER w3 AS f3, avg(sign(f1)) OVER w5 AS p5 FROM a WINDOW l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)),
c AS (SELECT symbol, ts, s.side, s.k*fz AS fz, cz, s.k*f3 AS f3, s.k*p5 AS p5, s.k*r1 AS r1 FROM b, (VALUES ('LONG',1),('SHORT',-1)) s(side,k))
SELECT symbol, ts, side, 'FLOW_IMPULSE_CONTINUATION' AS event_family FROM c WHERE fz>=0.7 AND cz>=-0.5 AND f3>=0.2 AND p5>=0.1 AND r1>=0 UNION ALL
SELECT symbol, ts, side, 'FLOW_ABSORPTION_REVERSAL' FROM c WHERE fz<=-0.7 AND cz>=-0.5 AND r1>=0 AND f3>=-0.5""")
def _(v):
    b = v.bars.withColumn("f1", taker_imbalance("volume", "buy_volume"))
    d = scan.framed(b, ["symbol"], ["ts"], lambda w: {"side_flow_z": W.zscore(w, "f1", 12), "trade_count_z": W.zscore(w, "trades", 12), "side_flow_3": F.avg("f1").over(scan.k_rows(w, 3)),
                                                      "side_persistence": F.avg(F.signum("f1")).over(scan.k_rows(w, 5)), "side_response": W.ret(w, 1)}, back=12, **B)
    d = PN.orient_sides(d, signed=["side_flow_z", "side_flow_3", "side_persistence", "side_response"])
    d = E.flow_events(d, dict(flow_z=0.7, count_z=-0.5, flow_3=0.2, persistence=0.1, response=0.0), dict(flow_z=0.7, count_z=-0.5, response=0.0, flow_3=-0.5))
    return d.select("symbol", "ts", "side", "event_family")


_WAVE = """
t AS (SELECT *, greatest(high-low, abs(high-coalesce(lag(close) OVER o,open)), abs(low-coalesce(lag(close) OVER o,open))) AS tr FROM barsi WINDOW o AS (PARTITION BY symbol ORDER BY i)),
a AS (SELECT *, CASE WHEN count(*) OVER w>=6 THEN avg(tr) OVER w END AS atr, volume/avg(volume) OVER l AS vr FROM t WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING), l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, lead(close,1) OVER o AS c1, lead(close,2) OVER o AS c2, lead(atr,1) OVER o AS atr1, lead(atr,2) OVER o AS atr2, CASE WHEN close>open THEN 1 ELSE -1 END AS s, CASE WHEN close>open THEN high ELSE low END AS ext, (open+close)/2 AS mid, abs(close-open) AS bd
 FROM a WINDOW o AS (PARTITION BY symbol ORDER BY i)),
e AS (SELECT * FROM n WHERE close<>open AND vr>=1.0 AND bd/atr>=0.5),
v AS (SELECT *, 'A_IMMEDIATE' AS variant, 0 AS k FROM e UNION ALL SELECT *, 'B_ONE_BAR_CONFIRMATION', 1 FROM e WHERE s*(c1-close)>0 AND s*(c1-mid)>0 UNION ALL
 SELECT *, 'C_CAUSAL_PULLBACK', CASE WHEN s*(close-c1)/bd BETWEEN 0.1 AND 0.4 AND s*(c1-mid)>0 THEN 1 ELSE 2 END FROM e WHERE (s*(close-c1)/bd BETWEEN 0.1 AND 0.4 AND s*(c1-mid)>0) OR (s*(close-c2)/bd BETWEEN 0.1 AND 0.4 AND s*(c2-mid)>0) UNION ALL
 SELECT *, 'D_EXTREME_BREAK_CONFIRMATION', CASE WHEN s*(c1-ext)>0 THEN 1 ELSE 2 END FROM e WHERE s*(c1-ext)>0 OR s*(c2-ext)>0)
SELECT v.symbol, v.ts, CASE WHEN s=1 THEN 'LONG' ELSE 'SHORT' END AS side, variant, k AS confirmation_bars, b.ts AS entry_ts, b.open AS entry_price, v.vr>=1.5 AS ladder_volume, v.vr>=1.5 AND bd/(v.high-v.low)>=0.6 AS ladder_clean
FROM v JOIN barsi b ON b.symbol=v.symbol AND b.i=v.i+k+1 JOIN barsi z ON z.symbol=v.symbol AND z.i=v.i+k+4 WHERE z.ts-b.ts=3*3600000000 AND CASE k WHEN 0 THEN atr WHEN 1 THEN atr1 ELSE atr2 END>0"""


@query("wave_events_variants", "barsi", _WAVE)
def _(v):
    d = W.atr(scan.indexed(v.bars, ["symbol"], ["ts"]), 6)
    d = scan.framed(d, ["symbol"], ["ts"], lambda w: {"volume_ratio": safe_div("volume", F.avg("volume").over(scan.k_rows(w, 6, 1)))}, back=6, **B)
    d = d.withColumn("body_atr", safe_div(F.abs(F.col("close") - F.col("open")), "atr"))
    d = E.wave_events(d, HOUR, 1.0, 0.5, 4, **B)
    lad = E.ladder({"volume": F.col("volume_ratio") >= 1.5, "clean": safe_div(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")) >= 0.6})
    return d.withColumns(lad).select("symbol", "ts", "side", "variant", "confirmation_bars", "entry_ts", "entry_price", "ladder_volume", "ladder_clean")


@query("confirmation_within_k", "barsi", """
p AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ph FROM barsi),
e AS (SELECT * FROM p WHERE close>open AND i>=3),
c AS (SELECT e.symbol, e.ts, min(b.i-e.i) AS n FROM e JOIN p b ON b.symbol=e.symbol AND b.i BETWEEN e.i+1 AND e.i+5 AND b.ts=e.ts+(b.i-e.i)*3600000000 WHERE b.low<=e.close AND b.close>=e.ph AND b.close>b.open GROUP BY 1,2)
SELECT e.symbol, e.ts, CASE WHEN x.ts IS NOT NULL THEN e.ts+c.n*3600000000 END AS confirm_ts, x.ts AS entry_ts FROM e LEFT JOIN c ON c.symbol=e.symbol AND c.ts=e.ts LEFT JOIN barsi x ON x.symbol=e.symbol AND x.ts=e.ts+(c.n+1)*3600000000""")
def _(v):
    d = scan.framed(scan.indexed(v.bars, ["symbol"], ["ts"]), ["symbol"], ["ts"], lambda w: {"prior_high": F.max("high").over(w.rowsBetween(-3, -1))}, back=3, **B)
    return E.confirm_within(d, HOUR, 5, (F.col("close") > F.col("open")) & (F.col("_i") >= 3), **B).select("symbol", "ts", "confirm_ts", "entry_ts")


def day_levels(v):
    """Six-hour lows and highs of a day are its support and resistance levels at every bar of that day."""
    d = F.floor(F.col("ts") / DAY)
    six = v.bars.groupBy("symbol", d.alias("day"), F.floor(F.col("ts") / (6 * HOUR)).alias("q")).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count("*").alias("touches"), F.max("ts").alias("last_touch"))
    lv = lambda k, c: F.struct(F.lit(k).alias("kind"), F.concat(F.lit(k[0]), F.col("q").cast("string")).alias("level_id"), F.col(c).alias("level"))
    six = six.withColumn("l", F.explode(F.array(lv("LOW", "lo"), lv("HIGH", "hi")))).select("symbol", "day", "touches", "last_touch", "l.*")
    return v.bars.select("symbol", "ts", d.alias("day"), "close").join(six, ["symbol", "day"])


@query("range_pairs", "bars", """
q AS (SELECT symbol, ts//86400000000 AS day, ts//21600000000 AS q, min(low) AS lo, max(high) AS hi, count(*) AS touches, max(ts) AS lt FROM bars GROUP BY 1,2,3),
j AS (SELECT b.symbol, b.ts, b.close, s.lo, r.hi, s.touches AS st, r.touches AS rt, s.lt AS sl, r.lt AS rl, 'L' || s.q AS sid, 'H' || r.q AS rid, (s.lo+r.hi)/2 AS mid FROM bars b JOIN q s ON s.symbol=b.symbol AND s.day=b.ts//86400000000 JOIN q r ON r.symbol=b.symbol AND r.day=b.ts//86400000000
 WHERE s.touches>=2 AND r.touches>=2 AND s.lo<b.close AND b.close<r.hi),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY least(st,rt) DESC, st+rt DESC, least(sl,rl) DESC, greatest(sl,rl), sid, rid) AS rn, count(*) OVER (PARTITION BY symbol, ts) AS pairs FROM j WHERE (hi-lo)/mid BETWEEN 0.2 AND 1.99)
SELECT symbol, ts, sid AS s_level_id, rid AS r_level_id, round(mid,6)+0.0 AS midpoint, pairs, round(25*least(1,least(st,rt)/4.0)+20*(1-0.4)+20*0.5+15*(1-0.3)+10*greatest(0,least(1,0.9/1.5))+10*least((ts-least(sl,rl))/3600000000/24.0+0.5,1.0),6)+0.0 AS score FROM k WHERE rn=1""".replace("least((ts-least(sl,rl))/3600000000/24.0+0.5,1.0)", "least(12/24.0,1.0)"))
def _(v):
    d = E.range_pairs(day_levels(v), 0.2, 1.99)
    s = E.descriptive_score(F.least("s_touches", "r_touches"), F.lit(10.0), F.lit(0.75), F.lit(0.3), F.lit(0.9), F.lit(12.0), 25.0, 0.5)
    return rnd(d.withColumn("score", s).select("symbol", "ts", "s_level_id", "r_level_id", "midpoint", "pairs", "score"))


@query("mechanism_scores", "scored", """
x AS (SELECT id, ts, symbol, p_clean AS a, score AS b, p_danger AS c, mae FROM scored)
SELECT id, 'TREND' AS mechanism, round((a+b)/2,8)+0.0 AS score FROM x WHERE a>0.3 AND (a+b)/2>=0.6 UNION ALL SELECT id, 'REVERSAL', round((b+c)/2,8)+0.0 FROM x WHERE c>0.4 AND (b+c)/2>=0.7 UNION ALL SELECT id, 'CARRY', round((a+c+a)/3,8)+0.0 FROM x WHERE mae<0.01 AND (a+c+a)/3>=0.5""")
def _(v):
    x = v.scored.select("id", "ts", "symbol", F.col("p_clean").alias("a"), F.col("score").alias("b"), F.col("p_danger").alias("c"), "mae")
    d = E.mechanism_scores(x, {"TREND": ["a", "b"], "REVERSAL": ["b", "c"], "CARRY": ["a", "c", "a"]}, {"TREND": F.col("a") > 0.3, "REVERSAL": F.col("c") > 0.4, "CARRY": F.col("mae") < 0.01}, {"TREND": 0.6, "REVERSAL": 0.7, "CARRY": 0.5})
    return rnd(d.select("id", "mechanism", d["score"]), 8)


@query("opportunity_families", "barsi", _F + """,
o AS (SELECT symbol, ts, s.side, s.k*ret_short AS rs, s.k*ret_long AS rl, s.k*flow_3 AS fl, volume_ratio AS vr, compression AS cp FROM f, (VALUES ('LONG',1),('SHORT',-1)) s(side,k)),
g AS (SELECT *, concat_ws('|', CASE WHEN rs>0 AND rl>0 AND fl>0 AND vr>=0.8 THEN 'TREND_CONTINUATION' END, CASE WHEN rs>0.3 AND vr>=1.2 AND cp>=0.5 THEN 'BREAKOUT_EXPANSION' END, CASE WHEN rl>0 AND rs<0 AND fl>0 THEN 'PULLBACK_RECLAIM' END, CASE WHEN rl<0 AND rs>0.2 AND fl>0.1 THEN 'CONFIRMED_REVERSAL' END) AS families FROM o)
SELECT symbol, ts, side, families, bool_or(families<>'' AND side='LONG') OVER (PARTITION BY ts, symbol) AND bool_or(families<>'' AND side='SHORT') OVER (PARTITION BY ts, symbol) AS conflict FROM g""")
def _(v):
    d = PN.orient_sides(feats(v).select("symbol", "ts", F.col("ret_short").alias("rs"), F.col("ret_long").alias("rl"), F.col("flow_3").alias("fl"), "volume_ratio", "compression"), signed=["rs", "rl", "fl"])
    c = F.col
    r = {"TREND_CONTINUATION": (c("rs") > 0) & (c("rl") > 0) & (c("fl") > 0) & (c("volume_ratio") >= 0.8), "BREAKOUT_EXPANSION": (c("rs") > 0.3) & (c("volume_ratio") >= 1.2) & (c("compression") >= 0.5),
         "PULLBACK_RECLAIM": (c("rl") > 0) & (c("rs") < 0) & (c("fl") > 0), "CONFIRMED_REVERSAL": (c("rl") < 0) & (c("rs") > 0.2) & (c("fl") > 0.1)}
    return E.opportunity_families(d, r).select("symbol", "ts", "side", F.array_join("families", "|").alias("families"), "conflict")


def catalog_input(v):
    d = feats(v)
    return d.select("symbol", "ts", "open", "close", "prior_high", "prior_low", "volume_ratio", F.col("flow_1").alias("imbalance"), (F.col("ret_mid") / 2).alias("slope"), F.col("ret_short").alias("distance"), F.col("ret_long").alias("slow_distance"),
                    (50 + 50 * F.col("flow_3")).alias("rsi"))


def catalog_grid(v):
    return v.spark.createDataFrame([("mr1", "mean_reversion", 0.3, 0.4, 45.0), ("mr2", "mean_reversion", 0.6, 0.3, 50.0), ("tp1", "trend_pullback", 0.05, 0.0, 0.0), ("br1", "breakout", 0.0, 1.2, 0.0)], "variant string, family string, a double, b double, c double")


_CAT = _F + """,
g AS (SELECT symbol, ts, open, close, prior_high, prior_low, volume_ratio, flow_1 AS imb, ret_mid/2 AS slope, ret_short AS dist, ret_long AS sdist, 50+50*flow_3 AS rsi FROM f),
h AS (SELECT g.*, variant, CASE family WHEN 'mean_reversion' THEN CASE WHEN abs(slope)<=a AND dist<=-b AND rsi<=c THEN 1 WHEN abs(slope)<=a AND dist>=b AND rsi>=100-c THEN -1 ELSE 0 END
 WHEN 'trend_pullback' THEN CASE WHEN sdist>dist AND slope>=a AND dist>0 AND close<open AND rsi BETWEEN 35 AND 60 THEN 1 WHEN sdist<=dist AND slope<=-a AND dist<0 AND close>open AND rsi BETWEEN 40 AND 65 THEN -1 ELSE 0 END
 ELSE CASE WHEN close>prior_high AND volume_ratio>=b AND imb>0 THEN 1 WHEN close<prior_low AND volume_ratio>=b AND imb<0 THEN -1 ELSE 0 END END AS signal
 FROM g, (VALUES ('mr1','mean_reversion',0.3::DOUBLE,0.4::DOUBLE,45::DOUBLE),('mr2','mean_reversion',0.6,0.3,50),('tp1','trend_pullback',0.05,0,0),('br1','breakout',0,1.2,0)) t(variant,family,a,b,c)),
k AS (SELECT * FROM h WHERE signal<>0)
"""


@query("strategy_catalog_signals", "barsi", _CAT + "SELECT symbol, ts, variant, signal FROM k")
def _(v):
    return E.catalog_signals(catalog_input(v), catalog_grid(v)).select("symbol", "ts", "variant", "signal")


@query("memoryless_regime", "barsi", _F + """
SELECT symbol, ts, CASE WHEN ret_long>0.3 THEN 'UP' WHEN ret_long<-0.3 THEN 'DOWN' ELSE 'TRANSITION' END AS direction_regime, CASE WHEN compression<0.4 THEN 'COMPRESSED' WHEN compression>0.8 THEN 'EXPANDING' ELSE 'NORMAL' END AS volatility_regime,
 (CASE WHEN abs(ret_short)<=0.2 AND abs(ret_long)<=0.3 THEN 'RANGE' WHEN ret_short>0 AND ret_long>0 THEN 'TREND_UP' WHEN ret_short<0 AND ret_long<0 THEN 'TREND_DOWN' ELSE 'TRANSITION' END) || CASE WHEN compression>=0.7 THEN '_HIGH_VOL' ELSE '_LOW_VOL' END AS causal,
 CASE WHEN volume_ratio>2.0 OR price_response>3.0 THEN 'HIGH_VOLATILITY' WHEN compression>0.9 THEN 'RANGE' WHEN ret_mid>0.1 THEN 'BULL_TREND' WHEN ret_mid<-0.1 THEN 'BEAR_TREND' ELSE 'TRANSITION' END AS regime,
 round(greatest(0,least(1,0.5+least(0.45,abs(ret_mid)*25+abs(price_response)*0.1+abs(compression-0.5)*0.2))),8)+0.0 AS confidence FROM f""")
def _(v):
    d = feats(v).withColumns(E.direction_volatility("ret_long", "compression", 0.3, 0.4, 0.8)).withColumn("causal", E.causal_regime("ret_short", "ret_long", "compression", 0.2, 0.3, 0.7))
    d = d.withColumns(E.market_regime("ret_mid", "volume_ratio", "price_response", "compression", dict(high_volatility=2.0, expansion=3.0, chop=0.9, trend=0.1)))
    return rnd(d.select("symbol", "ts", "direction_regime", "volatility_regime", "causal", "regime", "confidence"), 8)


@query("hysteresis_regime", "barsi", _F + """,
s AS (SELECT symbol, ts, ret_long AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM f),
r AS (SELECT DISTINCT symbol, 0::BIGINT AS n, 0::BIGINT AS ts, 'TRANSITION' AS cur, 'TRANSITION' AS pen, 0 AS cnt FROM s UNION ALL
 SELECT symbol, n, ts, CASE WHEN cand=cur THEN cur WHEN cand=pen AND cnt+1>=3 THEN cand ELSE cur END, cand, CASE WHEN cand=cur THEN 0 WHEN cand=pen AND cnt+1>=3 THEN 0 WHEN cand=pen THEN cnt+1 ELSE 1 END
 FROM (SELECT s.symbol, s.n, s.ts, r.cur, r.pen, r.cnt, CASE WHEN x>=CASE WHEN cur IN ('BULL','BEAR') THEN 0.3 ELSE 0.5 END THEN 'BULL' WHEN x<=-CASE WHEN cur IN ('BULL','BEAR') THEN 0.3 ELSE 0.5 END THEN 'BEAR' ELSE 'RANGE' END AS cand FROM r JOIN s ON s.symbol=r.symbol AND s.n=r.n+1))
SELECT symbol, ts, cur AS regime FROM r WHERE n>0""".replace("s AS (SELECT symbol, ts, ret_long AS x", "hs AS (SELECT symbol, ts, ret_long AS x").replace("FROM s UNION", "FROM hs UNION").replace("JOIN s ON s.symbol", "JOIN hs s ON s.symbol"))
def _(v):
    return E.hysteresis_regime(feats(v).select("symbol", "ts", "ret_long"), "ret_long", 0.5, 0.3, slice_width=4 * DAY).select("symbol", "ts", "regime")


_EV = {"shock": "volume_ratio>2.5", "local_aligned": "rs>0.1", "local_opposed": "rs<-0.1", "exhausted": "rl>2.0", "no_space": "compression>0.95", "extended": "rl>1.0", "mature": "rm>1.0", "breakout": "rs>0.6",
       "higher_aligned": "rl>0.2", "higher_opposed": "rl<-0.5", "invalidated": "rm<-0.6", "range_state": "abs(rl)<0.2", "inward": "fl>0"}


@query("context_state", "barsi", _F + """,
o AS (SELECT symbol, ts, s.side, s.k*ret_short AS rs, s.k*ret_mid AS rm, s.k*ret_long AS rl, s.k*flow_3 AS fl, volume_ratio, compression FROM f, (VALUES ('LONG',1),('SHORT',-1)) s(side,k)),
e AS (SELECT symbol, ts, side, """ + ", ".join(f"coalesce({q},false) AS {n}" for n, q in _EV.items()) + """ FROM o),
c AS (SELECT *, CASE WHEN shock AND NOT local_aligned THEN 'SHOCK_OR_UNCERTAIN' WHEN exhausted OR (no_space AND (extended OR mature)) THEN 'MATURE_OR_EXHAUSTED' WHEN breakout AND local_aligned AND NOT higher_opposed THEN 'BREAKOUT_OR_RETEST'
 WHEN higher_aligned AND local_aligned AND NOT invalidated THEN 'TREND_CONTINUATION' WHEN higher_aligned AND local_opposed AND NOT invalidated THEN 'PULLBACK_WITHIN_TREND' WHEN range_state AND inward AND NOT no_space THEN 'RANGE_MEAN_REVERSION' WHEN higher_opposed OR invalidated THEN 'REGIME_TRANSITION' ELSE 'UNCERTAIN' END AS st FROM e),
d AS (SELECT symbol || '|' || side || '|' || (ts//14400000000) AS key, (ts//3600000000)%4 AS delay, st, no_space FROM c),
g AS (SELECT key, max(st) FILTER (delay=0) AS initial, min(delay) FILTER (st IN ('TREND_CONTINUATION','BREAKOUT_OR_RETEST') AND NOT no_space AND delay BETWEEN 1 AND 3) AS d FROM d GROUP BY 1)
SELECT key, initial, CASE WHEN initial IN ('TREND_CONTINUATION','BREAKOUT_OR_RETEST') THEN 'ENTER_NOW' WHEN initial='PULLBACK_WITHIN_TREND' THEN coalesce('ENTER_AFTER_' || d || 'M','SKIP_PULLBACK_NOT_REALIGNED') ELSE 'SKIP_' || initial END AS action FROM g""")
def _(v):
    d = PN.orient_sides(feats(v).select("symbol", "ts", F.col("ret_short").alias("rs"), F.col("ret_mid").alias("rm"), F.col("ret_long").alias("rl"), F.col("flow_3").alias("fl"), "volume_ratio", "compression"), signed=["rs", "rm", "rl", "fl"])
    d = d.withColumns({n: F.coalesce(F.expr(q), F.lit(False)) for n, q in _EV.items()})
    d = d.withColumn("context_state", E.context_state({n: F.col(n) for n in _EV}))
    h = F.col("ts") / HOUR
    d = d.select(F.concat_ws("|", "symbol", "side", F.floor(h / 4).cast("string")).alias("key"), F.pmod(h.cast("long"), F.lit(4)).alias("delay"), "context_state", "no_space")
    return E.episode_decision(d, "key", ["TREND_CONTINUATION", "BREAKOUT_OR_RETEST"], ["PULLBACK_WITHIN_TREND"], 3)


_SP = dict(aligned="rl>0.2", invalidated="rm<-0.5", sustained="rm>0.3", space="compression<0.95", range_state="abs(rl)<0.3", inward="fl>0", transition="rm*rl<0", local_aligned="rs>0.1", opposed="rs<-0.1", realigned="rs>0.1 AND fl>0")


def setup_panel(v):
    d = PN.orient_sides(feats(v).select("symbol", "ts", F.col("ret_short").alias("rs"), F.col("ret_mid").alias("rm"), F.col("ret_long").alias("rl"), F.col("flow_3").alias("fl"), "compression"), signed=["rs", "rm", "rl", "fl"])
    return d.withColumns({n: F.expr(q) for n, q in _SP.items()})


_SPS = _F + """,
o AS (SELECT symbol, ts, s.side, s.k*ret_short AS rs, s.k*ret_mid AS rm, s.k*ret_long AS rl, s.k*flow_3 AS fl, compression FROM f, (VALUES ('LONG',1),('SHORT',-1)) s(side,k)),
p AS (SELECT symbol, ts, side, """ + ", ".join(f"{q} AS {n}" for n, q in _SP.items()) + " FROM o)"


@query("setup_candidates", "barsi", _SPS + """
SELECT symbol, ts, side, 'TREND_CONTINUATION' AS strategy, CASE WHEN space IS NULL THEN 'UNKNOWN' WHEN aligned AND sustained AND space AND NOT invalidated THEN 'ELIGIBLE' ELSE 'INELIGIBLE' END AS status,
 CASE WHEN space IS NULL THEN NULL WHEN aligned AND sustained AND space AND NOT invalidated THEN 'TREND_CONFIRMED' WHEN invalidated THEN 'TREND_INVALIDATED' ELSE 'TREND_CANDIDATE' END AS substate, (aligned::INT+(NOT invalidated)::INT+sustained::INT+coalesce(space,false)::INT) AS rules_true FROM p
UNION ALL SELECT symbol, ts, side, 'RANGE_MEAN_REVERSION', CASE WHEN space IS NULL THEN 'UNKNOWN' WHEN range_state AND inward AND space THEN 'ELIGIBLE' ELSE 'INELIGIBLE' END, CASE WHEN space IS NULL THEN NULL WHEN range_state AND inward AND space THEN 'RANGE_CONFIRMED' ELSE 'RANGE_CANDIDATE' END, range_state::INT+inward::INT+coalesce(space,false)::INT FROM p
UNION ALL SELECT symbol, ts, side, 'REGIME_TRANSITION', CASE WHEN space IS NULL THEN 'UNKNOWN' WHEN transition AND local_aligned AND space THEN 'ELIGIBLE' ELSE 'INELIGIBLE' END, CASE WHEN space IS NULL THEN NULL WHEN transition AND local_aligned AND space THEN 'TRANSITION_CONFIRMED' ELSE 'TRANSITION_CANDIDATE' END, transition::INT+local_aligned::INT+coalesce(space,false)::INT FROM p""")
def _(v):
    d = E.setup_candidates(setup_panel(v))
    return d.select("symbol", "ts", "side", "strategy", "status", "substate", F.size(F.filter("rules", lambda x: x["value"])).alias("rules_true"))


@query("setup_pullback_states", "barsi", _SPS + """,
q AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ts) AS n FROM p),
r AS (SELECT DISTINCT symbol, side, 0::BIGINT AS n, 0::BIGINT AS ts, 'ABSENT' AS st FROM q UNION ALL
 SELECT q.symbol, q.side, q.n, q.ts, CASE WHEN coalesce(invalidated,false) THEN 'INVALIDATED' WHEN NOT coalesce(space,false) THEN 'TOO_LATE' WHEN st='FORMING' AND aligned AND realigned THEN 'CONFIRMED' WHEN aligned AND (opposed OR st='FORMING') THEN 'FORMING' ELSE 'ABSENT' END FROM r JOIN q ON q.symbol=r.symbol AND q.side=r.side AND q.n=r.n+1)
SELECT symbol, side, ts, st AS substate FROM r WHERE n>0""")
def _(v):
    return E.pullback_setups(setup_panel(v), 4 * DAY).select("symbol", "side", "ts", "substate")


@query("setup_breakout_retest", "barsi", """
p AS (SELECT *, max(high) OVER l AS ph, min(low) OVER l AS pl, count(*) OVER l AS n FROM barsi WINDOW l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
b AS (SELECT symbol, i, ts, 'LONG' AS side, ph AS lv FROM p WHERE n>=6 AND close>ph UNION ALL SELECT symbol, i, ts, 'SHORT', pl FROM p WHERE n>=6 AND close<pl),
o AS (SELECT b.symbol, b.side, b.ts, b.lv, min(x.ts) FILTER (CASE b.side WHEN 'LONG' THEN x.low<=lv*1.05 AND x.close>lv ELSE x.high>=lv*0.95 AND x.close<lv END) AS ok, min(x.ts) FILTER (CASE b.side WHEN 'LONG' THEN x.close<lv ELSE x.close>lv END) AS bad
 FROM b LEFT JOIN barsi x ON x.symbol=b.symbol AND x.i BETWEEN b.i+1 AND b.i+4 AND x.ts<=b.ts+4*3600000000 GROUP BY 1,2,3,4),
e AS (SELECT *, CASE WHEN ok IS NULL AND bad IS NULL THEN 'RETEST_WINDOW_EXPIRED' WHEN bad IS NULL OR ok<bad THEN 'RETEST_CONFIRMED' ELSE 'CLOSED_BACK_INSIDE' END AS status, coalesce(least(ok,bad), ts+4*3600000000) AS end_ts FROM o),
r AS (SELECT symbol, side, min(ts) AS ts FROM e GROUP BY 1,2 UNION ALL SELECT symbol, side, nx FROM (SELECT r.symbol, r.side, (SELECT min(e2.ts) FROM e e2 WHERE e2.symbol=r.symbol AND e2.side=r.side AND e2.ts>e.end_ts) AS nx FROM r JOIN e ON e.symbol=r.symbol AND e.side=r.side AND e.ts=r.ts) WHERE nx IS NOT NULL)
SELECT e.symbol, e.side, e.ts, e.status, e.end_ts, e.lv AS level FROM e JOIN r USING (symbol, side, ts)""")
def _(v):
    d = scan.framed(scan.indexed(v.bars, ["symbol"], ["ts"]), ["symbol"], ["ts"], lambda w: {"prior_high": W.rolling(w, "high", 6, "max", 1), "prior_low": W.rolling(w, "low", 6, "min", 1)}, back=6, **B)
    return E.breakout_retests(d, HOUR, 4, 0.05).select("symbol", "side", "ts", "status", "end_ts", "level")


_RISKS = {"exhausted": "p_danger>0.8 AND mae>0.012", "no_space": "mfe<0.004", "shock": "mae>0.019"}
_VOTES = {"a": "score<0.3", "b": "p_clean<0.3", "c": "net<-0.02", "d": "mfe<0.01"}


@query("rule_scorecards", "scored", "x AS (SELECT id, " + "+".join(f"({q})::INT" for q in _VOTES.values()) + " AS votes, " + ", ".join(f"{q} AS {n}" for n, q in _RISKS.items()) + """ FROM scored),
y AS (SELECT *, CASE WHEN shock THEN 'shock' WHEN exhausted THEN 'exhausted' WHEN votes>=3 THEN 'opposed' WHEN no_space THEN 'no_space' END AS reason FROM x)
SELECT id, votes, reason, CASE WHEN reason IS NULL THEN 'ENTER' WHEN reason IN ('opposed') THEN 'WAIT' ELSE 'SKIP' END AS action FROM y""")
def _(v):
    return scored_card(v).select("id", "votes", "reason", "action")


PRIORITY = ["shock", "exhausted", "opposed", "no_space"]


def scored_card(v):
    ex = lambda m: {n: F.expr(q) for n, q in m.items()}
    return E.scorecard(v.scored, ex(_RISKS), ex(_VOTES), 3, PRIORITY, ["opposed"])


@query("scorecard_ablation", "scored", "x AS (SELECT net, " + "+".join(f"({q})::INT" for q in _VOTES.values()) + ">=3 AS opposed, " + ", ".join(f"{q} AS {n}" for n, q in _RISKS.items()) + """ FROM scored),
w AS (SELECT w, net, (shock AND w<>'shock') OR (exhausted AND w<>'exhausted') OR (opposed AND w<>'opposed') OR (no_space AND w<>'no_space') AS bl FROM x, (VALUES ('NONE'),('shock'),('exhausted'),('opposed'),('no_space')) t(w))
SELECT w AS without, count(*) AS n, sum(bl::INT)::BIGINT AS blocked, round(avg(net) FILTER (NOT bl),8)+0.0 AS kept_net FROM w GROUP BY 1""")
def _(v):
    d = scored_card(v)
    return rnd(E.scorecard_ablation(d, PRIORITY, F.avg(F.when(~F.col("blocked"), F.col("net"))).alias("kept_net")), 8)


_ARC = {"continuation": {"a": "ret_short>0", "b": "ret_mid>0", "c": "ret_long>0", "d": "flow_3>0", "e": "volume_ratio>=1"}, "reversal": {"a": "ret_long<0", "b": "ret_short>0", "c": "lower_wick>upper_wick", "d": "ret_mid<0"}}


@query("archetype_routing", "barsi", _F + ", n AS (SELECT symbol, ts, " + ", ".join("+".join(f"coalesce({q},false)::INT" for q in g.values()) + f" AS n_{n}" for n, g in _ARC.items()) + """, exp(ret_short/10) AS e0, exp(-ret_long/10) AS e1, exp(0.0) AS e2 FROM f)
SELECT symbol, ts, n_continuation, n_reversal, CASE WHEN n_continuation>=4 AND n_continuation>=n_reversal THEN 'continuation' WHEN n_reversal>=3 AND n_reversal>=n_continuation THEN 'reversal' ELSE 'UNCLASSIFIED' END AS archetype,
 round(e0/(e0+e1+e2),8)+0.0 AS soft_continuation, round(e1/(e0+e1+e2),8)+0.0 AS soft_reversal FROM n""")
def _(v):
    g = {n: {k: F.expr(q) for k, q in m.items()} for n, m in _ARC.items()}
    d = E.archetypes(feats(v), g, {"continuation": F.col("ret_short") / 10, "reversal": -F.col("ret_long") / 10, "other": F.lit(0.0)}, {"continuation": 4, "reversal": 3})
    return rnd(d.select("symbol", "ts", "n_continuation", "n_reversal", "archetype", "soft_continuation", "soft_reversal"), 8)


@query("realised_regime", "bars", """
f AS (SELECT symbol, ts, lead(close,3) OVER w/close-1 AS fu FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT ts, max(fu) FILTER (symbol='purchase') AS rr, avg((fu>0)::INT) AS br FROM f WHERE fu IS NOT NULL GROUP BY 1)
SELECT ts, round(rr,8)+0.0 AS ref_return, round(br,8)+0.0 AS breadth, CASE WHEN rr>=0.2 AND br>=0.6 THEN 'BULLISH' WHEN rr<=-0.2 AND br<=0.4 THEN 'BEARISH' ELSE 'NEUTRAL' END AS realised FROM g WHERE rr IS NOT NULL""")
def _(v):
    d = scan.framed(v.bars, ["symbol"], ["ts"], lambda w: {"future": F.lead("close", 3).over(w) / F.col("close") - 1}, ahead=3).filter("future is not null")
    return rnd(E.realised_regime(d, REF1, 0.2, 0.6), 8)


@query("level_state_features", "barsi", """
z AS (SELECT *, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sup, lag(close,6) OVER o AS p0, close-lag(close) OVER o AS d, coalesce(greatest(0,least(high,lag(high) OVER o)-greatest(low,lag(low) OVER o))/greatest(high-low,1e-12),0) AS ov, coalesce(low>=lag(low) OVER o,false)::INT AS hl,
 abs(lag(close,3) OVER o-lag(open,5) OVER o) AS v1, abs(close-lag(open,2) OVER o) AS v2 FROM barsi WINDOW o AS (PARTITION BY symbol ORDER BY i)),
y AS (SELECT *, sum(abs(d)) OVER w6 AS tv, avg((d<0)::INT) OVER w6 AS ad, sum(d) OVER w3 AS la, sum(d) OVER e3 AS ea, min(low) OVER w3 AS l3, avg((d>0)::INT) OVER w2 AS fo, avg(abs(close-open)) OVER e3 AS b1, avg(abs(close-open)) OVER w3 AS b2, avg(high-low) OVER e3 AS r1, avg(high-low) OVER w3 AS r2, avg(ov) OVER w5 AS o5, avg(hl) OVER w5 AS fe,
 (least(open,close)-low)/greatest(high-low,1e-12) AS wk FROM z WINDOW w2 AS (PARTITION BY symbol ORDER BY i ROWS 1 PRECEDING), w3 AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING), e3 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING), w6 AS (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING)),
x AS (SELECT *, (close-p0)/p0*10000 AS sg, tv/p0*10000 AS tr, abs(p0-sup)/p0*10000 AS pa, abs(close-sup)/close*10000 AS nw, (ea-la)/p0*10000/3 AS ac, greatest(0,sup-l3)/close*10000 AS pe FROM y WHERE p0 IS NOT NULL AND sup IS NOT NULL)
SELECT symbol, ts, round((U((pa-nw)/greatest(pa,10))+U(-sg/greatest(tr,1))+coalesce(abs(sg)/nullif(tr,0),0)+ad+U(0.5+ac/10))/5,6)+0.0 AS approach_score,
 round((U(pe/10)+U(CASE WHEN pe>0 THEN greatest(0,close-sup)/close*10000 ELSE 0 END/25)+wk+U((close-sup)/close*10000/25)+fo)/5,6)+0.0 AS reaction_score,
 round((U(1-b2/greatest(b1,1e-12))+U(1-r2/greatest(r1,1e-12))+U(1-v2/greatest(v1,1e-12))+o5+fe+wk)/6,6)+0.0 AS deceleration_score FROM x""".replace("U(", "greatest(0,least(1,").replace("greatest(0,least(1,(pa-nw)/greatest(pa,10))", "greatest(0,least(1,(pa-nw)/greatest(pa,10)))").replace("-sg/greatest(tr,1))", "-sg/greatest(tr,1)))").replace("0.5+ac/10))/5", "0.5+ac/10)))/5")
       .replace("least(1,pe/10)", "least(1,pe/10))").replace("END/25)", "END/25))").replace("*10000/25)", "*10000/25))").replace("greatest(b1,1e-12))", "greatest(b1,1e-12)))").replace("greatest(r1,1e-12))", "greatest(r1,1e-12)))").replace("greatest(v1,1e-12))", "greatest(v1,1e-12)))"))
def _(v):
    d = scan.framed(scan.indexed(v.bars, ["symbol"], ["ts"]), ["symbol"], ["ts"], lambda w: {"support": F.min("low").over(scan.k_rows(w, 12, 1))}, back=12, **B)
    return rnd(E.level_state(d, 6, **B).select("symbol", "ts", "approach_score", "reaction_score", "deceleration_score"))


@query("confirmed_pivots", "bars", """
x AS (SELECT *, lag(high,1) OVER w AS h1, lag(high,2) OVER w AS h2, lead(high,1) OVER w AS h3, lead(high,2) OVER w AS h4, lag(low,1) OVER w AS l1, lag(low,2) OVER w AS l2, lead(low,1) OVER w AS l3, lead(low,2) OVER w AS l4, lead(ts,2) OVER w AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, r+3600000000 AS available_at, 'HIGH' AS kind, high AS price FROM x WHERE high>h1 AND high>h2 AND high>h3 AND high>h4 UNION ALL SELECT symbol, ts, r+3600000000, 'LOW', low FROM x WHERE low<l1 AND low<l2 AND low<l3 AND low<l4""")
def _(v):
    return E.pivots(v.bars, HOUR, 2, **B)


@query("level_clusters")
def _(v):
    piv = E.pivots(v.bars, HOUR, 2)
    dec = W.atr(v.bars, 12).filter("atr is not null").select("symbol", (F.col("ts") + HOUR).alias("ts"), "atr", F.col("close").alias("price"))
    return E.nearest_levels(E.level_clusters(piv, dec, 24 * HOUR, 0.25, 3 * HOUR))


@query("level_respect", "bars", """
z AS (SELECT symbol, (ts//86400000000+1)*86400000000 AS zt, min(low) AS lo, min(low)*1.5+0.5 AS hi FROM bars GROUP BY 1,2),
n AS (SELECT *, lead(ts,1) OVER w AS t1, lead(ts,2) OVER w AS t2, lead(ts,3) OVER w AS t3, lead(close,1) OVER w AS c1, lead(close,2) OVER w AS c2, lead(high,1) OVER w AS h1, lead(high,2) OVER w AS h2, lead(high,3) OVER w AS h3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
j AS (SELECT z.*, n.ts, n.close, n.low<=hi AND n.high>=lo AS tc, n.low<lo AS pn, n.ts>=zt-12*3600000000 AS nr, (n.close>=lo) OR (t1<zt AND c1>=lo) OR (t2<zt AND c2>=lo) AS bk, greatest(CASE WHEN t1<zt THEN h1-hi END, CASE WHEN t2<zt THEN h2-hi END, CASE WHEN t3<zt THEN h3-hi END) AS aw, greatest(hi-lo,1e-12) AS w
 FROM z JOIN n ON n.symbol=z.symbol AND n.ts>=zt-48*3600000000 AND n.ts<zt),
g AS (SELECT symbol, zt, count(*) AS bars, sum(tc::INT)::BIGINT AS contacts, avg((close>=lo)::INT) FILTER (nr) AS vc, sum(pn::INT)::BIGINT AS pens, avg(coalesce(bk,false)::INT) FILTER (pn) AS rt, sum((close<lo-w)::INT)::BIGINT AS breaks, avg(CASE WHEN aw IS NOT NULL THEN greatest(0,least(1,aw/w)) END) FILTER (tc) AS ay, sum(nr::INT) AS nn, max(ts) FILTER (tc) AS last_touch FROM j GROUP BY 1,2)
SELECT symbol, zt AS zone_ts, bars, contacts, round(vc,8)+0.0 AS valid_closes, pens AS penetrations, breaks, last_touch, round((greatest(0,least(1,contacts/3.0))+coalesce(vc,0)+coalesce(rt,0.5)+coalesce(ay,0)+greatest(0,least(1,1-breaks*5.0/greatest(1,nn))))/5,6)+0.0 AS respect FROM g""")
def _(v):
    z = v.bars.groupBy("symbol", ((F.floor(F.col("ts") / DAY) + 1) * DAY).alias("zone_ts")).agg(F.min("low").alias("lower"), (F.min("low") * 1.5 + 0.5).alias("upper"))
    d = E.level_respect(z, v.bars, HOUR, 48, 12)
    return d.select("symbol", "zone_ts", "bars", "contacts", (F.round("valid_closes", 8) + 0.0).alias("valid_closes"), "penetrations", "breaks", "last_touch", (F.round("respect", 6) + 0.0).alias("respect"))


def chain_sql(src, keys, nxt):
    k = ", ".join(keys) or "1 AS one"
    on = " AND ".join(f"e.{x}=r.{x}" for x in keys) or "true"
    on2 = " AND ".join(f"e2.{x}=r.{x}" for x in keys) or "true"
    rk = ", ".join(f"r.{x}" for x in keys) or "1 AS one"
    g = " GROUP BY " + ", ".join(keys) if keys else ""
    return f"""r AS (SELECT {k}, min(ts) AS ts FROM {src}{g} UNION ALL SELECT * FROM (SELECT {rk}, (SELECT min(e2.ts) FROM {src} e2 WHERE {on2} AND {nxt}) AS ts FROM r JOIN {src} e ON {on} AND e.ts=r.ts) WHERE ts IS NOT NULL)"""


@query("cooldown_thinning", "bars ticks", chain_sql("ticks", ["symbol"], "e2.ts>=r.ts+10800000000") + " SELECT symbol, ts, 'at_least' AS rule FROM r")
def _(v):
    return E.cooldown(v.ticks.select("symbol", "ts"), ["symbol"], 3 * HOUR, slice_width=DAY).withColumn("rule", F.lit("at_least"))


@query("cooldown_thinning_strict", "bars", chain_sql("bars", ["symbol"], "e2.ts>r.ts+10800000000") + " SELECT symbol, ts FROM r")
def _(v):
    return E.cooldown(v.bars.select("symbol", "ts"), ["symbol"], 3 * HOUR, strict=True)


@query("two_level_thinning", "ticks", """
e AS (SELECT symbol, ts, CASE WHEN event_id%3=0 THEN 'A' ELSE 'B' END AS pattern, row_number() OVER (PARTITION BY CASE WHEN event_id%3=0 THEN 'A' ELSE 'B' END ORDER BY ts, symbol) AS n FROM ticks),
r AS (SELECT pattern, n, symbol, ts, true AS ok, ts AS cl, MAP([symbol],[ts]) AS m FROM e WHERE n=1 UNION ALL
 SELECT pattern, n, symbol, ts, k, CASE WHEN k THEN ts ELSE cl END, CASE WHEN k THEN map_concat(m, MAP([symbol],[ts])) ELSE m END FROM (SELECT e.pattern, e.n, e.symbol, e.ts, r.cl, r.m, e.ts-coalesce(r.m[e.symbol],-4e18::BIGINT)>14400000000 AND e.ts-r.cl>3600000000 AS k FROM r JOIN e ON e.pattern=r.pattern AND e.n=r.n+1))
SELECT pattern, symbol, ts FROM r WHERE ok""")
def _(v):
    t = v.ticks.select("symbol", "ts", F.when(F.col("event_id") % 3 == 0, "A").otherwise("B").alias("pattern"))
    return E.two_level_thinning(t, ["pattern"], 4 * HOUR, HOUR, slice_width=2 * DAY).select("pattern", "symbol", "ts")


@query("independent_episodes", "ticks", """
x AS (SELECT symbol, ts, event_id, event_id//20 AS setup, row_number() OVER (PARTITION BY symbol, event_id//20 ORDER BY ts, event_id) AS rn FROM ticks), e AS (SELECT * FROM x WHERE rn=1),
""" + chain_sql("e", ["symbol"], "e2.ts>=r.ts+7200000000") + """
SELECT x.event_id, CASE WHEN rn>1 THEN 'DUPLICATE_SETUP_EPISODE' WHEN r.ts IS NULL THEN 'TEMPORAL_OVERLAP' ELSE 'SELECTED' END AS reason FROM x LEFT JOIN r ON r.symbol=x.symbol AND r.ts=x.ts""")
def _(v):
    t = v.ticks.select("symbol", "ts", "event_id", F.floor(F.col("event_id") / 20).alias("setup"))
    return E.independent_episodes(t, ["symbol"], "setup", 2 * HOUR, "event_id").select("event_id", "reason")


@query("busy_until_free", "barsi", _CAT + """, e AS (SELECT symbol, variant, ts, ts+(CASE WHEN signal>0 THEN 2 ELSE 5 END)*3600000000 AS ex FROM k),
r AS (SELECT symbol, variant, min(ts) AS ts FROM e GROUP BY 1,2 UNION ALL SELECT * FROM (SELECT r.symbol, r.variant, (SELECT min(e2.ts) FROM e e2 WHERE e2.symbol=r.symbol AND e2.variant=r.variant AND e2.ts>e.ex) AS ts FROM r JOIN e ON e.symbol=r.symbol AND e.variant=r.variant AND e.ts=r.ts) WHERE ts IS NOT NULL)
SELECT symbol, variant, ts FROM r""")
def _(v):
    d = E.catalog_signals(catalog_input(v), catalog_grid(v)).select("symbol", "variant", "ts", (F.col("ts") + F.when(F.col("signal") > 0, 2).otherwise(5) * HOUR).alias("exit_ts"))
    return E.non_overlapping_trades(d, ["symbol", "variant"], "exit_ts").select("symbol", "variant", "ts")


@query("opportunity_weights", "scored", """
x AS (SELECT id, id//3 AS opp, net>0 AS k FROM scored)
SELECT id, round(1.0/count(*) OVER (PARTITION BY opp),8)+0.0 AS weight, CASE WHEN k THEN round(1.0/sum(k::INT) OVER (PARTITION BY opp),8)+0.0 END AS local_weight FROM x""")
def _(v):
    d = E.opportunity_weights(v.scored.withColumn("opp", F.floor(F.col("id") / 3)), "opp", F.col("net") > 0)
    return rnd(d.select("id", "weight", "local_weight"), 8)
