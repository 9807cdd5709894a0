"""Whole research flows composed from the operators."""

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import HOUR, flag, safe_div, side_sign, taker_imbalance
from ..operators import events as E, joins as J, panel as PN, paths as P, resample as R, scan, stats as ST, windows as W
from .base import REF1, Tables, query, rnd
from .q_events import _WAVE, chain_sql

FV, AD, CO = 0.6, 0.4, 0.0015


def event_study(v: Tables, step: int = HOUR, look: int = 6, horizon: int = 6) -> DataFrame:
    """Ticks -> bars -> lagged levels -> breakout events both ways -> forward paths -> triple barrier -> economics."""
    bars = R.ticks_to_bars(v.ticks, step)
    d = scan.framed(scan.indexed(bars, ["symbol"], ["ts"]), ["symbol"], ["ts"],
                    lambda w: {"hi": W.rolling(w, "high", look, "max", 1), "lo": W.rolling(w, "low", look, "min", 1), "vm": W.rolling(w, "volume", look, "mean", 1)}, back=look)
    d = P.forward_path(d, step, horizon)
    side = F.when((F.col("close") > F.col("hi")) & (F.col("volume") > F.col("vm")), "LONG").when((F.col("close") < F.col("lo")) & (F.col("volume") < F.col("vm")), "SHORT")
    d = d.withColumn("side", side).filter("side is not null")
    d = P.triple_barrier(P.excursions(d, floor=True), FV, AD, CO)
    return rnd(ST.economic_summary(d, "utility", ["side"]), 6)


@query("flow_event_study", "pl", f"""
l AS (SELECT symbol, ts, close, volume, max(high) OVER w AS hi, min(low) OVER w AS lo, avg(volume) OVER w AS vm, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
e AS (SELECT symbol, ts, CASE WHEN close>hi AND volume>vm THEN 'LONG' WHEN close<lo AND volume<vm THEN 'SHORT' END AS side FROM l WHERE n>=6),
x AS (SELECT symbol, ts, side, min(k) FILTER (fav>={FV}) AS hf, min(k) FILTER (adv>={AD}) AS ha, arg_max(r,k) AS term, greatest(0,max(fav)) AS mfe, greatest(0,max(adv)) AS mae FROM pl JOIN e USING (symbol, ts, side) GROUP BY 1,2,3),
u AS (SELECT *, CASE WHEN ha IS NOT NULL AND (hf IS NULL OR ha<=hf) THEN -{AD}-{CO} WHEN hf IS NOT NULL THEN {FV}-{CO} ELSE term-{CO} END AS net FROM x),
s AS (SELECT side, symbol, count(*) AS n, sum(net) AS s FROM u GROUP BY 1,2), t AS (SELECT side, max(n) AS m, sum((s>0)::INT)::BIGINT AS p FROM s GROUP BY 1)
SELECT side, count(*) AS n, round(avg(net),6)+0.0 AS expectancy, round(CASE WHEN sum(greatest(-net,0))>0 THEN sum(greatest(net,0))/sum(greatest(-net,0)) WHEN sum(greatest(net,0))>0 THEN 'inf'::DOUBLE ELSE 0 END,6)+0.0 AS profit_factor, round(avg((net>0)::INT),6)+0.0 AS win_rate, round(avg(mae),6)+0.0 AS mean_mae, round(avg(mfe),6)+0.0 AS mean_mfe,
 round(any_value(m)/count(*)::DOUBLE,6)+0.0 AS max_symbol_share, any_value(p) AS positive_symbols FROM u JOIN t USING (side) GROUP BY 1""")
def _(v):
    return event_study(v)


@query("flow_mechanism_backcast", "barsi", """
a AS (SELECT *, CASE WHEN volume>0 THEN (2*buy_volume-volume)/volume ELSE 0 END AS f1 FROM barsi),
f AS (SELECT symbol, ts, i, close/lag(close,3) OVER o-1 AS r3, close/lag(close,12) OVER o-1 AS r12, avg(f1) OVER w3 AS fl, volume/avg(volume) OVER l12 AS vr, lead(open,1) OVER o AS en, lead(close,3) OVER o AS ex, lead(ts,3) OVER o AS t3, max(high) OVER n3 AS hh, min(low) OVER n3 AS ll
 FROM a WINDOW o AS (PARTITION BY symbol ORDER BY i), w3 AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING), l12 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), n3 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
g AS (SELECT f.*, r3-max(CASE WHEN symbol='purchase' THEN r3 END) OVER (PARTITION BY ts) AS rel, 2*avg((r3>0)::INT) OVER (PARTITION BY ts)-1 AS br FROM f WHERE i>=12),
sd AS (SELECT symbol, ts, s.side, s.k*r3 AS a, s.k*r12 AS b, s.k*fl AS c, vr AS d, s.k*rel AS e, s.k*br AS br, s.k*(ex/en-1) AS gross, greatest(0,CASE s.side WHEN 'LONG' THEN hh/en-1 ELSE 1-ll/en END) AS mfe, greatest(0,CASE s.side WHEN 'LONG' THEN 1-ll/en ELSE hh/en-1 END) AS mae, t3-ts=3*3600000000 AS ok FROM g, (VALUES ('LONG',1),('SHORT',-1)) s(side,k)),
q AS (SELECT quantile_cont(a,0.5) AS ca, quantile_cont(a,0.75)-quantile_cont(a,0.25) AS sa, quantile_cont(a,0.001) AS la, quantile_cont(a,0.999) AS ha, quantile_cont(b,0.5) AS cb, quantile_cont(b,0.75)-quantile_cont(b,0.25) AS sb, quantile_cont(b,0.001) AS lb, quantile_cont(b,0.999) AS hb,
 quantile_cont(c,0.5) AS cc, quantile_cont(c,0.75)-quantile_cont(c,0.25) AS sc, quantile_cont(c,0.001) AS lc, quantile_cont(c,0.999) AS hc FROM sd WHERE ts<1705363200000000),
z AS (SELECT sd.*, greatest(-8,least(8,(greatest(la,least(ha,a))-ca)/sa)) AS za, greatest(-8,least(8,(greatest(lb,least(hb,b))-cb)/sb)) AS zb, greatest(-8,least(8,(greatest(lc,least(hc,c))-cc)/sc)) AS zc FROM sd, q),
m AS (SELECT *, 'TREND' AS mechanism, (za+zb+zc)/3 AS score FROM z WHERE c>0 AND d>=0.8 UNION ALL SELECT *, 'REVERSAL', (-zb+za)/2 FROM z WHERE b<0 AND a>0 AND br>-0.5),
w AS (SELECT *, row_number() OVER (PARTITION BY mechanism, ts ORDER BY score DESC, symbol, side) AS rn FROM m WHERE score IS NOT NULL), k AS (SELECT * FROM w WHERE rn=1),
""" + chain_sql("k", ["mechanism", "symbol"], "e2.ts>=r.ts+43200000000") + """,
y AS (SELECT k.*, gross-0.0014 AS net FROM k JOIN r USING (mechanism, symbol, ts) WHERE ok)
SELECT mechanism, side, count(*) AS n, round(avg(net),6)+0.0 AS expectancy, round(avg((net>0)::INT),6)+0.0 AS win_rate, round(avg(mae),6)+0.0 AS mean_mae, round(avg(mfe),6)+0.0 AS mean_mfe FROM y GROUP BY 1,2""")
def _(v):
    """Frozen cross-sectional mechanisms: features, panel, scales on training rows, winners, thinning, outcomes."""
    b = v.bars.withColumn("f1", taker_imbalance("volume", "buy_volume"))
    d = scan.framed(scan.indexed(b, ["symbol"], ["ts"]), ["symbol"], ["ts"], lambda w: {
        "r3": W.ret(w, 3), "r12": W.ret(w, 12), "fl": F.avg("f1").over(scan.k_rows(w, 3)), "vr": safe_div("volume", F.avg("volume").over(scan.k_rows(w, 12, 1))), "en": F.lead("open", 1).over(w), "ex": F.lead("close", 3).over(w),
        "t3": F.lead("ts", 3).over(w), "hh": F.max("high").over(w.rowsBetween(1, 3)), "ll": F.min("low").over(w.rowsBetween(1, 3))}, back=12, ahead=3).filter("_i >= 12")
    d = J.attach_reference(d, {"ref": REF1}, ["r3"])
    d = d.withColumns({"rel": F.col("r3") - F.col("ref_r3"), "br": 2 * F.avg(flag(F.col("r3") > 0)).over(PN.at_ts()) - 1})
    d = d.select("symbol", "ts", F.col("r3").alias("a"), F.col("r12").alias("b"), F.col("fl").alias("c"), F.col("vr").alias("d"), "br", "en", "ex", "hh", "ll", (F.col("t3") - F.col("ts") == 3 * HOUR).alias("ok"))
    d = scan.pin(PN.orient_sides(d, signed=["a", "b", "c", "br"]))
    raw = d.withColumns({"za": F.col("a"), "zb": F.col("b"), "zc": F.col("c")})
    fit = PN.fit_robust_scale(raw.filter("ts < 1705363200000000"), ["za", "zb", "zc"])
    z = PN.apply_robust_scale(raw, fit, ["za", "zb", "zc"]).withColumn("nb", -F.col("zb"))
    m = E.mechanism_scores(z, {"TREND": ["za", "zb", "zc"], "REVERSAL": ["nb", "za"]}, {"TREND": (F.col("c") > 0) & (F.col("d") >= 0.8), "REVERSAL": (F.col("b") < 0) & (F.col("a") > 0) & (F.col("br") > -0.5)}, {"TREND": -1e9, "REVERSAL": -1e9})
    k = PN.top_k_per(m, ["mechanism", "ts"], 1, F.col("score").desc(), "symbol", "side")
    k = E.cooldown(k, ["mechanism", "symbol"], 12 * HOUR).filter("ok")
    up, dn = F.col("hh") / F.col("en") - 1, 1 - F.col("ll") / F.col("en")
    long = F.col("side") == "LONG"
    k = k.withColumns({"net": side_sign() * (F.col("ex") / F.col("en") - 1) - 0.0014, "mfe": F.greatest(F.lit(0.0), F.when(long, up).otherwise(dn)), "mae": F.greatest(F.lit(0.0), F.when(long, dn).otherwise(up))})
    return rnd(ST.economic_summary(k, "net", ["mechanism", "side"]).select("mechanism", "side", "n", "expectancy", "win_rate", "mean_mae", "mean_mfe"))


@query("flow_volume_wave_study", "barsi", "wv AS (WITH " + _WAVE.strip().replace("\nSELECT v.symbol", " SELECT v.symbol", 1) + """),
c AS (SELECT *, row_number() OVER () AS rid FROM wv), e AS (SELECT symbol, side, variant, entry_ts AS ts, min(entry_price) AS ep FROM c GROUP BY 1,2,3,4),
""" + chain_sql("e", ["symbol", "side", "variant"], "e2.ts>=r.ts+14400000000") + """,
k AS (SELECT e.* FROM e JOIN r USING (symbol, side, variant, ts)),
p AS (SELECT k.*, (b.ts-k.ts)//3600000000+1 AS k, CASE k.side WHEN 'LONG' THEN b.high/ep-1 ELSE 1-b.low/ep END AS fav, CASE k.side WHEN 'LONG' THEN 1-b.low/ep ELSE b.high/ep-1 END AS adv, CASE k.side WHEN 'LONG' THEN 1 ELSE -1 END*(b.close/ep-1) AS rr FROM k JOIN bars b ON b.symbol=k.symbol AND b.ts BETWEEN k.ts AND k.ts+3*3600000000),
g AS (SELECT * FROM (VALUES ('N',4,0.3::DOUBLE,0.3::DOUBLE),('W',4,0.8,0.4)) t(contract,h,f,a)),
x AS (SELECT symbol, side, variant, ts, contract, any_value(f) AS f, any_value(a) AS a, min(k) FILTER (fav>=f) AS hf, min(k) FILTER (adv>=a) AS ha, arg_max(rr,k) AS term, greatest(0,max(fav)) AS mfe, greatest(0,max(adv)) AS mae FROM p, g GROUP BY 1,2,3,4,5),
u AS (SELECT *, CASE WHEN ha IS NOT NULL AND (hf IS NULL OR ha<=hf) THEN -a-0.0015 WHEN hf IS NOT NULL THEN f-0.0015 ELSE term-0.0015 END AS net FROM x)
SELECT variant, contract, count(*) AS n, round(avg(net),6)+0.0 AS expectancy, round(avg((net>0)::INT),6)+0.0 AS win_rate, round(avg(mae),6)+0.0 AS mean_mae, round(avg(mfe),6)+0.0 AS mean_mfe FROM u GROUP BY 1,2""")
def _(v):
    """Impulse events, entry variants, cooldown per stratum, minute-style paths, contract grid, economics."""
    d = W.atr(scan.indexed(v.bars, ["symbol"], ["ts"]), 6)
    d = scan.framed(d, ["symbol"], ["ts"], lambda w: {"volume_ratio": safe_div("volume", F.avg("volume").over(scan.k_rows(w, 6, 1)))}, back=6)
    d = E.wave_events(d.withColumn("body_atr", safe_div(F.abs(F.col("close") - F.col("open")), "atr")), HOUR, 1.0, 0.5, 4)
    e = d.groupBy("symbol", "side", "variant", F.col("entry_ts").alias("ts")).agg(F.min("entry_price").alias("entry_price"))
    k = E.cooldown(e, ["symbol", "side", "variant"], 4 * HOUR)
    p = _paths(k, v.bars)
    g = v.spark.createDataFrame([("N", 4, 0.3, 0.3), ("W", 4, 0.8, 0.4)], "contract string, horizon int, fav double, adv double")
    u = P.triple_barrier_grid(P.excursions(p, floor=True), g, CO)
    return rnd(ST.economic_summary(u, "utility", ["variant", "contract"]).select("variant", "contract", "n", "expectancy", "win_rate", "mean_mae", "mean_mfe"))


def _paths(k: DataFrame, bars: DataFrame) -> DataFrame:
    ev = k.select("symbol", "side", "variant", F.col("ts").alias("event_ts"))
    return P.path_at(ev, bars, "event_ts", HOUR, 4, ["symbol", "side", "variant", "event_ts"])
