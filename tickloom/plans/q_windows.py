"""Section 2.4, rolling and recursive features."""

from pyspark.sql import functions as F

from ..functions.scalars import HOUR, safe_div, taker_imbalance, flag
from ..operators import features83, scan, windows as W
from .base import REF1, Tables, query, r6, rnd

SY = ["symbol"]
B = dict(block=128)


def fr(v: Tables, *stages, back=0, ahead=0, src=None):
    return scan.framed(v.bars if src is None else src, SY, ["ts"], *stages, back=back, ahead=ahead, **B)


@query("returns_lags", "bars", """
SELECT symbol, ts, round(close/lag(close,1) OVER w - 1, 6)+0.0 AS ret_1, round(close/lag(close,3) OVER w - 1, 6)+0.0 AS ret_3,
 round(close/lag(close,6) OVER w - 1, 6)+0.0 AS ret_6, round(ln(close/lag(close,1) OVER w), 6)+0.0 AS log_ret_1,
 round((close/lag(close,1) OVER w - 1)*10000, 4)+0.0 AS ret_1_bps,
 round((close/lag(close,1) OVER w - 1) - (lag(close,1) OVER w/lag(close,2) OVER w - 1), 6)+0.0 AS accel
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(v):
    d = fr(v, lambda w: W.returns(w), back=6).withColumn("ret_1_bps", F.round("ret_1_bps", 4) + 0.0)
    return rnd(d.select("symbol", "ts", "ret_1", "ret_3", "ret_6", "log_ret_1", "ret_1_bps", "accel"))


@query("rolling_stats", "bars", """
SELECT symbol, ts, CASE WHEN count(close) OVER w6 >= 6 THEN round(avg(close) OVER w6, 6)+0.0 END AS mean_6,
 CASE WHEN count(close) OVER w6 >= 6 THEN round(stddev_pop(close) OVER w6, 6)+0.0 END AS std_pop_6,
 CASE WHEN count(close) OVER w6l >= 3 THEN round(stddev_samp(close) OVER w6l, 6)+0.0 END AS std_lag_6,
 CASE WHEN count(high) OVER w12l >= 12 THEN max(high) OVER w12l END AS max_lag_12,
 CASE WHEN count(low) OVER w12l >= 12 THEN min(low) OVER w12l END AS min_lag_12,
 CASE WHEN count(volume) OVER w6 >= 6 THEN round(sum(volume) OVER w6, 4)+0.0 END AS sum_6
FROM bars WINDOW w6 AS (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING),
 w6l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
 w12l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def _(v):
    d = fr(v, lambda w: {
        "mean_6": W.rolling(w, "close", 6, "mean"), "std_pop_6": W.rolling(w, "close", 6, "std_pop"),
        "std_lag_6": W.rolling(w, "close", 6, "std_samp", 1, 3), "max_lag_12": W.rolling(w, "high", 12, "max", 1),
        "min_lag_12": W.rolling(w, "low", 12, "min", 1), "sum_6": F.round(W.rolling(w, "volume", 6, "sum"), 4)}, back=12)
    return rnd(d.select("symbol", "ts", "mean_6", "std_pop_6", "std_lag_6", "max_lag_12", "min_lag_12", "sum_6"))


@query("rolling_median", "bars", """
SELECT symbol, ts, CASE WHEN count(volume) OVER w >= 10 THEN round(median(volume) OVER w, 6)+0.0 END AS med,
 CASE WHEN count(volume) OVER w >= 10 THEN round(volume / median(volume) OVER w, 6)+0.0 END AS ratio
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(v):
    d = fr(v, lambda w: {"med": W.rolling(w, "volume", 20, "median", 1, 10)}, back=20)
    return rnd(d.select("symbol", "ts", "med", (F.col("volume") / F.col("med")).alias("ratio")))


@query("rolling_rank_pct", "barsi", """
SELECT a.symbol, a.ts,
 CASE WHEN count(*) FILTER (b.i > a.i-24) >= 24 THEN round((count(*) FILTER (b.i > a.i-24 AND b.close < a.close)
   + (count(*) FILTER (b.i > a.i-24 AND b.close = a.close) + 1)/2.0)/24.0, 6)::DOUBLE+0.0 END AS average,
 CASE WHEN count(*) FILTER (b.i > a.i-24) >= 24 THEN round(count(*) FILTER (b.i > a.i-24 AND b.close <= a.close)/24.0, 6)+0.0 END AS inclusive,
 CASE WHEN count(*) FILTER (b.i < a.i) >= 24 THEN round(count(*) FILTER (b.i < a.i AND b.close <= a.close)/24.0, 6)+0.0 END AS exclusive
FROM barsi a JOIN barsi b ON a.symbol=b.symbol AND b.i BETWEEN a.i-24 AND a.i GROUP BY a.symbol, a.ts, a.close, a.i""")
def _(v):
    d = fr(v, lambda w: {m: W.rolling_rank(w, "close", 24, m) for m in ("average", "inclusive", "exclusive")}, back=24)
    return rnd(d.select("symbol", "ts", "average", "inclusive", "exclusive"))


@query("rolling_quantile_threshold", "barsi", """
r AS (SELECT *, avg(CASE WHEN close<>0 THEN (high-low)/close ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING) AS rm FROM barsi),
j AS (SELECT a.symbol, a.ts, a.rm, quantile_cont(b.rm, 0.25) q25, quantile_cont(b.rm, 0.75) q75
 FROM r a JOIN r b ON a.symbol=b.symbol AND b.i BETWEEN a.i-47 AND a.i GROUP BY 1,2,3)
SELECT symbol, ts, round(q25,6)+0.0 AS q25, round(q75,6)+0.0 AS q75, rm > q75 + 1e-12 AS high_vol, rm < q25 - 1e-12 AS low_vol FROM j""")
def _(v):
    d = fr(v, lambda w: {"rm": F.avg(safe_div(F.col("high") - F.col("low"), "close")).over(scan.k_rows(w, 6))},
           lambda w: {"q": F.percentile("rm", F.array(F.lit(0.25), F.lit(0.75))).over(scan.k_rows(w, 48))}, back=53)
    return rnd(d.select("symbol", "ts", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"),
                        (F.col("rm") > F.col("q")[1] + 1e-12).alias("high_vol"), (F.col("rm") < F.col("q")[0] - 1e-12).alias("low_vol")))


@query("rolling_beta_corr", "bars", """
x AS (SELECT symbol, ts, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars),
y AS (SELECT x.*, r.ret AS ref_ret FROM x JOIN x r ON x.ts = r.ts AND r.symbol = 'purchase' WHERE x.symbol <> 'purchase'
      AND x.ret IS NOT NULL AND r.ret IS NOT NULL),
z AS (SELECT *, count(*) OVER w AS n, covar_samp(ret, ref_ret) OVER w AS cv, var_samp(ref_ret) OVER w AS vr, corr(ret, ref_ret) OVER w AS cr
      FROM y WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, CASE WHEN n>=24 AND vr>0 THEN round(greatest(-3, least(3, cv/vr)), 6)+0.0 END AS beta,
 CASE WHEN n>=24 THEN round(cr, 6)+0.0 END AS corr FROM z""")
def _(v):
    x = fr(v, lambda w: {"ret": W.ret(w, 1)}, back=1).select("symbol", "ts", "ret").filter("ret is not null")
    ref = x.filter(F.col("symbol") == REF1).select("ts", F.col("ret").alias("ref_ret"))
    y = x.filter(F.col("symbol") != REF1).join(ref, "ts")
    d = fr(v, lambda w: W.beta_corr(w, "ret", "ref_ret", 24, 1, 3.0), back=24, src=y)
    return rnd(d.select("symbol", "ts", "beta", "corr"))


@query("ema_wilder", "barsi", """
e AS (SELECT symbol, i, ts, close AS e6, close AS w14 FROM barsi WHERE i=0 UNION ALL
 SELECT b.symbol, b.i, b.ts, (2.0/7)::DOUBLE*b.close + (5.0/7)::DOUBLE*e.e6, b.close/14 + e.w14*13/14
 FROM e JOIN barsi b ON b.symbol=e.symbol AND b.i=e.i+1)
SELECT symbol, ts, round(e6,6)+0.0 AS ema_6, CASE WHEN i>=13 THEN round(w14,6)+0.0 END AS wilder_14 FROM e""")
def _(v):
    d = scan.affine_scan(v.bars, SY, ["ts"], {"ema_6": ("close", W.span(6)), "wilder_14": ("close", 1 / 14, 14)}, block=64)
    return rnd(d.select("symbol", "ts", "ema_6", "wilder_14"))


@query("ema_reset_on_gap", "bars", """
g AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts) AS seg FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) = 3600000000 THEN 0 ELSE 1 END AS brk FROM bars)),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY ts)-1 AS i FROM g),
e AS (SELECT symbol, seg, i, ts, close AS e FROM n WHERE i=0 UNION ALL
 SELECT b.symbol, b.seg, b.i, b.ts, (2.0/7)::DOUBLE*b.close + (5.0/7)::DOUBLE*e.e FROM e JOIN n b ON b.symbol=e.symbol AND b.seg=e.seg AND b.i=e.i+1)
SELECT symbol, ts, seg::BIGINT AS segment, round(e,6)+0.0 AS ema FROM e""")
def _(v):
    from ..operators import quality
    d = quality.segments(v.bars, HOUR)
    d = scan.affine_scan(d, ["symbol", "segment"], ["ts"], {"ema": ("close", 2 / 7)})
    return rnd(d.select("symbol", "ts", "segment", "ema"))


_WILDER = """
d AS (SELECT symbol, i, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY i) AS d FROM barsi),
e AS (SELECT symbol, i, ts, greatest(d,0)::DOUBLE AS g, greatest(-d,0)::DOUBLE AS l FROM d WHERE i=1 UNION ALL
 SELECT b.symbol, b.i, b.ts, (1.0/7)::DOUBLE*greatest(b.d,0)+(6.0/7)::DOUBLE*e.g, (1.0/7)::DOUBLE*greatest(-b.d,0)+(6.0/7)::DOUBLE*e.l
 FROM e JOIN d b ON b.symbol=e.symbol AND b.i=e.i+1)
"""


@query("rsi", "barsi", _WILDER + """
SELECT b.symbol, b.ts, round(CASE WHEN e.l IS NULL THEN NULL WHEN e.l<=0 THEN 100 WHEN e.g<=0 THEN 0 ELSE 100-100/(1+e.g/e.l) END, 6)+0.0 AS rsi
FROM barsi b LEFT JOIN e ON b.symbol=e.symbol AND b.i=e.i""")
def _(v):
    return rnd(W.rsi(v.bars, 7, block=64).select("symbol", "ts", "rsi"))


_TR = """
t AS (SELECT *, greatest(high-low, abs(high-coalesce(lag(close) OVER w, open)), abs(low-coalesce(lag(close) OVER w, open))) AS tr
 FROM barsi WINDOW w AS (PARTITION BY symbol ORDER BY i))
"""


@query("atr", "barsi", _TR + """
SELECT symbol, ts, round(tr,6)+0.0 AS tr, CASE WHEN count(*) OVER w >= 12 THEN round(avg(tr) OVER w,6)+0.0 END AS atr,
 CASE WHEN count(*) OVER w >= 12 THEN round(avg(tr) OVER w/close,6)+0.0 END AS atr_fraction
FROM t WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 11 PRECEDING)""")
def _(v):
    return rnd(W.atr(v.bars, 12).select("symbol", "ts", "tr", "atr", "atr_fraction"))


@query("atr_wilder_sma_seed", "barsi", _TR + """,
m AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS m FROM t),
e AS (SELECT symbol, i, ts, m AS a FROM m WHERE i=13 UNION ALL
 SELECT b.symbol, b.i, b.ts, b.tr/14 + e.a*13/14 FROM e JOIN m b ON b.symbol=e.symbol AND b.i=e.i+1)
SELECT b.symbol, b.ts, round(e.a,6)+0.0 AS atr FROM barsi b LEFT JOIN e ON b.symbol=e.symbol AND b.i=e.i""")
def _(v):
    return rnd(W.atr(v.bars, 14, "wilder_sma").select("symbol", "ts", "atr"))


@query("path_efficiency_persistence", "bars", """
d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars)
SELECT symbol, ts, CASE WHEN count(d) OVER w>=12 AND sum(abs(d)) OVER w>0 THEN round(abs(close-lag(close,12) OVER o)/sum(abs(d)) OVER w,6)+0.0 END AS efficiency_12,
 CASE WHEN count(d) OVER w>=12 THEN round(avg(sign(d)) OVER w,6)+0.0 END AS persistence_12,
 CASE WHEN count(d) OVER w>=12 AND sum(abs(d)) OVER w>0 THEN round(1-abs(close-lag(close,12) OVER o)/sum(abs(d)) OVER w,6)+0.0 END AS chop_12
FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts)""")
def _(v):
    d = fr(v, lambda w: {"_d": F.col("close") - F.lag("close", 1).over(w)}, lambda w: W.efficiency(w, 12), back=13)
    return rnd(d.select("symbol", "ts", "efficiency_12", "persistence_12", "chop_12"))


@query("breakout_features", "bars", """
x AS (SELECT *, CASE WHEN count(*) OVER w>=12 THEN max(high) OVER w END AS ph, CASE WHEN count(*) OVER w>=12 THEN min(low) OVER w END AS pl
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, ph AS prior_high, pl AS prior_low, round(close/ph-1,6)+0.0 AS breakout_up, round(pl/close-1,6)+0.0 AS breakout_down,
 round((ph-close)/close,6)+0.0 AS dist_high, round((close-pl)/close,6)+0.0 AS dist_low,
 CASE WHEN low<pl AND close>=pl THEN 1.0 ELSE 0.0 END::DOUBLE AS swept_low, CASE WHEN high>ph AND close<=ph THEN 1.0 ELSE 0.0 END::DOUBLE AS swept_high,
 round(avg(CASE WHEN close>ph THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING)-0.5,6)+0.0 AS acceptance FROM x""")
def _(v):
    d = fr(v, lambda w: W.breakout(w, 12), lambda w: {"acceptance": W.acceptance(w, 6)}, back=18)
    return rnd(d.select("symbol", "ts", "prior_high", "prior_low", "breakout_up", "breakout_down", "dist_high", "dist_low",
                        "swept_low", "swept_high", "acceptance"))


@query("run_length_and_trend_age", "barsi", """
s AS (SELECT *, sign(close-open)::INT AS st FROM barsi),
g AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, st ORDER BY i) AS grp FROM s)
SELECT symbol, ts, st AS color, row_number() OVER (PARTITION BY symbol, st, grp ORDER BY i) AS run,
 st*row_number() OVER (PARTITION BY symbol, st, grp ORDER BY i) AS signed_age FROM g""")
def _(v):
    st = F.signum(F.col("close") - F.col("open")).cast("int")
    d = W.run_length(v.bars, st)
    return d.select("symbol", "ts", st.alias("color"), "run", (st * F.col("run")).alias("signed_age"))


@query("exact_candle_run", "bars", """
c AS (SELECT *, sign(close-open) AS k FROM bars),
x AS (SELECT *, lag(k,1) OVER w AS k1, lag(k,2) OVER w AS k2, lag(k,3) OVER w AS k3, lag(ts,3) OVER w AS t3, lead(ts,2) OVER w AS f2,
 lead(k,1) OVER w AS n1, lead(k,2) OVER w AS n2, lead(open,1) OVER w AS e, lead(close,1) OVER w AS c1, lead(close,2) OVER w AS c2,
 greatest(lead(high,1) OVER w, lead(high,2) OVER w) AS hh, least(lead(low,1) OVER w, lead(low,2) OVER w) AS ll
 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, k::DOUBLE AS color, n1::DOUBLE AS next_color, n2::DOUBLE AS second_color, round(c1/e-1,6)+0.0 AS h1_ret, round(c2/e-1,6)+0.0 AS h2_ret,
 round(hh/e-1,6)+0.0 AS h2_mfe, round(ll/e-1,6)+0.0 AS h2_mae
FROM x WHERE k<>0 AND k=k1 AND k=k2 AND k3<>k AND ts-t3=3*3600000000 AND f2-ts=2*3600000000""")
def _(v):
    d = fr(v, lambda w: {**W.candle_runs(w, 3), "_t": F.lag("ts", 3).over(w), "_f": F.lead("ts", 2).over(w)}, back=3, ahead=2)
    d = d.filter(F.col("exact_run") & (F.col("ts") - F.col("_t") == 3 * HOUR) & (F.col("_f") - F.col("ts") == 2 * HOUR))
    return rnd(d.select("symbol", "ts", "color", "next_color", "second_color", "h1_ret", "h2_ret", "h2_mfe", "h2_mae"))


@query("rolling_zscore", "bars", """
SELECT symbol, ts, CASE WHEN count(*) OVER w>=24 AND stddev_pop(close) OVER w>0 THEN round((close-avg(close) OVER w)/stddev_pop(close) OVER w,5)+0.0 END AS z,
 CASE WHEN count(*) OVER w>=24 AND stddev_pop(ln(1+volume)) OVER w>0 THEN round((ln(1+volume)-avg(ln(1+volume)) OVER w)/stddev_pop(ln(1+volume)) OVER w,5)+0.0 END AS z_log_volume
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def _(v):
    d = fr(v, lambda w: {"z": W.zscore(w, "close", 24), "z_log_volume": W.zscore(w, F.log(1 + F.col("volume")), 24)}, back=24)
    return rnd(d.select("symbol", "ts", "z", "z_log_volume"), 5)


_FLOW1 = "x AS (SELECT *, CASE WHEN volume>0 THEN (2*buy_volume-volume)/volume ELSE 0 END AS flow_1, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret_1 FROM bars)"


def flow1(v):
    return fr(v, lambda w: {"ret_1": W.ret(w, 1)}, back=1).withColumn("flow_1", taker_imbalance("volume", "buy_volume"))


@query("flow_features", "bars", _FLOW1 + """,
y AS (SELECT *, sum(buy_volume) OVER w AS b, sum(volume) OVER w AS t, avg(sign(flow_1)) OVER w AS ps, flow_1-lag(flow_1,5) OVER o AS sl,
 avg(flow_1) OVER h AS rc, avg(flow_1) OVER g AS ol, sum(ret_1) OVER w AS r FROM x
 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts), h AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING),
 g AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))
SELECT symbol, ts, round((2*b-t)/t,6)+0.0 AS flow_6, round(abs(ps),6)+0.0 AS flow_persistence_6, round(sl,6)+0.0 AS flow_slope_6,
 round(rc-ol,6)+0.0 AS flow_accel_6,
 CASE WHEN abs((2*b-t)/t) <= 1e-12 THEN NULL ELSE round(coalesce(r/abs((2*b-t)/t),0),6)+0.0 END AS flow_impact_6,
 CASE WHEN abs(ol)<=1e-12 THEN NULL ELSE round(coalesce(abs(rc)/abs(ol),0),6)+0.0 END AS flow_decay_6 FROM y""")
def _(v):
    d = fr(v, lambda w: {**W.flow_features(w, 6), "_ol": F.avg("flow_1").over(scan.k_rows(w, 3, 3))}, back=6, src=flow1(v))
    d = d.withColumn("flow_impact_6", F.when(F.abs("flow_6") > 1e-12, F.col("flow_impact_6"))).withColumn(
        "flow_decay_6", F.when(~F.coalesce(F.abs("_ol") <= 1e-12, F.lit(False)), F.col("flow_decay_6")))
    return rnd(d.select("symbol", "ts", *[f"flow_{x}6" for x in ("", "persistence_", "slope_", "accel_", "impact_", "decay_")]))


def _seq_sql():
    cols = []
    for n in (2, 3, 5, 8):
        w, p = f"w{n}", f"p{n}"
        o = f"lag(open,{n-1}) OVER o"
        tr = f"sum(abs(close-open)) OVER {w}"
        sd = lambda a, b: f"CASE WHEN abs({b})<=1e-15 THEN 0 ELSE ({a})/({b}) END"
        for k, e in {"bull_fraction": f"avg(up) OVER {w}", "higher_close": f"avg(hc) OVER {p}", "higher_high": f"avg(hh) OVER {p}",
                     "higher_low": f"avg(hl) OVER {p}", "overlap": f"avg(ov) OVER {p}", "alternation": f"avg(alt) OVER {p}",
                     "displacement": f"(close-{o})/{o}", "travel": f"{tr}/{o}", "efficiency": sd(f"abs(close-{o})", tr),
                     "impulse_dominance": sd(f"max(abs(close-open)) OVER {w}", tr),
                     "range_compression": sd("high-low", f"avg(high-low) OVER {w}"), "relative_volume": sd("volume", f"avg(volume) OVER {w}"),
                     "buy_ratio": sd(f"sum(buy_volume) OVER {w}", f"sum(volume) OVER {w}")}.items():
            cols.append(f"CASE WHEN count(*) OVER {w}>={n} THEN round({e},8)+0.0 END AS {k}_{n}")
    wins = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS {n-1} PRECEDING), p{n} AS (PARTITION BY symbol ORDER BY ts ROWS {n-2} PRECEDING)" for n in (2, 3, 5, 8))
    return f"""l AS (SELECT *, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl, lag(open) OVER o AS po FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT *, (close>open)::INT AS up, coalesce(close>pc,false)::INT AS hc, coalesce(high>ph,false)::INT AS hh, coalesce(low>pl,false)::INT AS hl,
 coalesce(CASE WHEN greatest(high,ph)-least(low,pl)<=1e-15 THEN 0 ELSE greatest(0,least(high,ph)-greatest(low,pl))/(greatest(high,ph)-least(low,pl)) END,0) AS ov,
 coalesce((close>open)<>(pc>po),false)::INT AS alt FROM l)
SELECT symbol, ts, {', '.join(cols)} FROM x WINDOW o AS (PARTITION BY symbol ORDER BY ts), {wins}"""


@query("candle_sequence_features", "bars", _seq_sql())
def _(v):
    ns = (2, 3, 5, 8)

    def feats(w):
        out = {}
        for n in ns:
            out.update(W.sequence_features(w, n))
        return out
    d = fr(v, W.sequence_inputs, feats, back=9)
    return rnd(d.select("symbol", "ts", *[c for c in d.columns if c[-2:] in ("_2", "_3", "_5", "_8")]), 8)


def _mh_sql():
    cs, ws = [], []
    for k in (3, 6, 12):
        w = f"w{k}"
        hi, lo = f"max(high) OVER {w}", f"min(low) OVER {w}"
        cs += [f"round(close/lag(close,{k}) OVER o-1,5)+0.0 AS ret_{k}", f"CASE WHEN count(flow_1) OVER {w}>={k} THEN round(avg(flow_1) OVER {w},5)+0.0 END AS flow_{k}",
               f"CASE WHEN count(ret_1) OVER {w}>={k} THEN round(stddev_pop(ret_1) OVER {w},5)+0.0 END AS vol_{k}",
               f"round(CASE WHEN {hi}>{lo} THEN (close-{lo})/({hi}-{lo}) ELSE 0.5 END,5)+0.0 AS loc_{k}",
               f"CASE WHEN count(*) OVER {w}>={k} THEN round(close/avg(close) OVER {w}-1,5)+0.0 END AS sma_gap_{k}"]
        ws.append(f"{w} AS (PARTITION BY symbol ORDER BY ts ROWS {k-1} PRECEDING)")
    return _FLOW1 + f" SELECT symbol, ts, {', '.join(cs)} FROM x WINDOW o AS (PARTITION BY symbol ORDER BY ts), {', '.join(ws)}"


@query("multi_horizon_features", "bars", _mh_sql())
def _(v):
    d = fr(v, lambda w: W.multi_horizon(w), back=12, src=flow1(v))
    return rnd(d.select("symbol", "ts", *[f"{p}_{k}" for k in (3, 6, 12) for p in ("ret", "flow", "vol", "loc", "sma_gap")]), 5)


@query("microstructure_pressure", "bars", """
x AS (SELECT *, buy_volume/volume AS br, volume/trades AS atr1, greatest(high-low, abs(high-coalesce(lag(close) OVER o,open)), abs(low-coalesce(lag(close) OVER o,open))) AS tr,
 close-lag(close) OVER o AS d FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT *, count(*) OVER w12 AS n, avg(br) OVER w3 AS b3, count(*) OVER w3 AS n3, avg(br) OVER w12 AS b12, avg(trades) OVER w12 AS tm, avg(volume) OVER w12 AS vm, avg(atr1) OVER w12 AS am, avg(tr) OVER w12 AS atr
 FROM x WINDOW w3 AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING))
SELECT symbol, ts, round(br,6)+0.0 AS taker_1, CASE WHEN n3>=3 THEN round(b3,6)+0.0 END AS taker_3, round(b12,6)+0.0 AS taker_12, round(b3-b12,6)+0.0 AS taker_change,
 round(trades/tm,6)+0.0 AS count_ratio, round(volume/vm,6)+0.0 AS quote_ratio, round(atr1/am,6)+0.0 AS trade_size_ratio,
 round((br-0.5)*tanh(CASE WHEN abs(atr)<=1e-15 THEN 0 ELSE d/atr END),6)+0.0 AS impulse FROM y WHERE n>=12""")
def _(v):
    src = v.bars.withColumns({"buy_ratio": F.col("buy_volume") / F.col("volume"), "avg_trade": F.col("volume") / F.col("trades")})
    d = fr(v, lambda w: {"tr": W.true_range(w)}, lambda w: {"atr": W.rolling(w, "tr", 12, "mean")}, W.pressure, back=13, src=src)
    return rnd(d.filter("atr is not null").select("symbol", "ts", "taker_1", "taker_3", "taker_12", "taker_change", "count_ratio", "quote_ratio", "trade_size_ratio", "impulse"))


@query("flow_sequence_features", "bars", _FLOW1 + """,
y AS (SELECT symbol, ts, avg(flow_1) OVER w3 AS s, avg(flow_1) OVER w12 AS m, close/lag(close,3) OVER o-1 AS a, close/lag(close,12) OVER o-1 AS b
 FROM x WINDOW o AS (PARTITION BY symbol ORDER BY ts), w3 AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING))
SELECT symbol, ts, round(s*a,6)+0.0 AS flow_response_short, round(m*b,6)+0.0 AS flow_response_medium,
 round(abs(s)*(sign(s)<>sign(a))::INT,6)+0.0 AS flow_without_response, round(greatest(-(s*sign(a)),0),6)+0.0 AS adverse_resistance,
 round(s-m,6)+0.0 AS short_minus_medium, round(s-m/2,6)+0.0 AS flow_accel, (s*m<0)::INT::DOUBLE AS flow_reversal, (s*m>0)::INT::DOUBLE AS flow_persist
FROM y WHERE b IS NOT NULL""")
def _(v):
    d = fr(v, lambda w: {"s": W.rolling(w, "flow_1", 3, "mean"), "m": W.rolling(w, "flow_1", 12, "mean"), "a": W.ret(w, 3), "b": W.ret(w, 12)},
           back=12, src=flow1(v)).filter("b is not null")
    d = d.withColumns(W.flow_sequence("s", "m", "a", "b"))
    return rnd(d.select("symbol", "ts", "flow_response_short", "flow_response_medium", "flow_without_response", "adverse_resistance",
                        "short_minus_medium", "flow_accel", "flow_reversal", "flow_persist"))


@query("local_feature_vector_83", "barsi", features83.oracle_body())
def _(v):
    d = features83.features(v.bars, REF1, "signup", block=128)
    return rnd(d.select("symbol", "ts", *features83.NAMES), 5)
