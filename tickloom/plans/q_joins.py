"""Section 2.5."""

from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR
from ..operators import joins as J, paths, resample, scan
from .base import REF1, REF2, query, rnd


@query("asof_backward", "ticks bars funding", """
SELECT b.symbol, b.ts, f.rate, b.ts-f.ts AS age, CASE WHEN b.ts-f.ts<=3600000000 THEN f.rate END AS fresh_rate FROM bars b ASOF LEFT JOIN (SELECT ts, arg_max(rate,event_id) AS rate FROM funding GROUP BY 1) f ON b.ts>=f.ts""")
def _(v):
    l = v.bars.select("symbol", "ts")
    d = J.asof_join(l, v.funding, by=[], columns=["rate"], right_tie="event_id", age="age")
    return d.withColumn("fresh_rate", F.when(F.col("age") <= HOUR, F.col("rate")))


@query("asof_strict_by_symbol", "ticks signals", """
SELECT s.signal_id, t.price AS last_price, s.ts-t.ts AS age FROM signals s ASOF LEFT JOIN ticks t ON s.symbol=t.symbol AND s.ts>t.ts""")
def _(v):
    d = J.asof_join(v.signals.select("signal_id", "symbol", "ts"), v.ticks.select("symbol", "ts", F.col("price").alias("last_price")), allow_exact=False, age="age")
    return d.select("signal_id", "last_price", "age")


@query("asof_forward_first_bar", "bars signals", """
SELECT s.signal_id, b.ts AS bar_ts, b.open FROM signals s ASOF LEFT JOIN bars b ON s.symbol=b.symbol AND s.ts<=b.ts""")
def _(v):
    d = J.asof_join(v.signals.select("signal_id", "symbol", "ts"), v.bars.select("symbol", "ts", F.col("ts").alias("bar_ts"), "open"), direction="forward")
    return d.select("signal_id", "bar_ts", "open")


@query("asof_multi_timeframe", "bars bars6 signals", """
d AS (SELECT symbol, (ts//86400000000+1)*86400000000 AS av, last(close ORDER BY ts) AS c FROM bars GROUP BY 1,2),
r AS (SELECT ts+3600000000 AS av, close AS c FROM bars WHERE symbol='purchase')
SELECT s.signal_id, h.close AS h1, s.ts-h.ts-3600000000 AS h1_age, x.close AS h6, s.ts-x.ts-21600000000 AS h6_age, d.c AS d1, s.ts-d.av AS d1_age
FROM signals s ASOF LEFT JOIN bars h ON s.symbol=h.symbol AND s.ts>=h.ts+3600000000 ASOF LEFT JOIN bars6 x ON s.symbol=x.symbol AND s.ts>=x.ts+21600000000 ASOF LEFT JOIN d ON s.symbol=d.symbol AND s.ts>=d.av""")
def _(v):
    at = lambda df, w: df.select("symbol", (F.col("ts") + w).alias("ts"), "close")
    day = v.bars.groupBy("symbol", ((F.floor(F.col("ts") / DAY) + 1) * DAY).alias("ts")).agg(F.max_by("close", v.bars.ts).alias("close"))
    d = J.mtf_panel(v.signals.select("signal_id", "symbol", "ts"), {"h1": at(v.bars, HOUR), "h6": at(v.bars6, 6 * HOUR), "d1": day})
    return d.select("signal_id", *[F.col(f"{k}.close").alias(k) for k in ("h1", "h6", "d1")], "h1_age", "h6_age", "d1_age")


@query("equi_one_to_one", "bars bars6", "SELECT a.symbol, a.ts, a.close AS c1, b.close AS c6 FROM bars a LEFT JOIN bars6 b ON a.symbol=b.symbol AND (a.ts//21600000000)*21600000000=b.ts")
def _(v):
    a = v.bars.select("symbol", F.col("ts").alias("t1"), F.col("close").alias("c1"), (F.col("ts") - F.pmod("ts", F.lit(6 * HOUR))).alias("ts"))
    return J.join_validated(a, v.bars6.select("symbol", "ts", F.col("close").alias("c6")), ["symbol", "ts"], "m:1", "left").select("symbol", F.col("t1").alias("ts"), "c1", "c6")


@query("reference_symbol_join", "bars", """
SELECT b.symbol, b.ts, r.close AS btc_close, s.close AS eth_close, r.volume AS btc_volume, s.volume AS eth_volume FROM bars b LEFT JOIN bars r ON b.ts=r.ts AND r.symbol='purchase' LEFT JOIN bars s ON b.ts=s.ts AND s.symbol='signup'""")
def _(v):
    d = J.attach_reference(v.bars, {"btc": REF1, "eth": REF2}, ["close", "volume"])
    return d.select("symbol", "ts", "btc_close", "eth_close", "btc_volume", "eth_volume")


def _range_sql(c):
    a, b = (">=" if c[0] == "[" else ">"), ("<=" if c[1] == "]" else "<")
    return f"SELECT s.signal_id, '{c}' AS closed, count(t.ts) AS n, round(sum(t.price),4)+0.0 AS total, max(t.price) AS high FROM signals s LEFT JOIN ticks t ON s.symbol=t.symbol AND t.ts{a}s.ts-21600000000 AND t.ts{b}s.ts GROUP BY 1"


@query("range_join_window", "ticks signals", " UNION ALL ".join(_range_sql(c) for c in ("(]", "[)", "[]")))
def _(v):
    l = v.signals.select("signal_id", "symbol", (F.col("ts") - 6 * HOUR).alias("lo"), F.col("ts").alias("hi"))
    one = lambda c: J.range_agg(l, v.ticks.select("symbol", "ts", "price"), "lo", "hi", {"n": ("count", "ts"), "total": ("sum", "price"), "high": ("max", "price")}, c, 6 * HOUR, ["signal_id"]).select(
        "signal_id", F.lit(c).alias("closed"), F.coalesce("n", F.lit(0)).alias("n"), "total", "high")
    return rnd(J.union_pieces([one(c) for c in ("(]", "[)", "[]")]), 4)


@query("range_sum_funding", "signals funding", """
SELECT s.signal_id, round(coalesce(sum(f.rate),0),9)+0.0 AS funding, count(f.ts)::DOUBLE AS n FROM signals s LEFT JOIN funding f ON f.ts>=s.ts AND f.ts<s.ts+172800000000 GROUP BY 1""")
def _(v):
    l = v.signals.select("signal_id", F.col("ts").alias("lo"), (F.col("ts") + 2 * DAY).alias("hi"))
    return rnd(J.range_sum(l, v.funding, "lo", "hi", {"funding": "rate", "n": F.lit(1.0)}, "[)").select("signal_id", "funding", "n"), 9)


@query("path_join_forward", "bars signals", """
w AS (SELECT signal_id, symbol, ((ts+3600000000-1)//3600000000)*3600000000 AS st FROM signals),
j AS (SELECT w.signal_id, b.* FROM w JOIN bars b ON b.symbol=w.symbol AND b.ts BETWEEN w.st AND w.st+5*3600000000)
SELECT signal_id, first(open ORDER BY ts) AS entry, list(close ORDER BY ts)[6] AS last_close, max(high) AS high, count(*)::INT AS bars FROM j GROUP BY 1 HAVING count(*)=6""")
def _(v):
    s = v.signals.withColumn("start", F.ceil(F.col("ts") / HOUR) * HOUR)
    d = paths.path_at(s, v.bars, "start", HOUR, 6, ["signal_id"])
    return d.select("signal_id", "entry", F.element_at("path", -1)["c"].alias("last_close"), F.array_max(F.transform("path", lambda x: x["h"])).alias("high"), F.size("path").alias("bars"))


@query("nearest_event_distance", "bars", """
p AS (SELECT symbol, ts FROM bars WHERE close>100), x AS (SELECT b.symbol, b.ts, least(b.ts-l.ts, r.ts-b.ts) AS distance FROM bars b ASOF LEFT JOIN p l ON b.symbol=l.symbol AND b.ts>=l.ts ASOF LEFT JOIN p r ON b.symbol=r.symbol AND b.ts<=r.ts)
SELECT symbol, ts, distance FROM x WHERE distance = 0 OR distance > 2*3600000000""")
def _(v):
    d = J.nearest_distance(v.bars.select("symbol", "ts", "close"), F.col("close") > 100)
    return d.filter((F.col("distance") == 0) | (F.col("distance") > 2 * HOUR)).select("symbol", "ts", "distance")


@query("semi_anti_filter", "bars signals", """
k AS (SELECT symbol, (ts//3600000000)*3600000000 AS ts FROM signals)
SELECT symbol, ts, 'kept' AS part FROM bars WHERE (symbol, ts) NOT IN (SELECT symbol, ts FROM k) AND ts IN (SELECT ts FROM bars WHERE symbol='purchase')
UNION ALL SELECT symbol, ts, 'selected' FROM bars WHERE (symbol, ts) IN (SELECT symbol, ts FROM k)""")
def _(v):
    k = v.signals.select("symbol", (F.col("ts") - F.pmod("ts", F.lit(HOUR))).alias("ts"))
    b = v.bars.select("symbol", "ts")
    kept = b.join(k, ["symbol", "ts"], "left_anti").join(b.filter(F.col("symbol") == REF1).select("ts"), "ts", "left_semi")
    return kept.select("symbol", "ts", F.lit("kept").alias("part")).unionByName(b.join(k, ["symbol", "ts"], "left_semi").withColumn("part", F.lit("selected")))


@query("paired_decision_join", "scored", """
a AS (SELECT id, score, side FROM scored WHERE id%3<>0), b AS (SELECT id, p_clean AS score, CASE WHEN p_danger>0.8 THEN 'NO_TRADE' ELSE side END AS side FROM scored WHERE id%5<>0)
SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS matched, count(*) FILTER (b.id IS NULL) AS only_a, count(*) FILTER (a.id IS NULL) AS only_b,
 round(avg(a.score) FILTER (b.id IS NOT NULL),8)+0.0 AS a_mean, round(avg(b.score) FILTER (a.id IS NOT NULL),8)+0.0 AS b_mean, round(avg((a.side='NO_TRADE')::INT) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL),8)+0.0 AS a_no_trade,
 round(avg((b.side='NO_TRADE')::INT) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL),8)+0.0 AS b_no_trade, round(avg((a.side=b.side)::INT) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL),8)+0.0 AS side_agreement FROM a FULL JOIN b ON a.id=b.id""")
def _(v):
    a = v.scored.filter("id % 3 <> 0").select("id", "score", "side")
    b = v.scored.filter("id % 5 <> 0").select("id", F.col("p_clean").alias("score"), F.when(F.col("p_danger") > 0.8, "NO_TRADE").otherwise(F.col("side")).alias("side"))
    return rnd(J.paired_compare(a, b, ["id"]), 8)


@query("signal_outcome_join", "scored", """
SELECT symbol, count(*) AS n, round(corr(score, net),6)+0.0 AS score_return_corr, sum((regime='F')::INT)::BIGINT AS regime_f, sum((regime='O')::INT)::BIGINT AS regime_o FROM scored GROUP BY 1""")
def _(v):
    sig = v.scored.select("id", "symbol", F.struct("score", "regime").alias("evidence")).select("id", "symbol", "evidence.*")
    d = J.join_outcomes(sig, v.scored.select("id", "net"), "id", {"regime": ["F", "O"]})
    return rnd(d.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("score", "net").alias("score_return_corr"), F.sum("regime_F").alias("regime_f"), F.sum("regime_O").alias("regime_o")))


@query("causal_predecessor_match", "scored", """
a AS (SELECT id, symbol, side, id//40 AS ep, ts FROM scored WHERE regime='F'), b AS (SELECT id, symbol, side, id//40 AS ep, ts FROM scored WHERE regime<>'F')
SELECT a.id, count(b.id) AS matches, arg_max(b.id, b.ts::HUGEINT*100000000+b.id) AS previous_id FROM a LEFT JOIN b ON a.symbol=b.symbol AND a.side=b.side AND a.ep=b.ep AND b.ts<=a.ts GROUP BY 1""")
def _(v):
    x = v.scored.select("id", "symbol", "side", "regime", F.floor(F.col("id") / 40).alias("ep"), F.col("ts").alias("entry_at"))
    return J.match_predecessor(x.filter("regime = 'F'"), x.filter("regime <> 'F'"), ["symbol", "side", "ep"], strict=False)


@query("signal_to_fill_match", "ticks signals", """
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, signal_id) AS i FROM signals), f AS (SELECT event_id, symbol, ts, price FROM ticks WHERE sgn<0),
r AS (SELECT symbol, 0::BIGINT AS i, NULL::BIGINT AS signal_id, -1::BIGINT AS used, NULL::BIGINT AS fts FROM s GROUP BY 1 UNION ALL
 SELECT s.symbol, s.i, s.signal_id, greatest(r.used, coalesce((SELECT min(f.ts) FROM f WHERE f.symbol=s.symbol AND f.ts>=s.ts AND f.ts<=s.ts+18000000000 AND f.ts>r.used), -1)),
  (SELECT min(f.ts) FROM f WHERE f.symbol=s.symbol AND f.ts>=s.ts AND f.ts<=s.ts+18000000000 AND f.ts>r.used) FROM r JOIN s ON s.symbol=r.symbol AND s.i=r.i+1)
SELECT s.signal_id, f.event_id AS fill_id, f.ts AS fill_ts, round((s.ref_price-f.price)/s.ref_price,8)+0.0 AS slippage FROM s JOIN r ON s.signal_id=r.signal_id LEFT JOIN f ON f.symbol=s.symbol AND f.ts=r.fts""")
def _(v):
    fills = v.ticks.filter("sgn < 0").select("symbol", "ts", "price", F.col("event_id").alias("fill_id"))
    return rnd(J.match_fills(v.signals, fills, 5 * HOUR).select("signal_id", "fill_id", "fill_ts", "slippage"), 8)


@query("self_pairwise", "bars", """
j AS (SELECT a.ts, a.symbol AS sa, b.symbol AS sb, a.close AS ca, b.close AS cb, a.volume-b.volume AS dv, ('0x' || substr(sha256('pair|' || a.ts || '|' || a.symbol || '|' || b.symbol),1,15))::BIGINT%2=1 AS flip
 FROM bars a JOIN bars b ON a.ts=b.ts AND a.symbol<b.symbol AND a.close<>b.close)
SELECT ts, CASE WHEN flip THEN sb ELSE sa END AS first, CASE WHEN flip THEN sa ELSE sb END AS second, round(CASE WHEN flip THEN -dv ELSE dv END,4)+0.0 AS d_volume, (CASE WHEN flip THEN cb>ca ELSE ca>cb END)::INT AS prefer_first FROM j""")
def _(v):
    return rnd(J.pairwise(v.bars.select("symbol", "ts", "close", "volume"), "close", ["volume"]), 4)


@query("union_pieces", "bars bars6", "SELECT symbol, ts, close, '1h' AS tf, NULL::DOUBLE AS high FROM bars UNION ALL SELECT symbol, ts, close, '6h', high FROM bars6")
def _(v):
    return J.union_pieces([v.bars.select("symbol", "ts", "close", F.lit("1h").alias("tf")), v.bars6.select("symbol", "ts", "close", F.lit("6h").alias("tf"), "high")], ["tf", "symbol", "ts"])


@query("pivot_unpivot", "bars", """
w AS (SELECT ts, max(close) FILTER (symbol='click') AS click, max(close) FILTER (symbol='error') AS error, max(close) FILTER (symbol='purchase') AS purchase, max(close) FILTER (symbol='signup') AS signup, max(close) FILTER (symbol='view') AS view FROM bars GROUP BY 1),
l AS (UNPIVOT w ON click, error, purchase, signup, view INTO NAME feature VALUE value)
SELECT ts, feature, value FROM l""")
def _(v):
    names = ["click", "error", "purchase", "signup", "view"]
    return J.unpivot_features(J.pivot_symbols(v.bars, "close", names), ["ts"], names).filter("value is not null")


@query("contract_cross_grid", "bars", """
SELECT symbol, h.h AS horizon, f.f AS fav, a.a AS adv, count(*) AS n, round(sum(close),4)+0.0 AS total FROM bars, (VALUES (3),(6)) h(h), (VALUES (0.1::DOUBLE),(0.3)) f(f), (VALUES (0.1::DOUBLE),(0.2)) a(a) GROUP BY 1,2,3,4""")
def _(v):
    from itertools import product
    grid = v.spark.createDataFrame([(h, f, a) for h, f, a in product((3, 6), (0.1, 0.3), (0.1, 0.2))], "horizon int, fav double, adv double")
    return rnd(paths.contract_grid(v.bars, grid).groupBy("symbol", "horizon", "fav", "adv").agg(F.count("*").alias("n"), F.sum("close").alias("total")), 4)
