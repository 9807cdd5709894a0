"""Section 2.2."""

from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, SECOND, floor_to
from ..operators import quality as Q
from .base import query, rnd

H = 3600000000


@query("bar_quality", "ticks", """
r AS (SELECT symbol, (ts//3600000000)*3600000000 AS ts, price AS close, event_id FROM ticks),
d AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) AS rn FROM r),
u AS (SELECT symbol, count(*) AS rows, sum((rn>1)::INT)::BIGINT AS duplicates FROM d GROUP BY 1),
o AS (SELECT *, ts-lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS dt FROM d WHERE rn=1)
SELECT u.symbol, any_value(u.rows) AS rows, any_value(duplicates) AS duplicates, min(ts) AS first_ts, max(ts) AS last_ts,
 sum((dt>3600000000)::INT)::BIGINT AS gaps, sum(greatest(0, round(dt/3600000000.0)-1))::BIGINT AS missing, sum((close<5)::INT)::BIGINT AS invalid FROM o JOIN u ON u.symbol=o.symbol GROUP BY 1""")
def _(v):
    p = F.col("price")
    b = v.ticks.select("symbol", floor_to("ts", HOUR).alias("ts"), p.alias("open"), F.when(p < 5, p - 1).otherwise(p).alias("high"), p.alias("low"),
                       p.alias("close"), F.lit(1.0).alias("volume"), F.col("event_id").alias("version"))
    return Q.bar_quality(b, HOUR, "version")


_SEG = """
g AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts) AS segment FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) = 3600000000 THEN 0 ELSE 1 END AS brk FROM bars)),
n AS (SELECT *, count(*) OVER (PARTITION BY symbol, segment) AS segment_size, row_number() OVER (PARTITION BY symbol, segment ORDER BY ts)-1 AS position FROM g)
"""


@query("segment_contiguity", "bars", _SEG + "SELECT symbol, ts, segment::BIGINT AS segment, segment_size, position FROM n")
def _(v):
    return Q.segment_positions(v.bars, HOUR).select("symbol", "ts", "segment", "segment_size", "position")


@query("causal_ready_flag", "bars", _SEG + "SELECT symbol, ts, segment_size>=24 AND position>=12 AS causal_ready FROM n")
def _(v):
    return Q.causal_ready(v.bars, HOUR, 24, 12).select("symbol", "ts", "causal_ready")


@query("history_future_contiguous", "bars", """
SELECT symbol, ts, coalesce(ts-lag(ts,6) OVER w = 6*3600000000, false) AS history_ok, coalesce(lead(ts,4) OVER w - ts = 4*3600000000, false) AS future_ok
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(v):
    return Q.contiguous(v.bars, HOUR, 6, 4, block=64).select("symbol", "ts", "history_ok", "future_ok")


@query("merge_bars_idempotent", "bars", """
SELECT symbol, ts, close, CASE WHEN (ts//3600000000)%3=0 THEN 'equal' WHEN (ts//3600000000)%3=1 THEN 'old' ELSE 'new' END AS status FROM bars""")
def _(v):
    h = F.pmod(F.col("ts") / HOUR, F.lit(3))
    return Q.merge_bars(v.bars.filter(h <= 1), v.bars.filter((h == 0) | (h == 2))).select("symbol", "ts", "close", "status")


@query("source_precedence_gap_fill", "bars", """
b AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
e AS (SELECT symbol, unnest(range(lo, hi+1, 3600000000)) AS ts FROM b),
p AS (SELECT * FROM bars WHERE (ts//3600000000)%5<>0), s AS (SELECT symbol, ts, CASE WHEN (ts//3600000000)%2=0 THEN close ELSE close+1 END AS close FROM bars WHERE (ts//3600000000)%3<>0)
SELECT e.symbol, e.ts, CASE WHEN p.ts IS NOT NULL THEN 'primary' WHEN s.ts IS NOT NULL THEN 'recovered' ELSE 'missing' END AS source,
 coalesce(p.close<>s.close, false) AS mismatch, coalesce(p.close, s.close) AS close
FROM e LEFT JOIN p ON e.symbol=p.symbol AND e.ts=p.ts LEFT JOIN s ON e.symbol=s.symbol AND e.ts=s.ts""")
def _(v):
    h = (F.col("ts") / HOUR).cast("long")
    b = v.bars.select("symbol", "ts", "close")
    grid = Q.expected_grid(b.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), HOUR)
    sec = b.filter(h % 3 != 0).withColumn("close", F.when(h % 2 == 0, F.col("close")).otherwise(F.col("close") + 1))
    return Q.gap_fill(b.filter(h % 5 != 0), sec, grid)


@query("coordinated_universe", "bars", """
SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))""")
def _(v):
    return Q.coordinated(v.bars).select("symbol", "ts", "close")


@query("availability_audit", "bars", """
SELECT count(*) AS rows, sum((trades%7=0)::INT)::BIGINT AS late, sum((trades%5=0)::INT)::BIGINT AS unavailable, 0::BIGINT AS nonfinite FROM bars""")
def _(v):
    t = F.col("trades")
    d = v.bars.withColumns({"available_at__close": F.when(t % 5 != 0, F.col("ts")), "available_at__volume": F.when(t % 7 == 0, F.col("ts") + 1).otherwise(F.col("ts"))})
    return Q.availability_audit(d, "ts", ["close", "volume"])


@query("tick_audits", "ticks", """
x AS (SELECT symbol, price, sgn, ts + CASE WHEN event_id%13=0 THEN -7200000000 ELSE 0 END AS local_ts, ts, event_id FROM ticks),
y AS (SELECT *, local_ts-lag(local_ts) OVER w AS dl, ts-lag(ts) OVER w AS de, price=lag(price) OVER w AS sm FROM x WINDOW w AS (PARTITION BY symbol ORDER BY event_id))
SELECT symbol, count(*) AS rows, sum((dl<0)::INT)::BIGINT AS local_out_of_order, sum((de<0)::INT)::BIGINT AS exchange_out_of_order, sum(sm::INT)::BIGINT AS adjacent_repeats,
 sum((dl>3600000000)::INT)::BIGINT AS gaps, max(dl) AS max_gap, sum((price<1)::INT)::BIGINT AS crossed FROM y GROUP BY 1""")
def _(v):
    t = v.ticks.withColumn("local_ts", F.col("ts") + F.when(F.col("event_id") % 13 == 0, -2 * HOUR).otherwise(0))
    return Q.tick_audit(t, "local_ts", "ts", "event_id", HOUR, F.col("price") < 1)


@query("timestamp_identity_diagnostics", "ticks", """
x AS (SELECT symbol, event_id, event_id//2 AS id, ts-lag(ts) OVER (PARTITION BY symbol ORDER BY event_id) AS d FROM ticks)
SELECT symbol, sum((coalesce(d,0)<0)::INT)::BIGINT AS out_of_order, count(id)-count(DISTINCT id) AS duplicate_ids, 0::BIGINT AS invalid_ts,
 sum((coalesce(d,0)<0)::INT)+count(id)-count(DISTINCT id)=0 AS ok FROM x GROUP BY 1""")
def _(v):
    return Q.ts_diagnostics(v.ticks.withColumn("id", F.floor(F.col("event_id") / 2)), "ts", "id", "event_id")


@query("coverage_report", "scored", """
SELECT regime, side, count(*) AS rows, count(DISTINCT symbol) AS symbols, round((max(ts)-min(ts))/86400000000.0,6)+0.0 AS span_days FROM scored GROUP BY 1,2""")
def _(v):
    return rnd(Q.coverage(v.scored, ["regime", "side"]))


@query("sample_gate", "scored", """
SELECT regime, count(DISTINCT id) AS episodes, count(DISTINCT symbol) AS symbols, count(DISTINCT ts//86400000000) AS days, count(DISTINCT side) AS directions,
 concat_ws('|', CASE WHEN count(DISTINCT ts//86400000000)<2350 THEN 'days' END, CASE WHEN count(DISTINCT id)<5000 THEN 'episodes' END) AS blockers,
 count(DISTINCT ts//86400000000)>=2350 AND count(DISTINCT id)>=5000 AS passed FROM scored GROUP BY 1""")
def _(v):
    return Q.sample_gate(v.scored, "regime", {"days": 2350, "episodes": 5000})


@query("identity_collision_check", "ticks", """
SELECT event_id//3 AS id, count(DISTINCT symbol)>1 AS collision, count(DISTINCT price)>1 AS conflict, count(event_id%2)>count(DISTINCT event_id%2) AS duplicate FROM ticks GROUP BY 1""")
def _(v):
    t = v.ticks.select(F.floor(F.col("event_id") / 3).alias("id"), "symbol", "price", (F.col("event_id") % 2).alias("ordinal"))
    return Q.identity_check(t, "id", "symbol", "price", "ordinal")


@query("coverage_gate", "bars", """
o AS (SELECT symbol, count(*) AS bars, sum(trades)::BIGINT AS trades FROM bars GROUP BY 1)
SELECT *, concat_ws('|', CASE WHEN bars<678 THEN 'bars' END, CASE WHEN trades<2000 THEN 'trades' END) AS blockers, bars>=678 AND trades>=2000 AS passed FROM o""")
def _(v):
    o = v.bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("trades").alias("trades"))
    return Q.gate_blockers(o, {"bars": 678, "trades": 2000})


@query("feature_quality_profile", "scored", """
l AS (UNPIVOT (SELECT score, net, mae, 0.0::DOUBLE AS flat FROM scored) ON score, net, mae, flat INTO NAME feature VALUE value)
SELECT feature, count(DISTINCT value) AS "distinct", round(stddev_pop(value),6)+0.0 AS std, count(DISTINCT value)<=1 AS single_value, stddev_pop(value)<=1e-12 AS near_constant FROM l GROUP BY 1""")
def _(v):
    return rnd(Q.feature_profile(v.scored.select("score", "net", "mae", F.lit(0.0).alias("flat")), ["score", "net", "mae", "flat"]))


@query("robust_drift", "scored", """
l AS (UNPIVOT (SELECT CASE WHEN ts < 893000000000000 THEN 'early' ELSE 'late' END AS period, net, mae, size FROM scored) ON net, mae, size INTO NAME feature VALUE value),
q AS (SELECT feature, period, quantile_cont(value,0.5) AS m, quantile_cont(value,0.75)-quantile_cont(value,0.25) AS iqr FROM l GROUP BY 1,2)
SELECT e.feature, round(abs(l.m-e.m)/greatest(e.iqr,1e-12),6)+0.0 AS shift FROM q e JOIN q l ON e.feature=l.feature AND e.period='early' AND l.period='late'""")
def _(v):
    d = v.scored.withColumn("period", F.when(F.col("ts") < 893000000000000, "early").otherwise("late"))
    return rnd(Q.robust_shift(d, "period", ["net", "mae", "size"]))


@query("axis_health", "scored", """
x AS (SELECT symbol, CASE WHEN regime='P' THEN 'UNKNOWN' ELSE regime END AS r, ts, id FROM scored),
y AS (SELECT *, r<>lag(r) OVER (PARTITION BY symbol ORDER BY ts, id) AS ch FROM x),
g AS (SELECT symbol, r, count(*) AS n, sum(coalesce(ch,false)::INT) AS t FROM y GROUP BY 1,2)
SELECT symbol, sum(n)::BIGINT AS rows, sum(n) FILTER (r<>'UNKNOWN')::BIGINT AS known, sum(t)::BIGINT AS transitions, count(*) FILTER (r<>'UNKNOWN') AS labels,
 round(max(n) FILTER (r<>'UNKNOWN')/(sum(n) FILTER (r<>'UNKNOWN'))::DOUBLE,6)+0.0 AS dominant_share,
 sum(n) FILTER (r<>'UNKNOWN')>=20 AND max(n) FILTER (r<>'UNKNOWN')/(sum(n) FILTER (r<>'UNKNOWN'))::DOUBLE>=0.98 AS collapsed FROM g GROUP BY 1""")
def _(v):
    d = v.scored.withColumn("r", F.when(F.col("regime") == "P", "UNKNOWN").otherwise(F.col("regime")))
    return rnd(Q.axis_health(d, "r"))


@query("hash_chain_audit", "ticks", """
SELECT symbol, count(*) AS rows, sum((event_id%101=0)::INT)::BIGINT AS broken_links, sum((event_id%103=0)::INT)::BIGINT AS broken_digests FROM ticks GROUP BY 1""")
def _(v):
    from ..operators import scan
    t = v.ticks.select("symbol", "event_id", F.col("price").cast("string").alias("payload"))
    own = t.withColumn("digest", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "payload"), 256))
    d = scan.framed(own, ["symbol"], ["event_id"], lambda w: {"prev": F.coalesce(F.lag("digest", 1).over(w), F.lit(""))}, back=1, slice_width=4096)
    tampered = lambda k, c: F.when(F.col("event_id") % k == 0, "tampered").otherwise(F.col(c))
    d = d.withColumns({"prev": tampered(101, "prev"), "payload": tampered(103, "payload"), "seq": F.col("event_id").cast("string")})
    a = Q.audit_chain(d, ["symbol"], "event_id", "prev", "digest", ["seq", "payload"])
    bad = lambda c: F.sum((~F.col(c)).cast("long"))
    return a.groupBy("symbol").agg(F.count("*").alias("rows"), bad("link_ok").alias("broken_links"), bad("digest_ok").alias("broken_digests"))
