"""Section 2.10."""

from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, month_key
from ..operators import controls as C, scan, windows as W
from .base import REF1, query, rnd

HX = lambda s: f"('0x' || substr(sha256({s}),1,15))::BIGINT"


@query("deterministic_random_pick", "scored", f"""
x AS (SELECT ts, id, row_number() OVER (PARTITION BY ts ORDER BY id)-1 AS r, count(*) OVER (PARTITION BY ts) AS n FROM scored)
SELECT ts, id FROM x WHERE r={HX("'pick|' || ts")}%n""")
def _(v):
    return C.hash_pick(v.scored, ["ts"], "id", "pick").select("ts", "id")


@query("hash_ordered_sample", "scored", f"""
x AS (SELECT *, strftime(make_timestamp(ts),'%Y-%m') AS month FROM scored), s AS (SELECT * FROM x WHERE score>0.95), w AS (SELECT symbol, side, month, count(*) AS want FROM s GROUP BY 1,2,3),
p AS (SELECT x.*, row_number() OVER (PARTITION BY symbol, side, month ORDER BY {HX("'hs|' || id")}, id) AS r, count(*) OVER (PARTITION BY symbol, side, month) AS have FROM x WHERE id NOT IN (SELECT id FROM s))
SELECT id, have<want AS shortage FROM p JOIN w USING (symbol, side, month) WHERE r<=want""")
def _(v):
    x = v.scored.withColumn("month", month_key("ts"))
    return C.stratified_sample(x, x.filter("score > 0.95"), ["symbol", "side", "month"], "id", "hs").select("id", "shortage")


@query("regime_matched_random", "bars signals", f"""
b AS (SELECT symbol, ts, trades>2 AS regime FROM bars), e AS (SELECT s.signal_id, s.symbol, s.ts, b.regime FROM signals s JOIN b ON b.symbol=s.symbol AND b.ts=(s.ts//3600000000)*3600000000),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, regime ORDER BY ts)-1 AS pos, count(*) OVER (PARTITION BY symbol, regime) AS n FROM b),
j AS (SELECT e.signal_id, o.o, p.ts AS control_ts FROM e JOIN (SELECT DISTINCT symbol, regime, n FROM p) n USING (symbol, regime), range((SELECT max(n) FROM p)) o(o), p WHERE o.o<n.n AND p.symbol=e.symbol AND p.regime=e.regime AND p.pos=({HX("'rm|' || e.signal_id")}%n.n+o.o)%n.n AND abs(p.ts-e.ts)>3600000000)
SELECT e.signal_id, arg_min(control_ts,o) AS control_ts, min(o) AS probe FROM e LEFT JOIN j USING (signal_id) GROUP BY 1""")
def _(v):
    b = v.bars.select("symbol", "ts", (F.col("trades") > 2).alias("regime"))
    s = v.signals.select("signal_id", "symbol", F.col("ts").alias("t"), (F.col("ts") - F.pmod("ts", F.lit(HOUR))).alias("ts"))
    e = s.join(b, ["symbol", "ts"]).select("signal_id", "symbol", F.col("t").alias("ts"), "regime")
    return C.regime_matched(e, b, ["symbol", "regime"], "signal_id", "rm", HOUR)


@query("baseline_controls", "bars signals", f"""
p AS (SELECT symbol, ts, CASE WHEN trades>2 THEN 'BUSY' ELSE 'QUIET' END AS regime, close/open-1 AS m FROM bars),
n AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY symbol)-1 AS r, count(*) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts, regime ORDER BY symbol)-1 AS rr, count(*) OVER (PARTITION BY ts, regime) AS rn, row_number() OVER (PARTITION BY ts ORDER BY m DESC, symbol) AS tp, row_number() OVER (PARTITION BY ts ORDER BY m, symbol) AS lw FROM p),
e AS (SELECT s.signal_id AS id, p.ts, s.symbol AS es, s.side, p.regime AS er, {HX("'bc|' || s.signal_id")} AS h FROM signals s JOIN p ON p.symbol=s.symbol AND p.ts=(s.ts//3600000000)*3600000000),
j AS (SELECT e.*, n.symbol, n.regime, n.m, r, n, rr, rn, tp, lw FROM e JOIN n USING (ts))
SELECT id, ts, 'RANDOM_ELIGIBLE' AS baseline, symbol AS control_symbol, side AS control_side FROM j WHERE r=h%n UNION ALL SELECT id, ts, 'REGIME_RANDOM', symbol, side FROM j WHERE regime=er AND rr=h%rn UNION ALL SELECT id, ts, 'MOMENTUM', symbol, CASE WHEN m>=0 THEN 'LONG' ELSE 'SHORT' END FROM j WHERE tp=1
UNION ALL SELECT id, ts, 'REVERSAL', symbol, CASE WHEN m>=0 THEN 'SHORT' ELSE 'LONG' END FROM j WHERE lw=1 UNION ALL SELECT id, ts, 'REFERENCE', symbol, side FROM j WHERE symbol='purchase' UNION ALL SELECT id, ts, 'ALWAYS_LONG', symbol, 'LONG' FROM j WHERE symbol=es UNION ALL SELECT id, ts, 'ALWAYS_SHORT', symbol, 'SHORT' FROM j WHERE symbol=es""")
def _(v):
    p = v.bars.select("symbol", "ts", F.when(F.col("trades") > 2, "BUSY").otherwise("QUIET").alias("regime"), (F.col("close") / F.col("open") - 1).alias("momentum"))
    s = v.signals.select(F.col("signal_id").alias("id"), "symbol", (F.col("ts") - F.pmod("ts", F.lit(HOUR))).alias("ts"), "side")
    return C.baseline_controls(s.join(p.select("symbol", "ts", "regime"), ["symbol", "ts"]), p, REF1, "bc")


@query("tiered_hard_negatives", "scored", """
p AS (SELECT id, symbol, side, regime, size FROM scored WHERE score>0.985), n AS (SELECT id, symbol, side, regime, size FROM scored WHERE score<=0.985),
c AS (SELECT p.id AS pos_id, n.id AS control_id, abs(p.size-n.size) AS gap, CASE WHEN p.symbol=n.symbol AND p.regime=n.regime THEN 0 WHEN p.symbol=n.symbol THEN 1 ELSE 2 END AS r FROM p JOIN n ON p.side=n.side),
k AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY r, gap, control_id) AS rank FROM c)
SELECT pos_id, control_id, round(gap,4)+0.0 AS gap, ['EXACT','IGNORE_REGIME','SIDE_ONLY'][r+1] AS tier, rank::INT AS rank FROM k WHERE rank<=20""")
def _(v):
    d = C.tiered_match(v.scored.filter("score > 0.985"), v.scored.filter("score <= 0.985"), [("EXACT", ["side", "symbol", "regime"]), ("IGNORE_REGIME", ["side", "symbol"]), ("SIDE_ONLY", ["side"])], "size")
    return rnd(d.select("pos_id", "control_id", "gap", "tier", "rank"), 4)


def edge_nodes(v):
    left = v.signals.select(F.col("signal_id").alias("left_id"), "symbol", F.floor(F.col("ts") / HOUR).alias("cycle"), F.floor(F.col("ts") / (6 * HOUR)).alias("slot"))
    right = v.bars.select(F.concat_ws("@", "symbol", F.floor(F.col("ts") / HOUR).cast("string")).alias("right_id"), "symbol", F.floor(F.col("ts") / HOUR).alias("cycle"), F.floor(F.col("ts") / (6 * HOUR)).alias("slot"))
    return left, right


@query("self_exclusion_edges", "bars signals", """
j AS (SELECT s.symbol=b.symbol AND s.ts//3600000000=b.ts//3600000000 AS self FROM signals s JOIN bars b ON s.ts//21600000000=b.ts//21600000000)
SELECT count(*) AS total, sum(self::INT)::BIGINT AS excluded, sum((NOT self)::INT)::BIGINT AS retained FROM j""")
def _(v):
    return C.self_exclusion_edges(*edge_nodes(v), ["slot"])[1]


@query("bipartite_assignment", "bars signals", """
l AS (SELECT symbol, ts//3600000000 AS c, ts//21600000000 AS slot FROM signals), r AS (SELECT ts//21600000000 AS slot, count(*) AS nr FROM bars GROUP BY 1),
g AS (SELECT slot, symbol, c, count(*) AS n FROM l GROUP BY 1,2,3), s AS (SELECT slot, sum(n) AS nl, count(*) AS k, max(n) AS mx FROM g GROUP BY 1)
SELECT slot::BIGINT AS slot, p.p AS replicate, nl::BIGINT AS lefts, (nl-greatest(0, nl-CASE WHEN k>1 THEN nr ELSE nr-1 END, mx-(nr-1)))::BIGINT AS matched, true AS one_to_one, true AS on_edges FROM s JOIN r USING (slot), (VALUES (0),(1)) p(p) WHERE nr>1""")
def _(v):
    # every bar but a signal's own may serve it, so the size of a largest matching is known by Hall's theorem
    e, _ = C.self_exclusion_edges(*edge_nodes(v), ["slot"])
    out = None
    for k in (0, 1):
        m = C.assign_controls(e, ["slot"], strict=False, seed="ba", replicate=k).join(e.select("slot", "left_id", "right_id", F.lit(True).alias("_e")), ["slot", "left_id", "right_id"], "left")
        m = m.groupBy("slot").agg(F.lit(k).alias("replicate"), F.count("*").alias("lefts"), F.count("right_id").alias("matched"), (F.count("right_id") == F.count_distinct("right_id")).alias("one_to_one"),
                                  (F.count("right_id") == F.count("_e")).alias("on_edges"))
        out = m if out is None else out.unionByName(m)
    return out


@query("label_shuffle_controls", "scored", f"""
a AS (SELECT id, net, row_number() OVER (ORDER BY {HX("'ls|' || id")}, id) AS k FROM scored), b AS (SELECT label AS shuffled, row_number() OVER (ORDER BY id) AS k FROM scored)
SELECT id, shuffled, round({HX("'nf|' || id")}/1152921504606846976.0::DOUBLE,9)+0.0 AS noise FROM a JOIN b USING (k)""")
def _(v):
    return rnd(C.shuffled_labels(v.scored, "label", "ls").select("id", "shuffled", C.noise_feature("nf").alias("noise")), 9)
