"""Section 2.6.  Oracle rows come from ``pl``: one row per (symbol, ts, side, bar k of 6)."""

from pyspark.sql import functions as F

from ..functions.scalars import HOUR
from ..operators import panel, paths as P, scan
from .base import query, rnd

K = ["symbol", "ts"]
KS = ["symbol", "ts", "side"]
FV, AD, CO = 0.6, 0.4, 0.0015

# per path: first hits, extremes and the terminal return
X = f"""
x AS (SELECT symbol, ts, side, any_value(entry) AS entry, any_value(close0) AS close0, max(fav) AS mfe, max(adv) AS mae, arg_min(k, CASE WHEN TRUE THEN -fav*1e6+k*1e-9 END) AS tm, arg_min(k, -adv*1e6+k*1e-9) AS ta,
 min(k) FILTER (fav>={FV}) AS hf, min(k) FILTER (adv>={AD}) AS ha, arg_max(r, k) AS term, max(adv) FILTER (k<=3) AS i3, min(k) FILTER (r>{CO}) AS fp, min(k) FILTER (r>0) AS fp0 FROM pl GROUP BY 1,2,3),
o AS (SELECT *, CASE WHEN ha IS NOT NULL AND (hf IS NULL OR ha<=hf) THEN 'ADVERSE_FIRST_OR_SAME' WHEN hf IS NOT NULL THEN 'FAVORABLE_FIRST' ELSE 'NEITHER_REACHED' END AS outcome,
 CASE WHEN hf IS NULL AND ha IS NULL THEN 'NEITHER_REACHED' WHEN hf=ha THEN 'SAME_BAR_AMBIGUOUS' WHEN ha IS NULL OR hf<ha THEN 'FAVORABLE_FIRST' ELSE 'ADVERSE_FIRST' END AS out4, least(hf,ha) AS ev FROM x)
"""


@query("mfe_mae", "pl", X + "SELECT symbol, ts, side, round(mfe,8)+0.0 AS mfe, round(mae,8)+0.0 AS mae, tm AS time_to_mfe, ta AS time_to_mae, tm<ta AS mfe_before_mae FROM x")
def _(v):
    return rnd(P.excursions(v.paths).select(*KS, "mfe", "mae", "time_to_mfe", "time_to_mae", "mfe_before_mae"), 8)


_U = f"CASE outcome WHEN 'FAVORABLE_FIRST' THEN {FV}-{CO} WHEN 'ADVERSE_FIRST_OR_SAME' THEN -{AD}-{CO} ELSE term-{CO} END"
_U4 = f"CASE out4 WHEN 'FAVORABLE_FIRST' THEN {FV}-{CO} WHEN 'NEITHER_REACHED' THEN term-{CO} ELSE -{AD}-{CO} END"


@query("triple_barrier", "pl", X + f"SELECT symbol, ts, side, outcome, ev AS event_bar, round(term,8)+0.0 AS terminal, round({_U},8)+0.0 AS utility FROM o")
def _(v):
    return rnd(P.triple_barrier(v.paths, FV, AD, CO).select(*KS, "outcome", "event_bar", "terminal", "utility"), 8)


@query("path_labels_vectorised", "pl", X + f"SELECT symbol, ts, side, round(mfe,8)+0.0 AS mfe, round(mae,8)+0.0 AS mae, tm AS time_to_mfe, ta AS time_to_mae, tm<ta AS mfe_before_mae, outcome, ev AS event_bar, round(term,8)+0.0 AS terminal, round({_U},8)+0.0 AS utility FROM o")
def _(v):
    return rnd(P.label_paths(v.paths, KS, 6, FV, AD, CO), 8)


@query("triple_barrier_grid", "pl", """
g AS (SELECT * FROM (VALUES ('A',3,0.3::DOUBLE,0.2::DOUBLE),('B',6,0.3,0.2),('C',6,1.0,0.5)) t(contract,horizon,f,a)),
x AS (SELECT symbol, ts, side, contract, any_value(f) AS f, any_value(a) AS a, min(k) FILTER (fav>=f) AS hf, min(k) FILTER (adv>=a) AS ha, arg_max(r,k) AS term FROM pl, g WHERE k<=horizon GROUP BY 1,2,3,4),
o AS (SELECT *, CASE WHEN ha IS NOT NULL AND (hf IS NULL OR ha<=hf) THEN 'ADVERSE_FIRST_OR_SAME' WHEN hf IS NOT NULL THEN 'FAVORABLE_FIRST' ELSE 'NEITHER_REACHED' END AS outcome FROM x)
SELECT contract, side, outcome, count(*) AS n, round(avg(CASE outcome WHEN 'FAVORABLE_FIRST' THEN f-0.001 WHEN 'ADVERSE_FIRST_OR_SAME' THEN -a-0.001 ELSE term-0.001 END),6)+0.0 AS utility FROM o GROUP BY 1,2,3""")
def _(v):
    g = v.spark.createDataFrame([("A", 3, 0.3, 0.2), ("B", 6, 0.3, 0.2), ("C", 6, 1.0, 0.5)], "contract string, horizon int, fav double, adv double")
    d = P.triple_barrier_grid(v.paths, g, 0.001)
    return rnd(d.groupBy("contract", "side", "outcome").agg(F.count("*").alias("n"), F.avg("utility").alias("utility")))


@query("barrier_ambiguous_variant", "pl", X + f"SELECT symbol, ts, side, out4 AS outcome, ev AS event_bar, round({_U4},8)+0.0 AS utility FROM o")
def _(v):
    return rnd(P.barrier_ambiguous(v.paths, FV, AD, CO).select(*KS, "outcome", "event_bar", "utility"), 8)


@query("first_passage_matrix", "pl", """
f AS (SELECT symbol, ts, side, l AS fl, min(k) FILTER (fav>=l) AS fb FROM pl, (VALUES (0.2::DOUBLE),(0.5),(1.0)) t(l) GROUP BY 1,2,3,4), a AS (SELECT symbol, ts, side, l AS al, min(k) FILTER (adv>=l) AS ab FROM pl, (VALUES (0.2::DOUBLE),(0.5)) t(l) GROUP BY 1,2,3,4)
SELECT fl AS fav_level, al AS adv_level, side, CASE WHEN fb IS NULL AND ab IS NULL THEN 'NONE' WHEN ab IS NOT NULL AND (fb IS NULL OR ab<=fb) THEN 'ADVERSE' ELSE 'FAVORABLE' END AS first, count(*) AS n, sum(fb)::BIGINT AS fav_bars, sum(ab)::BIGINT AS adv_bars
FROM f JOIN a USING (symbol, ts, side) GROUP BY 1,2,3,4""")
def _(v):
    d = P.first_passage(v.paths, [0.2, 0.5, 1.0], [0.2, 0.5])
    return d.groupBy("fav_level", "adv_level", "side", "first").agg(F.count("*").alias("n"), F.sum("fav_bar").alias("fav_bars"), F.sum("adv_bar").alias("adv_bars"))


@query("mid_first_barrier_latency", "ticks signals", """
a AS (SELECT signal_id, symbol, ts+60000000 AS ts FROM signals), r AS (SELECT a.signal_id, a.symbol, a.ts, t.price AS mid FROM a ASOF LEFT JOIN ticks t ON a.symbol=t.symbol AND a.ts>=t.ts),
g AS (SELECT r.signal_id, min(t.ts) FILTER (t.price>=r.mid*1.5) AS u, min(t.ts) FILTER (t.price<=r.mid*0.5) AS d, arg_max(t.price,t.ts) AS tp, max(t.price) AS mx, min(t.price) AS mn FROM r JOIN ticks t ON t.symbol=r.symbol AND t.ts>r.ts AND t.ts<=r.ts+10800000000 GROUP BY 1)
SELECT r.signal_id, r.symbol, CASE WHEN mid IS NULL THEN 'MISSING' WHEN u IS NULL AND d IS NULL THEN 'NEITHER' WHEN d IS NULL OR u<d THEN 'UP_FIRST' ELSE 'DOWN_FIRST' END AS outcome,
 round((tp/mid-1)*10000,4)+0.0 AS terminal_bps, round((mx/mid-1)*10000,4)+0.0 AS mfe_bps, round(-((mn/mid-1)*10000),4)+0.0 AS mae_bps FROM r LEFT JOIN g USING (signal_id)""")
def _(v):
    q = v.ticks.select("symbol", "ts", F.col("price").alias("mid"))
    return rnd(P.mid_barrier(q, v.signals, 60_000_000, 5000, 3 * HOUR), 4)


LABEL = dict(clean_mfe=0.5, clean_mae=0.4, clean_ratio=1.25, clean_time=0.6, initial3=0.3, bad_mae=0.5, bad_mfe=0.2, bad_initial3=0.6, low_mae=0.2, tail_mae=0.8)


@query("path_label_clean_bad_tail", "barsi", """
q AS (SELECT a.symbol, a.ts, a.i, count(b.i) AS n, max(b.ts) AS lt FROM barsi a LEFT JOIN barsi b ON a.symbol=b.symbol AND b.i BETWEEN a.i+1 AND a.i+6 GROUP BY 1,2,3),
e AS (SELECT q.*, CASE WHEN n<6 THEN 'INCOMPLETE_HORIZON' WHEN lt<>ts+6*3600000000 THEN 'FUTURE_GAP' END AS rs FROM q),
pp AS (SELECT e.symbol, e.ts, s.side, b.i-e.i AS k, greatest(0,CASE s.side WHEN 'LONG' THEN b.high/o.open-1 ELSE 1-b.low/o.open END) AS fav, greatest(0,CASE s.side WHEN 'LONG' THEN 1-b.low/o.open ELSE b.high/o.open-1 END) AS adv
 FROM e JOIN barsi o ON o.symbol=e.symbol AND o.i=e.i+1 JOIN barsi b ON b.symbol=e.symbol AND b.i BETWEEN e.i+1 AND e.i+6, (VALUES ('LONG'),('SHORT')) s(side) WHERE rs IS NULL),
x AS (SELECT symbol, ts, side, max(fav) AS mfe, max(adv) AS mae, max(adv) FILTER (k<=3) AS i3, min(k) FILTER (fav>=0.5) AS hf, min(k) FILTER (adv>=0.5) AS ha, arg_min(k, -fav*1e6+k*1e-9) AS tm0, arg_min(k, -adv*1e6+k*1e-9) AS ta0 FROM pp GROUP BY 1,2,3),
y AS (SELECT *, CASE WHEN mfe>0 THEN tm0 END AS tm, CASE WHEN mae>0 THEN ta0 END AS ta, CASE WHEN mae>0 THEN mfe/mae WHEN mfe>0 THEN 'inf'::DOUBLE ELSE 0 END AS ratio, mfe-mae-0.001 AS nq, coalesce(hf=ha,false) AS amb FROM x),
z AS (SELECT *, coalesce(NOT amb AND tm IS NOT NULL AND (ta IS NULL OR tm<ta) AND mfe>=0.5 AND mae<=0.4 AND ratio>=1.25 AND tm<=3.6 AND nq>0 AND i3<=0.3, false) AS clean_entry,
 (ta IS NOT NULL AND (tm IS NULL OR ta<=tm) AND mae>=0.5) OR (mfe<0.2 AND mae>=0.2) OR i3>=0.6 OR nq<0 OR (ratio<1 AND mae>=0.2) OR amb AS bad_entry, mae>=0.8 AS tail_event,
 ha IS NOT NULL AND (hf IS NULL OR ha<=hf) AS stopped_before_hit FROM y)
SELECT e.symbol, e.ts, s.side, e.rs AS quarantine_reason, z.clean_entry, z.bad_entry, z.tail_event, z.stopped_before_hit, z.hf IS NOT NULL AND NOT z.stopped_before_hit AS hit_before_stop
FROM e CROSS JOIN (VALUES ('LONG'),('SHORT')) s(side) LEFT JOIN z ON z.symbol=e.symbol AND z.ts=e.ts AND z.side=s.side""".replace("z.hf IS NOT NULL AND NOT z.stopped_before_hit AS", "CASE WHEN e.rs IS NULL THEN z.hf IS NOT NULL AND NOT z.stopped_before_hit END AS"))
def _(v):
    d = panel.orient_sides(P.forward_path(v.bars, HOUR, 6, strict=False))
    d = P.path_labels(d, 6, 0.001, **LABEL)
    return d.select(*KS, "quarantine_reason", "clean_entry", "bad_entry", "tail_event", "stopped_before_hit", "hit_before_stop")


@query("clean_entry_diagnostics", "pl", X + f"""
SELECT o.symbol, o.ts, o.side, coalesce(ev,6)::BIGINT AS observed_bars, round(greatest(0,max(adv) FILTER (k<=coalesce(ev,6))),8)+0.0 AS pre_event_mae, any_value(fp) AS first_positive_bar, round(greatest(0,max(fav)),8)+0.0 AS max_favorable,
 coalesce(any_value(out4)='FAVORABLE_FIRST' AND ev<=4 AND greatest(0,max(adv) FILTER (k<=coalesce(ev,6)))<={AD}*0.5, false) AS clean_entry FROM o JOIN pl USING (symbol, ts, side) GROUP BY 1,2,3,ev""")
def _(v):
    d = P.clean_diagnostics(P.barrier_ambiguous(v.paths, FV, AD, CO), AD, 0.5, 4, CO)
    return rnd(d.select(*KS, "observed_bars", "pre_event_mae", "first_positive_bar", "max_favorable", "clean_entry"), 8)


@query("fixed_horizon_outcome", "pl bars funding", X + """,
y AS (SELECT x.*, b.open AS ex FROM x JOIN bars b ON b.symbol=x.symbol AND b.ts=x.ts+7*3600000000), f AS (SELECT y.symbol, y.ts, y.side, sum(f.rate) AS fund FROM y LEFT JOIN funding f ON f.ts>=y.ts+3600000000 AND f.ts<y.ts+7*3600000000 GROUP BY 1,2,3)
SELECT symbol, ts, side, round(s*(ex/entry-1),8)+0.0 AS gross, round(coalesce(fund,0),9)+0.0 AS funding, round(s*(ex/entry-1)-0.001-s*coalesce(fund,0),8)+0.0 AS net_base, round(s*(ex/entry-1)-0.003-s*coalesce(fund,0),8)+0.0 AS net_severe, fp0 AS first_positive_bar
FROM (SELECT *, CASE side WHEN 'LONG' THEN 1 ELSE -1 END AS s FROM y JOIN f USING (symbol, ts, side))""")
def _(v):
    d = P.fixed_horizon(v.paths, v.bars, v.funding, HOUR, 6, {"base": 0.001, "severe": 0.003})
    d = d.withColumn("funding", F.round("funding", 9) + 0.0)
    keep = d.select(*KS, "gross", "funding", "net_base", "net_severe", "first_positive_bar")
    return keep.withColumns({c: F.round(c, 8) + 0.0 for c in ("gross", "net_base", "net_severe")})


@query("next_open_batch_outcome", "pl", X + """
SELECT symbol, ts, side, round(term,8)+0.0 AS gross, round(greatest(0,mfe),8)+0.0 AS mfe, round(greatest(0,mae),8)+0.0 AS mae, round(term-(2*7.0/10000+1.0/10000*6),10)+0.0 AS net FROM x""")
def _(v):
    d = P.next_open_outcome(v.bars, HOUR, 6, 5.0, 2.0, 1.0)
    return d.select(*KS, *[(F.round(c, 8) + 0.0).alias(c) for c in ("gross", "mfe", "mae")], (F.round("net", 10) + 0.0).alias("net"))


@query("forward_returns", "bars", """
SELECT symbol, ts, round((lead(close,1) OVER w/lead(open,1) OVER w-1)*10000,4)+0.0 AS gross_1, round((lead(close,3) OVER w/lead(open,1) OVER w-1)*10000,4)+0.0 AS gross_3,
 abs((lead(close,3) OVER w/lead(open,1) OVER w-1)*10000)>=3000 AS opportunity_3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(v):
    return rnd(P.forward_returns(v.bars, [1, 3], 3000).select(*K, "gross_1", "gross_3", "opportunity_3"), 4)


@query("hard_negative_class", "pl", X + """
SELECT symbol, ts, side, CASE WHEN term>0 THEN NULL WHEN mae>=0.5 AND mfe<0.3 THEN 'FALLING_KNIFE' WHEN mfe>=0.3 AND tm<ta THEN 'FALSE_BREAKOUT' WHEN mfe>=0.3 AND tm>=4 THEN 'LATE_RECOVERY' WHEN mfe<0.3 AND mae<0.5 THEN 'NO_RESOLUTION' ELSE 'WRONG_DIRECTION' END AS hard_negative FROM x""")
def _(v):
    d = P.excursions(v.paths).withColumn("terminal", F.element_at(P.closes(), -1))
    return P.hard_negative(d, 0.5, 0.3, 4).select(*KS, "hard_negative")


@query("long_short_pairing", "pl", X + "SELECT symbol, ts, side, round(close0,4)+0.0 AS close0, round(term,8)+0.0 AS terminal, round(mfe,8)+0.0 AS mfe FROM x")
def _(v):
    d = P.excursions(v.paths).withColumn("terminal", F.element_at(P.closes(), -1)).select(*KS, "close0", "terminal", "mfe")
    return rnd(P.pair_sides(d.filter("side = 'LONG'"), d.filter("side = 'SHORT'"), ["close0"]), 8)


@query("direction_neutral_magnitude", "pl", X + """
SELECT symbol, ts, round(greatest(0,mfe),8)+0.0 AS up, round(greatest(0,mae),8)+0.0 AS down, round(greatest(0,mfe,mae),8)+0.0 AS magnitude, round(term-0.001,8)+0.0 AS long_net, round(-term-0.001,8)+0.0 AS short_net FROM x WHERE side='LONG'""")
def _(v):
    d = P.forward_path(v.bars, HOUR, 6)
    return rnd(P.opportunity_magnitude(d, 0.001).select(*K, "up", "down", "magnitude", "long_net", "short_net"), 8)


@query("joint_path_state", "pl", X + """,
c AS (SELECT *, coalesce(out4='FAVORABLE_FIRST' AND ev<=3,false) AS cl, max((out4='FAVORABLE_FIRST')::INT) FILTER (side='LONG') OVER w AS lw, max((out4='FAVORABLE_FIRST')::INT) FILTER (side='SHORT') OVER w AS sw FROM o WINDOW w AS (PARTITION BY symbol, ts)),
d AS (SELECT *, CASE WHEN lw=sw THEN 'ABSTAIN' WHEN lw=1 THEN 'LONG' ELSE 'SHORT' END AS direction FROM c)
SELECT symbol, ts, side, direction, CASE WHEN out4 IN ('ADVERSE_FIRST','SAME_BAR_AMBIGUOUS') THEN out4 WHEN out4='FAVORABLE_FIRST' AND direction=side THEN CASE WHEN cl THEN 'COHERENT_CLEAN_FAVORABLE' ELSE 'COHERENT_DIRTY_FAVORABLE' END ELSE 'UNRESOLVED_OR_DIRECTION_MISMATCH' END AS state FROM d""")
def _(v):
    d = P.barrier_ambiguous(v.paths, FV, AD, CO)
    d = d.withColumn("clean_entry", F.coalesce((F.col("outcome") == "FAVORABLE_FIRST") & (F.col("event_bar") <= 3), F.lit(False)))
    return P.joint_state(d).select(*KS, "direction", "state")


def timing_failures():
    return {"extended": F.abs(F.col("entry") / F.col("close0") - 1) >= 1.0, "false_breakout": (F.col("mfe") >= 0.3) & (F.col("terminal") < 0), "adverse_continuation": (F.col("mae") >= 0.5) & (F.col("mfe") < 0.2),
       "slow": F.col("time_to_mfe") >= 5, "late_clean": (F.col("terminal") > 0) & (F.col("time_to_mfe") >= 4), "tail": F.col("mae") >= 0.8}


@query("timing_failure_labels", "pl", X + """
SELECT symbol, ts, side, concat_ws('|', CASE WHEN abs(entry/close0-1)>=1.0 THEN 'extended' END, CASE WHEN mfe>=0.3 AND term<0 THEN 'false_breakout' END, CASE WHEN mae>=0.5 AND mfe<0.2 THEN 'adverse_continuation' END,
 CASE WHEN tm>=5 THEN 'slow' END, CASE WHEN term>0 AND tm>=4 THEN 'late_clean' END, CASE WHEN mae>=0.8 THEN 'tail' END) AS labels FROM x""")
def _(v):
    d = P.excursions(v.paths).withColumn("terminal", F.element_at(P.closes(), -1))
    return d.select(*KS, F.array_join(P.labelled(timing_failures()), "|").alias("labels"))


@query("symmetric_economic_label", "pl", X + f""",
u AS (SELECT symbol, ts, side, outcome, {_U} AS u FROM o), p AS (SELECT l.symbol, l.ts, l.u AS lu, s.u AS su, l.outcome AS lo, s.outcome AS so FROM u l JOIN u s ON l.symbol=s.symbol AND l.ts=s.ts AND l.side='LONG' AND s.side='SHORT')
SELECT symbol, ts, lo AS long_outcome, so AS short_outcome, round(lu-su,8)+0.0 AS advantage, CASE WHEN greatest(lu,su)>=0.05 AND abs(lu-su)>=0.1 THEN CASE WHEN lu>=su THEN 'LONG' ELSE 'SHORT' END ELSE 'SKIP' END AS economic_label FROM p""")
def _(v):
    d = P.symmetric_label(P.forward_path(v.bars, HOUR, 6), FV, AD, CO, 0.05, 0.1)
    return rnd(d.select(*K, "long_outcome", "short_outcome", "advantage", "economic_label"), 8)


@query("expected_utility", "scored", """
p AS (SELECT id, p_clean*0.6 AS pf, (1-p_clean)*0.5 AS pa, p_clean*0.1 AS pm, 1-p_clean*0.6-(1-p_clean)*0.5-p_clean*0.1 AS pn, score AS pc FROM scored)
SELECT id, round(pf*0.02,8)+0.0 AS u_favorable, round(-pa*0.01,8)+0.0 AS u_adverse, round(-pm*0.5*0.01,8)+0.0 AS u_ambiguous, round(-pn*0.5*0.01,8)+0.0 AS u_unresolved, round(pc*0.001,8)+0.0 AS u_clean,
 round(pf*0.02-pa*0.01-pm*0.5*0.01-pn*0.5*0.01+pc*0.001-0.0015,8)+0.0 AS utility FROM p""")
def _(v):
    c = F.col("p_clean")
    s = v.scored.select("id", (c * 0.6).alias("p_favorable"), ((1 - c) * 0.5).alias("p_adverse"), (c * 0.1).alias("p_ambiguous"), (1 - c * 0.6 - (1 - c) * 0.5 - c * 0.1).alias("p_neither"), F.col("score").alias("p_clean"))
    d = P.expected_utility(s, 0.02, 0.01, 0.0015, 0.5, 0.001)
    return rnd(d.select("id", "u_favorable", "u_adverse", "u_ambiguous", "u_unresolved", "u_clean", "utility"), 8)


@query("path_quality", "pl", X + f""",
s AS (SELECT pl.*, r-lag(r,1,0.0) OVER (PARTITION BY symbol, ts, side ORDER BY k) AS dr FROM pl),
q AS (SELECT o.symbol, o.ts, o.side, o.outcome, any_value({_U}) AS u, coalesce(ev,6) AS n, max(fav) AS mfe, max(adv) AS mae, abs(arg_max(r,k))/greatest(sum(abs(dr)),1e-12) AS eff, arg_min(k,-fav*1e6+k*1e-9) AS tm FROM o JOIN s USING (symbol, ts, side) WHERE k<=coalesce(ev,6) GROUP BY 1,2,3,4,ev)
SELECT symbol, ts, side, n::INT AS exit_bar, round(mfe,8)+0.0 AS mfe, round(mae,8)+0.0 AS mae, round(eff,8)+0.0 AS path_efficiency,
 CASE WHEN outcome='FAVORABLE_FIRST' AND u>0 AND mae<={AD} AND mfe/greatest(mae,1e-9)>=1.5 AND eff>=0.25 THEN 'GOOD_WAVE' WHEN outcome='ADVERSE_FIRST_OR_SAME' OR u<=-{CO} THEN 'BAD_WAVE' ELSE 'NEUTRAL_WAVE' END AS wave_label FROM q""")
def _(v):
    d = P.path_quality(v.paths, FV, AD, CO, 1.5, 0.25)
    return rnd(d.select(*KS, "exit_bar", "mfe", "mae", "path_efficiency", "wave_label"), 8)


TEACHER = dict(barrier_favorable=6000.0, barrier_adverse=4000.0, rr_epsilon=1.0, min_mfe=5000.0, max_mae=4000.0, min_ratio=1.5, rr_min=1.2, rr_room=2000.0, cost=14.0, min_efficiency=0.2, max_time=0.7,
               max_pre_adverse=3000.0, min_persistence=0.05, economic_mfe=7000.0, weights=(1.0, 1.5, 0.5, 1.0, 1.0), adverse_span=6000.0, mfe_span=9000.0, majority=3, strict=5, weighted=2.5)


def teacher_sql():
    u = lambda e: f"greatest(0,least(1,{e}))"
    return X + f""",
l AS (SELECT symbol, ts, side, sum(abs(close-pc)) AS pl_, any_value(entry) AS e, arg_max(close,k) AS cl FROM (SELECT *, lag(close,1,entry) OVER (PARTITION BY symbol, ts, side ORDER BY k) AS pc FROM pl) GROUP BY 1,2,3),
m AS (SELECT x.symbol, x.ts, x.side, max(adv)*10000 AS pm FROM x JOIN pl USING (symbol, ts, side) WHERE k<=tm GROUP BY 1,2,3),
t AS (SELECT o.symbol, o.ts, o.side, o.outcome, mfe*10000 AS mfe, mae*10000 AS mae, tm, pm, term*10000 AS term, CASE WHEN pl_>0 THEN abs(cl-e)/pl_ ELSE 0 END AS eff, CASE WHEN pl_>0 THEN (CASE o.side WHEN 'LONG' THEN 1 ELSE -1 END)*(cl-e)/pl_ ELSE 0 END AS per,
 mfe*10000/(mae*10000+1) AS rr FROM o JOIN l USING (symbol, ts, side) JOIN m USING (symbol, ts, side)),
w AS (SELECT *, (mfe>=5000 AND mae<=4000 AND rr>=1.5)::INT AS a, (outcome='FAVORABLE_FIRST')::INT AS b, (rr>=1.2 AND mfe-14>=2000)::INT AS c, (eff>=0.2 AND tm<=4.2 AND pm<=3000 AND per>=0.05)::INT AS d, (mfe>=7000 AND outcome='FAVORABLE_FIRST')::INT AS e,
 100*(0.30*{u('(mfe-14)/9000')}+0.25*{u('rr/4')}+0.20*(CASE outcome WHEN 'FAVORABLE_FIRST' THEN 1 WHEN 'NEITHER_REACHED' THEN 0.25 ELSE 0 END)+0.25*{u(f"(eff+{u('per')}+{u('1-(tm-1)/6.0')}+{u('1-pm/6000')})/4")}) AS q FROM t)"""


@query("teacher_votes", "pl", teacher_sql() + """
SELECT symbol, ts, side, a+b+c+d+e AS votes, a+b+c+d+e>=3 AS majority_ideal, a+b+c+d+e>=5 AS strict_ideal, a*1.0+b*1.5+c*0.5+d*1.0+e*1.0>=2.5 AS weighted_ideal, round(q,6)+0.0 AS quality_score,
 round(CASE outcome WHEN 'FAVORABLE_FIRST' THEN 6000 WHEN 'ADVERSE_FIRST_OR_SAME' THEN -4000 ELSE term END,4)+0.0 AS policy_gross FROM w""")
def _(v):
    d = P.teacher_labels(v.paths, 6, TEACHER).withColumn("policy_gross", F.round("policy_gross", 4) + 0.0)
    return rnd(d.select(*KS, "votes", "majority_ideal", "strict_ideal", "weighted_ideal", "quality_score", "policy_gross"), 6)


@query("ideal_zones", "pl", teacher_sql() + """,
i AS (SELECT symbol, side, ts, round(q,6) AS q, CASE WHEN ts-lag(ts) OVER (PARTITION BY symbol, side ORDER BY ts)<=3*3600000000 THEN 0 ELSE 1 END AS nw FROM w WHERE a+b+c+d+e>=3),
z AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, side ORDER BY ts) AS zone FROM i),
g AS (SELECT symbol, side, zone, min(ts) AS zone_start, max(ts) AS zone_end, count(*) AS zone_rows, arg_max(ts, {'q': q, 'b': -ts}) AS best_ts FROM z GROUP BY 1,2,3)
SELECT z.symbol, z.side, z.ts, z.zone::BIGINT AS zone, zone_start, zone_end, zone_rows, z.ts=best_ts AS zone_best FROM z JOIN g USING (symbol, side, zone)""")
def _(v):
    d = P.teacher_labels(v.paths, 6, TEACHER).withColumn("quality_score", F.round("quality_score", 6)).select(*KS, "majority_ideal", "quality_score")
    return P.ideal_zones(d, F.col("majority_ideal"), 3 * HOUR, "quality_score", ["symbol", "side"]).select("symbol", "side", "ts", F.col("zone").cast("long").alias("zone"), "zone_start", "zone_end", "zone_rows", "zone_best")


@query("early_path_features", "pl", """
s AS (SELECT pl.*, r-lag(r,1,0.0) OVER (PARTITION BY symbol, ts, side ORDER BY k) AS dr FROM pl),
g AS (SELECT symbol, ts, side, d AS delay, arg_max(r,k) AS net, max(r) FILTER (k=greatest(1,d//2)) AS early, sum(abs(dr)) AS path, sum(volume) AS v, sum(buy_volume) AS b, max(fav) AS mfe, max(adv) AS mae,
 arg_min(k,-fav*1e6+k*1e-9)<arg_min(k,-adv*1e6+k*1e-9) AS favorable_move_first FROM s, (VALUES (1),(2),(4)) t(d) WHERE k<=d GROUP BY 1,2,3,4)
SELECT symbol, ts, side, delay, round(net,8)+0.0 AS net, round(net/delay,8)+0.0 AS velocity, round((net-early)-early,8)+0.0 AS acceleration, round(CASE WHEN path>0 THEN abs(net)/path ELSE 0 END,8)+0.0 AS efficiency,
 round((CASE side WHEN 'LONG' THEN 1 ELSE -1 END)*CASE WHEN v>0 THEN (2*b-v)/v ELSE 0 END,8)+0.0 AS flow, round(mfe,8)+0.0 AS mfe, round(mae,8)+0.0 AS mae, favorable_move_first FROM g""")
def _(v):
    d = P.early_path(v.paths, [1, 2, 4])
    return rnd(d.select(*KS, "delay", "net", "velocity", "acceleration", "efficiency", "flow", "mfe", "mae", "favorable_move_first"), 8)


@query("delayed_entry_counterfactual", "bars signals", """
s AS (SELECT signal_id, symbol, side, d AS delay, ((ts+d::BIGINT*60000000+3600000000-1)//3600000000)*3600000000 AS st FROM signals, (VALUES (0),(60),(180)) t(d)),
j AS (SELECT s.*, b.ts, b.open, b.high, b.low, b.close, first_value(b.open) OVER (PARTITION BY signal_id, delay ORDER BY b.ts) AS e FROM s JOIN bars b ON b.symbol=s.symbol AND b.ts BETWEEN s.st AND s.st+3*3600000000),
g AS (SELECT signal_id, symbol, side, delay, min(ts) FILTER ((CASE side WHEN 'LONG' THEN high/e-1 ELSE 1-low/e END)>=0.6) AS hf, min(ts) FILTER ((CASE side WHEN 'LONG' THEN 1-low/e ELSE high/e-1 END)>=0.4) AS ha, arg_max((CASE side WHEN 'LONG' THEN 1 ELSE -1 END)*(close/e-1),ts) AS term FROM j GROUP BY 1,2,3,4 HAVING count(*)=4),
o AS (SELECT *, CASE WHEN ha IS NOT NULL AND (hf IS NULL OR ha<=hf) THEN 'ADVERSE_FIRST_OR_SAME' WHEN hf IS NOT NULL THEN 'FAVORABLE_FIRST' ELSE 'NEITHER_REACHED' END AS outcome, count(*) OVER (PARTITION BY signal_id) AS n FROM g),
u AS (SELECT *, CASE outcome WHEN 'FAVORABLE_FIRST' THEN 0.6-0.0015 WHEN 'ADVERSE_FIRST_OR_SAME' THEN -0.4-0.0015 ELSE term-0.0015 END AS ut FROM o WHERE n=3)
SELECT signal_id, delay, outcome, round(ut,8)+0.0 AS utility, round(ut-max(CASE WHEN delay=0 THEN ut END) OVER (PARTITION BY signal_id),8)+0.0 AS change FROM u""")
def _(v):
    from ..functions.scalars import MINUTE
    d = P.delayed_entry(v.signals, v.bars, HOUR, 4, [0, 60 * MINUTE, 180 * MINUTE], FV, AD, CO)
    return rnd(d.select("signal_id", (F.col("delay") / MINUTE).cast("int").alias("delay"), "outcome", "utility", "change"), 8)


def bar_trades(v):
    """Trades made from signals: entry at the signal price, exit 5 hours later, midpoint 1.5x (LONG) or 0.6x (SHORT)."""
    long = F.col("side") == "LONG"
    return v.signals.select(F.col("signal_id").alias("id"), "symbol", "side", F.col("ts").alias("entry_ts"), (F.col("ts") + 5 * HOUR).alias("exit_ts"), F.col("ref_price").alias("entry_price"),
                            (F.col("ref_price") * F.when(long, 1.5).otherwise(0.6)).alias("midpoint"))


_T = "t AS (SELECT signal_id AS id, symbol, side, ts AS entry_ts, ts+18000000000 AS exit_ts, ref_price AS entry_price, ref_price*CASE side WHEN 'LONG' THEN 1.5 ELSE 0.6 END AS midpoint FROM signals)"


@query("stop_recovery", "bars signals", _T + """,
j AS (SELECT t.*, (b.ts-(t.exit_ts//3600000000+1)*3600000000)//3600000000+1 AS k, b.high, b.low FROM t JOIN bars b ON b.symbol=t.symbol AND b.ts BETWEEN (t.exit_ts//3600000000+1)*3600000000 AND (t.exit_ts//3600000000+1)*3600000000+3*3600000000),
g AS (SELECT id, max(CASE WHEN k<=2 AND (CASE side WHEN 'LONG' THEN high>=entry_price ELSE low<=entry_price END) THEN 1 ELSE 0 END)=1 AS entry_2, max(CASE WHEN (CASE side WHEN 'LONG' THEN high>=entry_price ELSE low<=entry_price END) THEN 1 ELSE 0 END)=1 AS entry_4,
 max(CASE WHEN (CASE side WHEN 'LONG' THEN high>=midpoint ELSE low<=midpoint END) THEN 1 ELSE 0 END)=1 AS midpoint_4 FROM j GROUP BY 1 HAVING count(*)=4)
SELECT *, CASE WHEN entry_4 AND midpoint_4 THEN 'ENTRY_AND_MIDPOINT' WHEN entry_4 THEN 'ENTRY_ONLY' WHEN midpoint_4 THEN 'MIDPOINT_ONLY' ELSE 'NO_RECOVERY' END AS category FROM g""")
def _(v):
    return P.stop_recovery(bar_trades(v), v.bars, HOUR, [2, 4]).select("id", "entry_2", "entry_4", "midpoint_4", "category")


_EX = """
b AS (SELECT symbol, ts, side, k, fav, adv, r, greatest(0,max(fav) OVER w) AS pk, greatest(0,max(adv) OVER w) AS wo FROM pl WINDOW w AS (PARTITION BY symbol, ts, side ORDER BY k)),
g AS (SELECT *, coalesce(min(CASE WHEN pk>=0.2 THEN k END) OVER p, 6) AS gk FROM b WINDOW p AS (PARTITION BY symbol, ts, side))
"""


@query("exit_rule_labels", "pl", _EX + """,
c AS (SELECT g.*, rule, param, adv>=0.7 AS st, CASE rule WHEN 'FIXED_TP' THEN fav>=param WHEN 'FIXED_TRAILING' THEN k>=gk AND pk-r>=param WHEN 'PERCENT_GIVEBACK' THEN k>=gk AND pk>0 AND pk-r>=param*pk WHEN 'TIME_EXIT' THEN k>=gk AND k-gk>=param
  WHEN 'BREAK_EVEN' THEN k>=gk AND pk>=0.3 AND r<=greatest(0.05,pk-param) ELSE false END AS met FROM g, (VALUES ('FIXED_TP',0.8::DOUBLE),('FIXED_TRAILING',0.3),('PERCENT_GIVEBACK',0.4),('TIME_EXIT',2),('BREAK_EVEN',0.25)) t(rule,param)),
e AS (SELECT *, CASE WHEN st THEN 'COMMON_HARD_STOP' WHEN met THEN rule WHEN k=6 THEN 'BOUNDED_HOLD' END AS why, CASE WHEN st THEN -0.7 WHEN met AND rule='FIXED_TP' THEN param ELSE r END AS gr, row_number() OVER (PARTITION BY symbol, ts, side, rule ORDER BY k) AS rn FROM c WHERE st OR met OR k=6)
SELECT rule, side, why AS reason, count(*) AS n, round(avg(gr),6)+0.0 AS gross, round(avg(gr-0.0015),6)+0.0 AS net, sum(k)::BIGINT AS bars, round(avg(pk),6)+0.0 AS peak, round(avg(wo),6)+0.0 AS mae,
 round(avg(CASE WHEN pk>0 THEN greatest(0,gr)/pk ELSE 0 END),6)+0.0 AS capture, round(avg(greatest(0,pk-gr)),6)+0.0 AS giveback FROM e WHERE rn=1 GROUP BY 1,2,3""")
def _(v):
    rules = v.spark.createDataFrame([("FIXED_TP", 0.8), ("FIXED_TRAILING", 0.3), ("PERCENT_GIVEBACK", 0.4), ("TIME_EXIT", 2.0), ("BREAK_EVEN", 0.25)], "rule string, param double")
    d = P.exit_rules(v.paths, rules, K, 0.7, 0.2, CO, arm=0.3, lock=0.05)
    a = lambda c: F.avg(c).alias(c)
    return rnd(d.groupBy("rule", "side", "reason").agg(F.count("*").alias("n"), a("gross"), a("net"), F.sum("exit_bar").alias("bars"), a("peak"), a("mae"), a("capture"), a("giveback")))


@query("trade_path_extrema", "bars signals", _T + """,
j AS (SELECT t.*, (t.entry_ts//3600000000)*3600000000 AS lo, b.ts AS bts, CASE side WHEN 'LONG' THEN high/entry_price-1 ELSE 1-low/entry_price END AS f, CASE side WHEN 'LONG' THEN 1-low/entry_price ELSE high/entry_price-1 END AS a, low<=midpoint AND midpoint<=high AS m
 FROM t JOIN bars b ON b.symbol=t.symbol AND b.ts BETWEEN (t.entry_ts//3600000000)*3600000000 AND t.exit_ts)
SELECT id, count(*) AS bars, round(max(f),8)+0.0 AS mfe_full, round(max(a),8)+0.0 AS mae_full, round(max(f) FILTER (bts>lo AND bts+3600000000<=exit_ts),8)+0.0 AS mfe_open, round(max(a) FILTER (bts>lo AND bts+3600000000<=exit_ts),8)+0.0 AS mae_open,
 arg_max(bts,{'f':f,'t':-bts})-any_value(lo) AS time_to_mfe, arg_max(bts,{'f':a,'t':-bts})-any_value(lo) AS time_to_mae, bool_or(m) AS midpoint_hit FROM j GROUP BY 1""")
def _(v):
    d = P.trade_extrema(bar_trades(v), v.bars, HOUR, 8 * HOUR)
    return rnd(d.select("id", "bars", "mfe_full", "mae_full", "mfe_open", "mae_open", "time_to_mfe", "time_to_mae", "midpoint_hit"), 8)


@query("episode_tables", "pl", _EX + """,
d AS (SELECT g.*, max(fav) OVER (PARTITION BY symbol, ts, side ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fb FROM g)
SELECT side, k::INT AS bars_in_trade, count(*) AS n, round(avg(pk),6)+0.0 AS peak, round(avg(pk-r),6)+0.0 AS giveback_now, round(avg(fb),6)+0.0 AS future_best, (SELECT count(*) FROM pl WHERE pl.k=1 AND pl.side=d.side) AS episodes FROM d WHERE pk>=0.2 GROUP BY 1,2""")
def _(v):
    ep, dec = P.episode_tables(v.paths, K, 0.2)
    n = ep.groupBy("side").agg(F.count("*").alias("episodes"))
    g = dec.groupBy("side", "bars_in_trade").agg(F.count("*").alias("n"), F.avg("peak").alias("peak"), F.avg("giveback_now").alias("giveback_now"), F.avg("future_best").alias("future_best"))
    return rnd(g.join(n, "side"))


@query("giveback_targets", "pl", _EX + """,
d AS (SELECT a.symbol, a.ts, a.side, a.k, a.pk, a.r, coalesce(a.r-min(-b.adv) FILTER (b.k<=a.k+1)>=0.05,false) AS g1, coalesce(a.r-min(-b.adv)>=0.05,false) AS g3, min(b.k) FILTER (a.r+b.adv>=0.05) AS gb, min(b.k) FILTER (b.fav-a.pk>=0.05) AS ne,
 greatest(0,coalesce(max(b.fav),a.pk)-a.pk)/0.2 AS am, greatest(0,a.r-coalesce(min(-b.adv),a.r))/0.2 AS fg FROM b a LEFT JOIN b ON a.symbol=b.symbol AND a.ts=b.ts AND a.side=b.side AND b.k BETWEEN a.k+1 AND a.k+3 WHERE a.pk>=0.2 GROUP BY a.symbol, a.ts, a.side, a.k, a.pk, a.r)
SELECT side, k::INT AS bar, count(*) AS n, sum(g1::INT)::BIGINT AS giveback_next_1, sum(g3::INT)::BIGINT AS giveback_next_3, sum((gb IS NOT NULL AND (ne IS NULL OR gb<=ne))::INT)::BIGINT AS giveback_first, sum((ne IS NOT NULL AND (gb IS NULL OR ne<gb))::INT)::BIGINT AS extreme_first,
 round(avg(am),6)+0.0 AS additional_mfe, round(avg(fg),6)+0.0 AS future_giveback FROM d GROUP BY 1,2""")
def _(v):
    d = P.giveback_targets(v.paths, K, 0.2, 0.2)
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return rnd(d.groupBy("side", "bar").agg(F.count("*").alias("n"), n("giveback_next_1"), n("giveback_next_3"), n("giveback_first"), n("extreme_first"), F.avg("additional_mfe").alias("additional_mfe"), F.avg("future_giveback").alias("future_giveback")))


@query("cost_scenarios", "scored", """
t AS (SELECT id, side, size/1000 AS en, size/1000*(1+net) AS ex, p_clean/10000 AS fr, size/1000*1.001 AS mk, CASE side WHEN 'LONG' THEN 1 ELSE -1 END AS s FROM scored),
c AS (SELECT t.*, sc, fee, slip, fund, en*(1+s*slip/10000) AS ef, ex*(1-s*slip/10000) AS xf FROM t, (VALUES ('A_OPTIMISTIC',4.0::DOUBLE,1.0::DOUBLE,0.5::DOUBLE),('B_BASE',5,2,1),('C_PESSIMISTIC',5,5,2)) v(sc,fee,slip,fund))
SELECT id, sc AS scenario, round(s*(xf/ef-1),8)+0.0 AS gross, round(fee/10000*(1+xf/ef),8)+0.0 AS fees, round(s*fr*mk/ef+fund/10000,8)+0.0 AS funding_paid, round(s*(xf/ef-1)-fee/10000*(1+xf/ef)-(s*fr*mk/ef+fund/10000),8)+0.0 AS net FROM c""")
def _(v):
    p = F.col("size") / 1000
    t = v.scored.select("id", "side", p.alias("entry_price"), (p * (1 + F.col("net"))).alias("exit_price"), (F.col("p_clean") / 10000).alias("funding_rate"), (p * 1.001).alias("mark"))
    sc = v.spark.createDataFrame([("A_OPTIMISTIC", 4.0, 1.0, 0.5), ("B_BASE", 5.0, 2.0, 1.0), ("C_PESSIMISTIC", 5.0, 5.0, 2.0)], "scenario string, fee_bps double, slip_bps double, funding_bps double")
    return rnd(P.cost_scenarios(t, sc).select("id", "scenario", "gross", "fees", "funding_paid", "net"), 8)


@query("execution_quality", "ticks signals", """
f AS (SELECT s.signal_id, s.symbol, s.side, s.ts, s.ref_price, q.price-0.01 AS bid, q.price+0.02 AS ask, q.event_id%7+1 AS bs, q.event_id%5+1 AS az, n.price AS ma FROM signals s ASOF JOIN ticks q ON s.symbol=q.symbol AND s.ts>q.ts ASOF JOIN ticks n ON s.symbol=n.symbol AND s.ts<n.ts),
m AS (SELECT *, (bid+ask)/2 AS mid, CASE side WHEN 'LONG' THEN 1 ELSE -1 END AS s FROM f)
SELECT signal_id, round((ask*bs+bid*az)/(bs+az),8)+0.0 AS microprice, round((ask-bid)/mid*10000,4)+0.0 AS spread_bps, round(s*(ref_price-mid)/mid*10000,4)+0.0 AS shortfall_bps, round(-s*(ma-mid)/mid*10000,4)+0.0 AS adverse_bps,
 round(s*(ref_price-mid)/mid*10000-s*(ma-mid)/mid*10000+5,4)+0.0 AS total_cost_bps FROM m""")
def _(v):
    from ..operators import joins as J
    e = F.col("event_id")
    q = v.ticks.select("symbol", "ts", (F.col("price") - 0.01).alias("bid"), (F.col("price") + 0.02).alias("ask"), (e % 7 + 1).alias("bid_size"), (e % 5 + 1).alias("ask_size"))
    d = J.asof_join(v.signals, q, allow_exact=False)
    d = J.asof_join(d, v.ticks.select("symbol", "ts", F.col("price").alias("mid_after")), allow_exact=False, direction="forward")
    d = P.execution_quality(d.filter("bid is not null and mid_after is not null").withColumns({"fill": F.col("ref_price"), "fee_bps": F.lit(5.0)}))
    d = d.select("signal_id", (F.round("microprice", 8) + 0.0).alias("microprice"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("spread_bps", "shortfall_bps", "adverse_bps", "total_cost_bps")])
    return d


@query("entry_class", "scored", """
SELECT id, CASE WHEN net>0 AND mfe>=0.01 AND mae<=0.01 AND (mae=0 OR mfe/mae>=1.25) THEN 'GOOD_CLEAN' WHEN net<=0 AND (mae>=0.012 OR (mae<>0 AND mfe/mae<1)) THEN 'BAD' ELSE 'MIXED' END AS entry_class FROM scored""")
def _(v):
    return P.entry_class(v.scored, 0.01, 0.01, 0.012, 1.25).select("id", "entry_class")


@query("outcome_maturation", "barsi signals", """
c AS (SELECT s.signal_id, s.symbol, s.side, coalesce(b.i,-1) AS i FROM signals s ASOF LEFT JOIN barsi b ON s.symbol=b.symbol AND s.ts>=b.ts WHERE s.signal_id%100<>0),
j AS (SELECT c.*, b.i AS bi, b.ts, b.open, b.high, b.low, b.close FROM c JOIN barsi b ON b.symbol=c.symbol AND b.i BETWEEN c.i+1 AND c.i+8),
g AS (SELECT signal_id, symbol, side, arg_min(open,bi) AS e, arg_max(close,bi) AS x, max(high) AS h, min(low) AS l, max(ts) AS matured_ts FROM j GROUP BY 1,2,3 HAVING count(*)=8)
SELECT signal_id, symbol, round((CASE side WHEN 'LONG' THEN 1 ELSE -1 END)*(x/e-1),8)+0.0 AS gross, round(CASE side WHEN 'LONG' THEN h/e-1 ELSE 1-l/e END,8)+0.0 AS mfe, round(CASE side WHEN 'LONG' THEN 1-l/e ELSE h/e-1 END,8)+0.0 AS mae, matured_ts FROM g""")
def _(v):
    old = v.signals.filter("signal_id % 100 = 0")
    return rnd(P.mature(v.signals, v.bars, 8, old).select("signal_id", "symbol", "gross", "mfe", "mae", "matured_ts"), 8)
