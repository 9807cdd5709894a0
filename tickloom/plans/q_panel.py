"""Section 2.7."""

from pyspark.sql import functions as F

from ..functions.scalars import HOUR, side_sign
from ..operators import panel as P, scan, windows as W
from .base import REF1, query, rnd


def panel_rets(v):
    """Bars with the 3-bar return, rows with full history only."""
    d = scan.framed(v.bars, ["symbol"], ["ts"], lambda w: {"r": W.ret(w, 3)}, back=3)
    return d.filter("r is not null").select("symbol", "ts", "r", "close")


_R = "p AS (SELECT * FROM (SELECT symbol, ts, close, close/lag(close,3) OVER (PARTITION BY symbol ORDER BY ts)-1 AS r FROM bars) WHERE r IS NOT NULL)"


@query("cross_rank", "bars", _R + """
SELECT a.symbol, a.ts, round(CASE WHEN count(*)=1 THEN 0 ELSE (sum((b.r<a.r)::INT)+(sum((b.r=a.r)::INT)-1)/2.0)/(count(*)-1) END,8)::DOUBLE+0.0 AS mid,
 round((sum((b.r<a.r)::INT)+(sum((b.r=a.r)::INT)+1)/2.0)/count(*),8)::DOUBLE+0.0 AS pct FROM p a JOIN p b ON a.ts=b.ts GROUP BY 1,2""")
def _(v):
    return rnd(panel_rets(v).select("symbol", "ts", P.mid_rank("r").alias("mid"), P.pct_rank("r").alias("pct")), 8)


@query("breadth_dispersion", "bars", _R + """
SELECT symbol, ts, round(avg((r>0)::INT) OVER w,6)+0.0 AS breadth, round(stddev_pop(r) OVER w,6)+0.0 AS dispersion, round(avg(r) OVER w,6)+0.0 AS market,
 round(max(abs(r)) OVER w/greatest(sum(abs(r)) OVER w,1e-15),6)+0.0 AS concentration, round(r-avg(r) OVER w,6)+0.0 AS relative,
 round(r-max(CASE WHEN symbol='purchase' THEN r END) OVER w,6)+0.0 AS vs_reference, round(avg(CASE WHEN symbol<>'purchase' THEN r END) OVER w,6)+0.0 AS alt_basket FROM p WINDOW w AS (PARTITION BY ts)""")
def _(v):
    c = P.cross_stats("r", REF1)
    return rnd(panel_rets(v).withColumns(c).select("symbol", "ts", *c))


@query("residualise", "bars", _R + """,
y AS (SELECT a.symbol, a.ts, a.r, b.r AS x FROM p a JOIN p b ON a.ts=b.ts AND b.symbol='purchase'),
z AS (SELECT *, CASE WHEN count(*) OVER w>=12 THEN covar_samp(r,x) OVER w/nullif(var_samp(x) OVER w,0) END AS beta FROM y WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
f AS (SELECT symbol, ts, r AS future FROM (SELECT symbol, ts-3*3600000000 AS ts, r FROM p)),
j AS (SELECT z.symbol, z.ts, greatest(-3,least(3,beta)) AS beta, future FROM z JOIN f ON z.symbol=f.symbol AND z.ts=f.ts WHERE beta IS NOT NULL),
n AS (SELECT j.*, future-beta*max(CASE WHEN symbol='purchase' THEN future END) OVER (PARTITION BY ts) AS neutral FROM j),
m AS (SELECT ts, median(neutral) AS common FROM n WHERE symbol<>'purchase' AND neutral IS NOT NULL GROUP BY 1)
SELECT symbol, n.ts, s.side, round(s.k*(neutral-common),6)+0.0 AS residual, round(s.k*(neutral-common)-0.0014-0.25*0.01,6)+0.0 AS utility FROM n JOIN m ON n.ts=m.ts, (VALUES ('LONG',1),('SHORT',-1)) s(side,k) WHERE neutral IS NOT NULL""")
def _(v):
    p = panel_rets(v)
    y = p.join(p.filter(F.col("symbol") == REF1).select("ts", F.col("r").alias("x")), "ts")

    def beta(w):
        fr = w.rowsBetween(-24, -1)
        return {"beta": P.clip(F.when(F.count("x").over(fr) >= 12, P.div(F.covar_samp("r", "x").over(fr), F.var_samp("x").over(fr))), -3.0, 3.0)}
    z = scan.framed(y, ["symbol"], ["ts"], beta, back=24).filter("beta is not null")
    f = p.select("symbol", (F.col("ts") - 3 * HOUR).alias("ts"), F.col("r").alias("future"))
    d = z.join(f, ["symbol", "ts"]).select("symbol", "ts", "beta", "future", F.lit(0.01).alias("mae"), F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side"))
    return rnd(P.residualise(d, REF1).filter("residual is not null").select("symbol", "ts", "side", "residual", "utility"))


@query("global_top_n", "scored", """
t AS (SELECT 'largest' AS cut, id, score FROM scored ORDER BY score DESC, net DESC, id LIMIT 50), b AS (SELECT 'smallest' AS cut, id, score FROM scored ORDER BY score, id LIMIT 50),
f AS (SELECT 'fraction' AS cut, id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n FROM scored) WHERE rn <= ceil(n*0.05))
SELECT cut, id, round(score,8)+0.0 AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM f)""")
def _(v):
    s = v.scored
    out = P.top_n(s, 50, F.col("score").desc(), F.col("net").desc(), "id").select(F.lit("largest").alias("cut"), "id", "score")
    out = out.unionByName(P.top_n(s, 50, "score", "id").select(F.lit("smallest").alias("cut"), "id", "score"))
    return rnd(out.unionByName(P.top_fraction(s, "score", "id", 0.05).select(F.lit("fraction").alias("cut"), "id", "score")), 8)


@query("top1_per_timestamp", "scored", "SELECT ts, id FROM (SELECT ts, id, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol, id) AS rn FROM scored) WHERE rn=1")
def _(v):
    return P.winners(v.scored).select("ts", "id")


@query("topk_gated_selection", "scored", """
SELECT ts, id FROM (SELECT ts, id, row_number() OVER (PARTITION BY ts ORDER BY net DESC, p_danger, mae, symbol, id) AS rn FROM scored WHERE p_clean>=0.4 AND p_danger<=0.7 AND mae<=0.018 AND score>0.1) WHERE rn<=2""")
def _(v):
    g = (F.col("p_clean") >= 0.4) & (F.col("p_danger") <= 0.7) & (F.col("mae") <= 0.018) & (F.col("score") > 0.1)
    return P.gated_selection(v.scored, g, 2, F.col("net").desc(), "p_danger", "mae", "symbol", "id").select("ts", "id")


@query("equal_budget", "scored", """
b AS (SELECT min(n) AS b FROM (SELECT regime, count(*) AS n FROM scored GROUP BY 1))
SELECT regime, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score DESC, ts, symbol, id) AS rn FROM scored), b WHERE rn<=b GROUP BY 1""")
def _(v):
    return P.equal_budget(v.scored, "regime").groupBy("regime").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("equal_budget_fold_caps", "scored", """
x AS (SELECT *, id%3 AS fold, row_number() OVER (PARTITION BY regime, id%3 ORDER BY score DESC, ts, symbol, id) AS rn, count(*) OVER (PARTITION BY regime, id%3) AS n FROM scored)
SELECT regime, fold, count(*) AS n, sum(id)::BIGINT AS ids, any_value(CASE WHEN n>=1500+fold*200 THEN 'COMPLETE' ELSE 'SHORTFALL' END) AS status FROM x WHERE rn<=1500+fold*200 GROUP BY 1,2""")
def _(v):
    caps = v.spark.range(3).select(F.col("id").alias("fold"), (1500 + F.col("id") * 200).alias("budget"))
    d = P.equal_budget(v.scored.withColumn("fold", F.col("id") % 3), "regime", caps)
    return d.groupBy("regime", "fold").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("status").alias("status"))


@query("rank_survivors", "scored", "SELECT id, round(p_danger,8)+0.0 AS p_danger FROM (SELECT *, row_number() OVER (ORDER BY p_danger, id) AS rn, count(*) OVER () AS n FROM scored) WHERE rn<=round_even(0.65*n, 0)")
def _(v):
    return rnd(P.survivors(v.scored, "p_danger", 0.35).select("id", "p_danger"), 8)


@query("within_symbol_percentile", "scored", """
r AS (SELECT * FROM scored WHERE regime='F' AND symbol<>'5-LOW'), t AS (SELECT * FROM scored WHERE regime='P'),
a AS (SELECT t.id, count(*) FILTER (r.score<=t.score) AS k, count(*) AS n FROM t JOIN r ON r.symbol=t.symbol GROUP BY 1),
gs AS (SELECT DISTINCT score FROM t WHERE symbol='5-LOW'), g AS (SELECT gs.score, count(*) FILTER (r.score<=gs.score)/count(*)::DOUBLE AS p FROM gs, r GROUP BY 1)
SELECT t.id, t.symbol, round(coalesce(a.k/a.n::DOUBLE, g.p),8)+0.0 AS percentile, a.id IS NULL AS fallback FROM t LEFT JOIN a ON a.id=t.id LEFT JOIN g ON g.score=t.score""")
def _(v):
    s = v.scored
    return rnd(P.ecdf(s.filter("regime = 'F' and symbol <> '5-LOW'"), s.filter("regime = 'P'")).select("id", "symbol", "percentile", "fallback"), 8)


@query("score_deciles", "scored", """
a AS (SELECT 'ascending' AS kind, *, 1+least(9,(row_number() OVER (ORDER BY score, id)-1)*10//count(*) OVER ())::INT AS bucket FROM scored),
d AS (SELECT 'descending' AS kind, *, (10-(row_number() OVER (ORDER BY score DESC, id)-1)*10//count(*) OVER ())::INT AS bucket FROM scored),
g AS (SELECT kind, bucket, count(*) AS n, round(min(score),8)+0.0 AS score_min, round(max(score),8)+0.0 AS score_max, avg(net) AS mean_net FROM (SELECT * FROM a UNION ALL SELECT * FROM d) GROUP BY 1,2)
SELECT kind, bucket, n, score_min, score_max, round(mean_net,8)+0.0 AS mean_net, round(arg_max(mean_net,bucket) OVER (PARTITION BY kind)-arg_min(mean_net,bucket) OVER (PARTITION BY kind),8)+0.0 AS top_minus_bottom FROM g""")
def _(v):
    one = lambda desc, name: P.bucket_economics(P.buckets(v.scored, "score", ["id"], 10, desc), "score").withColumn("kind", F.lit(name))
    return rnd(one(False, "ascending").unionByName(one(True, "descending")), 8)


@query("terciles_quantile_bins", "scored", """
q AS (SELECT side, list_sort(list(size)) AS a, count(*)::INT AS n FROM scored GROUP BY 1),
c AS (SELECT side, a[n//3+1] AS lo, a[2*n//3+1] AS hi FROM q)
SELECT id, CASE WHEN size<=lo THEN 'LOW' WHEN size<=hi THEN 'MID' ELSE 'HIGH' END AS tercile FROM scored JOIN c USING (side)""")
def _(v):
    return P.terciles(v.scored, ["side"], "size").select("id", "tercile")


@query("causal_terciles", "bars", _R + """,
e AS (SELECT *, close>3 AS ok FROM p), n AS (SELECT *, sum(ok::INT) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY ok DESC, r, symbol)-1 AS k FROM e)
SELECT symbol, ts, CASE WHEN NOT ok THEN 'INSUFFICIENT_HISTORY' WHEN n<3 THEN 'INSUFFICIENT_CROSS_SECTION' ELSE ['LOW','MEDIUM','HIGH'][least(2,3*k//n)::INT+1] END AS tercile FROM n""")
def _(v):
    return P.causal_terciles(panel_rets(v), ["ts"], "r", F.col("close") > 3).select("symbol", "ts", "tercile")


@query("risk_coverage_curve", "scored", """
x AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n FROM scored)
SELECT c AS coverage, count(*) AS rows, round(avg(net),8)+0.0 AS net, round(avg(mae),8)+0.0 AS mae, round(avg(mfe)/greatest(1e-9,avg(mae)),6)+0.0 AS ratio, count(DISTINCT symbol) AS symbols
FROM x, (VALUES (1.0::DOUBLE),(0.5),(0.25),(0.1),(0.05),(0.02)) t(c) WHERE rn<=greatest(1,ceil(round(n*c,9))) GROUP BY 1""")
def _(v):
    d = P.risk_coverage(v.scored, "score", "id", [1.0, 0.5, 0.25, 0.1, 0.05, 0.02], F.round(F.avg("net"), 8).alias("net"), F.round(F.avg("mae"), 8).alias("mae"),
                        F.round(F.avg("mfe") / F.greatest(F.lit(1e-9), F.avg("mae")), 6).alias("ratio"), F.count_distinct("symbol").alias("symbols"))
    return d


@query("best_side_symbol_target", "bars", _R + """,
g AS (SELECT ts, max(r) AS l, min(r) AS s, avg(r) AS m FROM p GROUP BY 1)
SELECT ts, round(l-0.001,6)+0.0 AS long_net, round(-s-0.001,6)+0.0 AS short_net, greatest(l,-s)-0.001>=0.5 AS opportunity, CASE WHEN l>=-s THEN 'LONG' ELSE 'SHORT' END AS best_side,
 round(greatest(l,-s)-0.001-abs(m),6)+0.0 AS residual_move, (SELECT min(symbol) FROM p WHERE p.ts=g.ts AND p.r=g.l) AS best_long FROM g""")
def _(v):
    d = panel_rets(v).select("symbol", "ts", (F.col("r") - 0.001).alias("long_net"), (-F.col("r") - 0.001).alias("short_net"), F.col("r").alias("move"))
    return rnd(P.best_side_symbol(d, 0.5).select("ts", "long_net", "short_net", "opportunity", "best_side", "residual_move", "best_long"))


@query("distribution_similarity", "", """
SELECT vec_id, round(e,6)+0.0 AS euclid, round(c,6)+0.0 AS cosine, round(d,6)+0.0 AS diagonal, round(m,6)+0.0 AS median_abs_z FROM (
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS p FROM embeddings),
f AS (SELECT p, stddev_pop(x) AS s, avg(x) FILTER (vec_id%4=3) AS c, var_pop(x) FILTER (vec_id%4=3) AS v FROM l GROUP BY 1)
SELECT vec_id, -sqrt(sum(((x-c)/s)*((x-c)/s))) AS e, sum(x*c)/(sqrt(sum(x*x))*sqrt(sum(c*c))) AS c, -sqrt(sum((x-c)*(x-c)/v)) AS d, median(abs((x-c)/s)) AS m FROM l JOIN f USING (p) GROUP BY 1)""")
def _(v):
    e = v.read("embeddings").select("vec_id", "embedding")
    fit = P.fit_reference(e, "vec_id", "embedding", F.col("vec_id") % 4 == 3)
    return rnd(P.similarity(e, fit, "embedding").select("vec_id", "euclid", "cosine", "diagonal", "median_abs_z"))


@query("entry_score_gates", "scored", """
g AS (SELECT ts, symbol, count(*) AS predictors, avg(score) AS pl, avg(1-score) AS ps, stddev_pop(score) AS d, avg(p_danger) AS tail, avg(net) AS er, avg(p_clean) AS q FROM scored GROUP BY 1,2),
h AS (SELECT *, CASE WHEN greatest(pl,ps)<0.5-1e-9 THEN 'NO_TRADE' WHEN pl>=ps-1e-12 THEN 'LONG' ELSE 'SHORT' END AS side FROM g)
SELECT ts, symbol, predictors, side, round(greatest(0,least(1,q*greatest(0,CASE side WHEN 'LONG' THEN er WHEN 'SHORT' THEN -er ELSE 0 END))),10)+0.0 AS score, round(d,8)+0.0 AS disagreement,
 concat_ws('|', CASE WHEN predictors<2 THEN 'OPPORTUNITY_CALIBRATION_INVALID' END, CASE WHEN tail>0.6+1e-12 THEN 'TAIL_RISK_LIMIT_EXCEEDED' END) AS reasons, predictors>=2 AND NOT tail>0.6+1e-12 AS eligible FROM h""")
def _(v):
    s = v.scored.select("ts", "symbol", F.col("score").alias("p_long"), (1 - F.col("score") - 1e-12).alias("p_short"), F.col("p_danger").alias("tail"), F.col("net").alias("expected_return"), F.col("p_clean").alias("quality"))
    d = P.combine_predictors(s, 0.5 - 1e-9)
    g = P.entry_score(d.select("ts", "symbol", "predictors", "side", "disagreement", F.col("score").alias("combined"), F.lit(1.0).alias("probability"), "expected_return",
                               F.lit(0.0).alias("q90"), (F.col("tail") - 1e-12).alias("tail"), (F.col("predictors") >= 2).alias("calibrated")), 0.02, 0.6, 1.0, 1.0)
    return rnd(g.select("ts", "symbol", "predictors", "side", (F.round("combined", 10) + 0.0).alias("score"), (F.round("disagreement", 8) + 0.0).alias("disagreement"), "reasons", "eligible"), 10)


@query("directional_relative_quality", "scored", """
x AS (SELECT ts, id, p_clean AS o, p_danger AS dg, net AS nm, mfe/(mfe+mae+0.001) AS pe FROM scored),
j AS (SELECT a.ts, a.id, count(*) AS n, sum((b.o<a.o)::INT) AS l1, sum((b.o=a.o)::INT) AS e1, sum((b.dg>a.dg)::INT) AS l2, sum((b.dg=a.dg)::INT) AS e2, sum((b.nm<a.nm)::INT) AS l3, sum((b.nm=a.nm)::INT) AS e3,
 sum((b.pe<a.pe)::INT) AS l4, sum((b.pe=a.pe)::INT) AS e4 FROM x a JOIN x b ON a.ts=b.ts GROUP BY 1,2),
k AS (SELECT id, CASE WHEN n=1 THEN 1 ELSE (l1+(e1-1)/2.0)/(n-1) END AS a1, CASE WHEN n=1 THEN 1 ELSE (l2+(e2-1)/2.0)/(n-1) END AS a2, CASE WHEN n=1 THEN 1 ELSE (l3+(e3-1)/2.0)/(n-1) END AS a3, CASE WHEN n=1 THEN 1 ELSE (l4+(e4-1)/2.0)/(n-1) END AS a4 FROM j)
SELECT id, round(a1,8)::DOUBLE+0.0 AS opportunity_pct, round(a2,8)::DOUBLE+0.0 AS danger_pct, round(a3,8)::DOUBLE+0.0 AS net_pct, round(a4,8)::DOUBLE+0.0 AS path_pct, round((a1+a2+a3+a4)/4,8)::DOUBLE+0.0 AS quality FROM k""")
def _(v):
    s = v.scored.select("ts", "id", F.col("p_clean").alias("opportunity"), F.col("p_danger").alias("danger"), F.col("net").alias("net_mean"), F.col("mfe").alias("mfe_q50"), F.col("mae").alias("mae_q90"))
    return rnd(P.relative_quality(s).select("id", "opportunity_pct", "danger_pct", "net_pct", "path_pct", "quality"), 8)


@query("conservative_bounds_score", "scored", """
x AS (SELECT id, greatest(0,p_clean-0.5*0.1) AS sl, net-0.5*0.01 AS nl, greatest(0,mae+0.5*0.002) AS mu, greatest(0,score+0.5*0.2) AS tu,
 greatest(least(1,0.1/0.5),least(1,0.01/0.02),least(1,0.002/0.01),least(1,0.2)) AS un FROM scored),
y AS (SELECT *, 1/(1+exp(-greatest(-30,least(30,nl/0.02)))) AS nq, exp(-mu/0.01) AS mq, greatest(0,1-least(1,tu)) AS sq FROM x)
SELECT id, round(sl,8)+0.0 AS success_lower, round(nl,8)+0.0 AS net_lower, round(sl*nq*mq*sq*(1-un),8)+0.0 AS score_success_net_mae_speed_certainty, round(sl*nq,8)+0.0 AS score_success_net, round(mq*sq,8)+0.0 AS score_mae_speed FROM y""")
def _(v):
    s = v.scored.select("id", F.col("p_clean").alias("success"), F.lit(0.1).alias("success_unc"), "net", F.lit(0.01).alias("net_unc"), "mae", F.lit(0.002).alias("mae_unc"), F.col("score").alias("time"),
                        F.lit(0.2).alias("time_unc"), F.lit(0.02).alias("atr"), F.lit(0.01).alias("adverse"))
    d = P.bounds_score(s, 0.5, [("success", "net", "mae", "speed", "certainty"), ("success", "net"), ("mae", "speed")])
    return rnd(d.select("id", "success_lower", "net_lower", "score_success_net_mae_speed_certainty", "score_success_net", "score_mae_speed"), 8)


@query("policy_masks", "scored", """
x AS (SELECT *, score>=0.4 AS o, net>-0.03 AS c, net>0 AND p_danger<0.8 AS k FROM scored)
SELECT 'ALL' AS policy, count(*) AS n, round(avg(net),8)+0.0 AS net FROM x UNION ALL SELECT 'OPPORTUNITY_GATE', count(*), round(avg(net),8)+0.0 FROM x WHERE o
UNION ALL SELECT 'CONFIRMATION', count(*), round(avg(net),8)+0.0 FROM x WHERE c UNION ALL SELECT 'OPPORTUNITY_CONFLICT_GATE', count(*), round(avg(net),8)+0.0 FROM x WHERE o AND k""")
def _(v):
    o = F.col("score") >= 0.4
    m = {"ALL": F.lit(True), "OPPORTUNITY_GATE": o, "CONFIRMATION": F.col("net") > -0.03, "OPPORTUNITY_CONFLICT_GATE": o & (F.col("net") > 0) & (F.col("p_danger") < 0.8)}
    return rnd(P.policies(v.scored, m, F.avg("net").alias("net")), 8)


@query("model_consensus", "scored", """
x AS (SELECT id, [p_clean/(p_clean+p_danger+1), p_danger/(p_clean+p_danger+1), 1/(p_clean+p_danger+1)] AS p, [score/(score+1.5), 0.5/(score+1.5), 1.0/(score+1.5)] AS q FROM scored),
l AS (SELECT id, unnest(p)::DOUBLE AS a, unnest(q)::DOUBLE AS b, generate_subscripts(p,1) AS i FROM x),
g AS (SELECT id, 0.5*(sum(a*ln((a+1e-12)/((a+b)/2+1e-12)))+sum(b*ln((b+1e-12)/((a+b)/2+1e-12)))) AS js, arg_max(i,a)=arg_max(i,b) AS agree, max((a+b)/2) AS bt FROM l GROUP BY 1)
SELECT id, round(js,8)+0.0 AS divergence, agree, round(bt,8)+0.0 AS blend_top, agree AND js<=0.08 AS eligible FROM g""")
def _(v):
    t = F.col("p_clean") + F.col("p_danger") + 1
    u = F.col("score") + 1.5
    s = v.scored.select("id", F.array(F.col("p_clean") / t, F.col("p_danger") / t, 1 / t).alias("p"), F.array(F.col("score") / u, 0.5 / u, 1.0 / u).alias("q"))
    return rnd(s.select("id", *[c.alias(n) for n, c in P.consensus(F.col("p"), F.col("q"), 0.08).items()]), 8)
