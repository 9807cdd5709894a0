"""Section 2.11."""

from pyspark.sql import functions as F

from ..functions.scalars import DAY, day_no
from ..operators import joins as J, models as M, splits as S, stats as ST
from .base import query, rnd

D = 86400000000
_T = "t AS (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM scored))"


@query("walk_forward_expanding", "scored", _T + f""",
f AS (SELECT f, (SELECT ts FROM t WHERE k=least(n-2, floor(n*p)::BIGINT)) AS te, (SELECT ts FROM t WHERE k=least(n-1, floor(n*least(0.9,p+0.1))::BIGINT)) AS ve FROM (VALUES (0,0.5::DOUBLE),(1,0.6),(2,0.7),(3,0.8)) x(f,p))
SELECT f AS fold, CASE WHEN ts<=te-7200000000 THEN 'TRAIN' ELSE 'VALIDATION' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM scored, f WHERE ts<=te-7200000000 OR (ts>te AND ts<=ve) GROUP BY 1,2""")
def _(v):
    return S.walk_forward(v.scored, 4, 7200000000).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_W = [(1, 9131, 9800, 9802, 9900, 9902, 10100), (2, 9131, 10200, 10203, 10400, 10402, 11500)]


@query("explicit_folds", "scored", f"""
f AS (SELECT * FROM (VALUES {', '.join(str(w) for w in _W)}) t(fold,a,b,c,d,e,g)), x AS (SELECT fold, ts//{D} AS d, a, b, c, d AS dd, e, g FROM scored, f)
SELECT fold::INT AS fold, CASE WHEN x.d BETWEEN a AND b THEN 'TRAIN' WHEN x.d BETWEEN c AND dd THEN 'CALIBRATION' ELSE 'SCORING' END AS part, count(*) AS n FROM x WHERE x.d BETWEEN a AND b OR x.d BETWEEN c AND dd OR x.d BETWEEN e AND g GROUP BY 1,2""".replace("fold, ts//86400000000 AS d, a, b, c, d AS dd", "fold, ts//86400000000 AS d, a, b, c, f.d AS dd"))
def _(v):
    w = [(i, *[x * DAY for x in r]) for i, *r in _W]
    return S.explicit_folds(v.scored, w, 2 * DAY).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query("chronological_split", "scored", _T + f""",
b AS (SELECT (SELECT ts FROM t WHERE k=floor(n*0.6)::BIGINT) AS tb, (SELECT ts FROM t WHERE k=floor(n*(0.6+0.2::DOUBLE))::BIGINT) AS vb),
p AS (SELECT s.*, CASE WHEN ts<=tb-{D} THEN 'TRAIN' WHEN ts>tb AND ts<=vb-{D} THEN 'VALIDATION' WHEN ts>vb THEN 'TEST' END AS part, tb, vb FROM scored s, b)
SELECT part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p WHERE part='TEST' OR (part='TRAIN' AND ts<tb-{D}-5*{D}::BIGINT+1) OR (part='VALIDATION' AND ts<vb-{D}-5*{D}::BIGINT+1) GROUP BY 1""")
def _(v):
    return S.chronological(v.scored, 0.6, 0.2, DAY, 5 * DAY).groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("rolling_day_walk_forward", "scored", f"""
t AS (SELECT id, 'v' || (id%6) AS variant, ts//{D} AS day, net AS gross, score AS strength FROM scored), p AS (SELECT variant, day, count(*) AS n, sum(gross-0.001) AS s FROM t GROUP BY 1,2), d AS (SELECT DISTINCT day FROM t),
g AS (SELECT d.day, p.variant, sum(p.n) AS n, sum(p.s) AS s FROM d JOIN p ON p.day BETWEEN d.day-20 AND d.day-1 GROUP BY 1,2), b AS (SELECT day, arg_max(variant, {{'a': round(s/20,12), 'b': variant}}) AS variant FROM g WHERE n>=10 AND n/20.0 BETWEEN 0.5 AND 8 AND s>0 GROUP BY 1),
k AS (SELECT t.*, row_number() OVER (PARTITION BY t.day ORDER BY strength DESC, id) AS rn FROM t JOIN b ON b.day=t.day AND b.variant=t.variant)
SELECT id, day, variant, round(gross-0.001,8)+0.0 AS net FROM k WHERE rn<=2""")
def _(v):
    t = v.scored.select("id", "ts", F.concat(F.lit("v"), (F.col("id") % 6).cast("string")).alias("variant"), F.col("net").alias("gross"), F.col("score").alias("strength"))
    return rnd(S.daily_walk_forward(t, 20, 10, (0.5, 8.0), 2, 0.001).select("id", "day", "variant", "net"), 8)


FE = ["score", "p_clean", "p_danger", "mae"]


@query("linear_logistic_fit", "scored", """
y AS (SELECT (score+p_clean-p_danger>0.4)::INT AS y FROM scored)
SELECT count(*) AS n, 0.0::DOUBLE AS intercept_equation, 0.0::DOUBLE AS score_equation, round(avg(y),4)+0.0 AS mean_p, round(0.5::DOUBLE,4) AS mean_balanced_p FROM y""")
def _(v):
    # the fit is checked by what defines it: penalised score equations, and weighted rates under balanced weights
    d = v.scored.withColumn("y", (F.col("score") + F.col("p_clean") - F.col("p_danger") > 0.4).cast("double"))
    p = M.exported(M.fit_linear(d, FE, "y", "logistic", 0.001), FE)
    q = M.exported(M.fit_linear(d, FE, "y", "logistic", 0.001, weight="balanced"), FE)
    e = M.balanced(d.withColumns({"p": M.score_linear(p), "q": M.score_linear(q)}), "y", "w")
    worst = F.greatest(*[F.abs(F.avg((F.col(n) - mu) / sd * (F.col("p") - F.col("y"))) + 0.001 * c) for n, mu, sd, c in zip(FE, p["mean"], p["scale"], p["coef"])])
    return e.agg(F.count("*").alias("n"), (F.round(F.avg(F.col("p") - F.col("y")), 4) + 0.0).alias("intercept_equation"), (F.round(worst, 4) + 0.0).alias("score_equation"),
                 (F.round(F.avg("p"), 4) + 0.0).alias("mean_p"), F.round(F.sum(F.col("w") * F.col("q")) / F.sum("w"), 4).alias("mean_balanced_p"))


@query("tree_fit", "scored", "SELECT count(*) AS n, true AS few_leaves, 0.0::DOUBLE AS worst_leaf_gap, true AS better_than_rate FROM scored")
def _(v):
    # one tree over all rows: a leaf predicts the rate of its rows, and boosting has to beat the overall rate
    d = v.scored.withColumn("y", (F.col("score") * F.col("p_clean") > 0.2).cast("double"))
    one = M.predict(M.fit_trees(d, FE, "y", "forest", trees=1), d, "p").groupBy("p").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    one = one.agg(F.sum("n").alias("n"), (F.count("*") <= 8).alias("few_leaves"), (F.round(F.max(F.abs(F.col("p") - F.col("y"))), 6) + 0.0).alias("worst_leaf_gap"))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    loss = lambda c: -F.avg(F.col("y") * F.log(c) + (1 - F.col("y")) * F.log(1 - c))
    b = M.predict(M.fit_trees(d, FE, "y", "gbt", trees=5), d, "p")
    b = b.crossJoin(F.broadcast(d.agg(F.avg("y").alias("_r")))).agg((loss(p) < loss(F.col("_r"))).alias("better_than_rate"))
    return one.crossJoin(F.broadcast(b))


_RANK = ["volume", "trades", "open"]


def _ranked_pairs(v):
    w = M.fit_panel_ranker(v.bars, "close", _RANK)
    return J.pairwise(v.bars.select("symbol", "ts", "close", *_RANK), "close", _RANK), {f"d_{f}": x for f, x in w.items()}


@query("pairwise_ranker")
def _(v):
    return M.pair_accuracy(*_ranked_pairs(v))


@query("pairwise_ranker_equation", "bars", """
SELECT count(*) AS pairs, 0.0::DOUBLE AS score_equation FROM bars a JOIN bars b ON a.ts=b.ts AND a.symbol<b.symbol AND a.close<>b.close""")
def _(v):
    # the fit never sees this table of pairs; at its weights the penalised score equations hold over it
    p, w = _ranked_pairs(v)
    z = sum((x * F.col(c) for c, x in w.items()), F.lit(0.0))
    gap = 1 / (1 + F.exp(-z)) - F.col("prefer_first")
    worst = [F.abs(F.avg(F.col(c) * gap) / F.sqrt(F.avg(F.col(c) ** 2)) + 0.01 * x * F.sqrt(F.avg(F.col(c) ** 2))) for c, x in w.items()]
    return p.agg(F.count("*").alias("pairs"), (F.round(F.greatest(*worst), 6) + 0.0).alias("score_equation"))


@query("calibration")
def _(v):
    fit = v.scored.filter("regime = 'F'").withColumn("y", (F.col("net") + F.col("p_clean") / 10 > 0.05).cast("int"))
    ev = v.scored.filter("regime <> 'F'").withColumn("y", (F.col("net") + F.col("p_clean") / 10 > 0.05).cast("int"))
    d = M.apply_isotonic(M.fit_isotonic(fit, "p_clean", "y"), ev.withColumn("platt", M.apply_platt("p_clean", M.fit_platt(fit, "p_clean", "y"))), "p_clean", "isotonic")
    return M.select_calibrator(d.withColumn("raw", F.col("p_clean")), ["raw", "platt", "isotonic"], "y")


@query("calibration_isotonic", "scored", """
d AS (SELECT mae*49 AS x, count(*) AS n, sum((net+mae*4.9>0.04)::INT) AS s FROM scored GROUP BY 1),
c AS (SELECT x, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER w - n AS n0, sum(s) OVER w - s AS s0 FROM d WINDOW w AS (ORDER BY x)),
m AS (SELECT a.x AS ax, b.x, min((b.s1-a.s0)/(b.n1-a.n0)) OVER (PARTITION BY a.x ORDER BY b.x DESC) AS v FROM c a JOIN c b ON b.x>=a.x)
SELECT id, round(v,9)+0.0 AS p FROM scored JOIN (SELECT x, max(v) AS v FROM m GROUP BY 1) f ON f.x=mae*49""")
def _(v):
    d = v.scored.select("id", (F.col("mae") * 49).alias("x"), (F.col("net") + F.col("mae") * 4.9 > 0.04).cast("int").alias("y"))
    return M.apply_isotonic(M.fit_isotonic(d, "x", "y"), d, "x", "p").select("id", (F.round("p", 9) + 0.0).alias("p"))


@query("calibration_shrinkage", "scored", """
g AS (SELECT symbol, count(*) AS n, avg(label) AS l FROM scored GROUP BY 1), a AS (SELECT avg(label) AS gl FROM scored)
SELECT symbol, n, round(l,8)+0.0 AS local, round(gl,8)+0.0 AS "global", round(n/(n+500.0),8)::DOUBLE+0.0 AS local_weight, round(gl*(1-n/(n+500.0))+l*n/(n+500.0),8)+0.0 AS shrunk FROM g, a""")
def _(v):
    return rnd(M.shrunk_rates(v.scored, "symbol", "label", 500.0), 8)


TREE = {"feature": "score", "threshold": 0.5, "left": {"feature": "mae", "threshold": 0.01, "left": {"value": 0.1}, "right": {"value": -0.2}}, "right": {"value": 0.3}}


@query("score_frozen_model", "scored", """
SELECT id, round(1/(1+exp(-(0.1+0.7*(score-0.5)/0.3-0.4*(p_danger-0.5)/0.29))),8)+0.0 AS linear, round(0.05+0.5*(CASE WHEN score<=0.5 THEN CASE WHEN mae<=0.01 THEN 0.1 ELSE -0.2 END ELSE 0.3 END),8)::DOUBLE+0.0 AS tree FROM scored""")
def _(v):
    p = dict(names=["score", "p_danger"], median=[0.5, 0.5], mean=[0.5, 0.5], scale=[0.3, 0.29], coef=[0.7, -0.4], intercept=0.1, kind="logistic")
    return rnd(v.scored.select("id", M.score_linear(p).alias("linear"), M.score_ensemble([TREE], 0.05, 0.5).alias("tree")), 8)


@query("heldout_rank_metrics", "ticks", """
s AS (SELECT symbol AS session, event_id AS id, ts, CASE WHEN sgn>0 THEN 'LONG' ELSE 'SHORT' END AS side, price AS score, user_id%50=0 AS pos, user_id%50<>0 AND user_id%3=0 AS neg FROM ticks),
n AS (SELECT score, row_number() OVER (ORDER BY score DESC, id)-1 AS r FROM s WHERE neg), th AS (SELECT score AS threshold FROM n WHERE r=least((SELECT count(*) FROM n)-1, 5*(SELECT count(DISTINCT session) FROM s)-1)),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY session) AS candidates FROM s), e AS (SELECT session, side, ts FROM s, th WHERE score>=threshold),
p AS (SELECT * FROM k, th WHERE pos), j AS (SELECT p.id, p.rank, p.candidates, p.threshold, p.ts, min(abs(e.ts-p.ts))/60000000.0::DOUBLE AS er FROM p LEFT JOIN e ON e.session=p.session AND e.side=p.side GROUP BY 1,2,3,4,5)
SELECT id, rank, candidates, round(1-(rank-1)/greatest(1,candidates-1)::DOUBLE,8)+0.0 AS percentile, threshold, round(er,4)+0.0 AS nearest_error, coalesce(er<=60,false) AS capture_60 FROM j""")
def _(v):
    u = F.col("user_id")
    s = v.ticks.select(F.col("symbol").alias("session"), F.col("event_id").alias("id"), "ts", F.when(F.col("sgn") > 0, "LONG").otherwise("SHORT").alias("side"), F.col("price").alias("score"), (u % 50 == 0).alias("positive"), ((u % 50 != 0) & (u % 3 == 0)).alias("train_negative"))
    d = S.heldout_ranks(s, tolerances=(60,)).select("id", "rank", "candidates", (F.round("percentile", 8) + 0.0).alias("percentile"), "threshold", (F.round("nearest_error", 4) + 0.0).alias("nearest_error"), "capture_60")
    return d


@query("contract_assignment", "scored", """
r AS (SELECT id, symbol AS regime, 'C' || c AS contract, net*c+(id%7)/1000.0::DOUBLE*(4-c) AS u FROM scored, range(1,4) t(c)), g AS (SELECT regime, contract, count(*) AS n, avg(u) AS m FROM r GROUP BY 1,2), a AS (SELECT contract, count(*) AS n, avg(u) AS m FROM r GROUP BY 1),
gb AS (SELECT * FROM a ORDER BY round(m,12) DESC, contract DESC LIMIT 1), z AS (SELECT regime, count(DISTINCT id) AS sz FROM r GROUP BY 1), l AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY round(m,12) DESC, contract DESC) AS rn FROM g WHERE n>=100)
SELECT z.regime, CASE WHEN sz>=(SELECT median(sz) FROM z) THEN 'REGIME' ELSE 'GLOBAL' END AS source, CASE WHEN sz>=(SELECT median(sz) FROM z) THEN l.contract ELSE gb.contract END AS contract, round(CASE WHEN sz>=(SELECT median(sz) FROM z) THEN l.m ELSE gb.m END,8)+0.0 AS mean_utility, CASE WHEN sz>=(SELECT median(sz) FROM z) THEN l.n ELSE gb.n END AS n FROM z, gb, l WHERE l.regime=z.regime AND l.rn=1""")
def _(v):
    c = F.col("c")
    d = v.scored.withColumn("c", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    r = d.select("id", F.col("symbol").alias("regime"), F.concat(F.lit("C"), c.cast("string")).alias("contract"), (F.col("net") * c + (F.col("id") % 7) / 1000.0 * (4 - c)).alias("utility"))
    least = v.scored.groupBy("symbol").count().agg(F.percentile("count", F.lit(0.5))).first()[0]  # half of the regimes are too small for a contract of their own
    return rnd(S.assign_contracts(r, least, 100), 8)


@query("model_competition", "scored", """
f AS (SELECT 'm' || (id%5) AS candidate, regime AS fold, avg(net) AS score, any_value(id%5)::DOUBLE AS cost FROM scored GROUP BY 1,2), g AS (SELECT candidate, min(score) AS worst_fold, avg(score) AS mean, stddev_pop(score) AS std, max(cost) AS cost FROM f GROUP BY 1)
SELECT candidate, round(worst_fold,8)+0.0 AS worst_fold, round(mean,8)+0.0 AS mean, round(std,8)+0.0 AS std, cost, row_number() OVER (ORDER BY round(worst_fold,12) DESC, round(mean,12) DESC, round(std,12), cost, candidate)::INT AS rank FROM g""")
def _(v):
    i = F.col("id") % 5
    f = v.scored.groupBy(F.concat(F.lit("m"), i.cast("string")).alias("candidate"), F.col("regime").alias("fold")).agg(F.avg("net").alias("score"), F.max(i).cast("double").alias("cost"))
    return rnd(S.rank_candidates(f), 8)
