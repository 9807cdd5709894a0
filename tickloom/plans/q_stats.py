"""Section 2.9."""

from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, day_no, iso_week, month_key
from ..operators import order_stats as OS, scan, stats as S
from .base import query, rnd

D = "86400000000"
_PF = "CASE WHEN l>0 THEN g/l WHEN g>0 THEN 'inf'::DOUBLE ELSE 0 END"


@query("economic_summary", "scored", """
s AS (SELECT side, symbol, count(*) AS n, sum(net) AS s, sum(CASE WHEN net>0 THEN net ELSE 0 END) AS g, sum(CASE WHEN net<0 THEN -net ELSE 0 END) AS l, sum((net>0)::INT) AS w, sum(mae) AS a, sum(mfe) AS f FROM scored GROUP BY 1,2),
t AS (SELECT side, sum(n)::BIGINT AS n, sum(s) AS s, sum(g) AS g, sum(l) AS l, sum(w) AS w, sum(a) AS a, sum(f) AS f, max(n) AS m, sum((s>0)::INT)::BIGINT AS p FROM s GROUP BY 1)
SELECT side, n, round(s/n,9)+0.0 AS expectancy, round(g/l,8)+0.0 AS profit_factor, round(w/n,8)+0.0 AS win_rate, round(a/n,8)+0.0 AS mean_mae, round(f/n,8)+0.0 AS mean_mfe, round(m/n,8)+0.0 AS max_symbol_share, p AS positive_symbols FROM t""")
def _(v):
    d = S.economic_summary(v.scored, "net", ["side"]).withColumn("expectancy", F.round("expectancy", 9) + 0.0)
    return d.select("side", "n", "expectancy", *[(F.round(c, 8) + 0.0).alias(c) for c in ("profit_factor", "win_rate", "mean_mae", "mean_mfe", "max_symbol_share")], "positive_symbols")


_RULES = ["inf", "inf_or_zero", "null", "zero", "cap99", "cap1e9", "eps"]


@query("profit_factor_rules", "scored", """
t AS (SELECT ts, sum(CASE WHEN net>0 THEN net ELSE 0 END) AS g, sum(CASE WHEN net<0 THEN -net ELSE 0 END) AS l FROM scored GROUP BY 1),
u AS (SELECT r, CASE WHEN l>0 THEN g/l ELSE CASE r WHEN 'inf' THEN 1e300 WHEN 'inf_or_zero' THEN CASE WHEN g>0 THEN 1e300 ELSE 0 END WHEN 'null' THEN NULL WHEN 'zero' THEN 0 WHEN 'cap99' THEN CASE WHEN g>0 THEN 99 ELSE 0 END WHEN 'cap1e9' THEN CASE WHEN g>0 THEN 1e9 ELSE 0 END ELSE CASE WHEN g>0 THEN 1e14 ELSE 0 END END END AS pf
 FROM t, (VALUES ('inf'),('inf_or_zero'),('null'),('zero'),('cap99'),('cap1e9'),('eps')) x(r))
SELECT r AS rule, count(pf) AS n, sum((pf>1)::INT)::BIGINT AS above_one, sum((pf>1e8)::INT)::BIGINT AS huge FROM u GROUP BY 1""")
def _(v):
    g, l = S.gain_loss("net")
    t = v.scored.groupBy("ts").agg(g.alias("g"), l.alias("l"))
    d = t.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), S.profit_factor(F.col("g"), F.col("l"), r).alias("pf")) for r in _RULES])).alias("x")).select("x.*")
    return d.groupBy("rule").agg(F.count("pf").alias("n"), S.n_(F.col("pf") > 1).alias("above_one"), S.n_(F.col("pf") > 1e8).alias("huge"))


@query("cvar_worst_n", "scored", """
x AS (SELECT side, net, row_number() OVER (PARTITION BY side ORDER BY net, id) AS rn, count(*) OVER (PARTITION BY side) AS n FROM scored),
q AS (SELECT side, quantile_cont(net,0.05) AS q FROM scored GROUP BY 1), e AS (SELECT s.side, avg(s.net) AS es FROM scored s JOIN q ON s.side=q.side AND s.net<=q.q GROUP BY 1)
SELECT x.side, count(*) AS tail_rows, round(avg(net),8)+0.0 AS cvar, round(any_value(es),8)+0.0 AS shortfall FROM x JOIN e ON e.side=x.side WHERE rn<=ceil(round(n*0.05,9)) GROUP BY 1""")
def _(v):
    a = S.cvar(v.scored, "net", 0.05, ["side"])
    return rnd(a.join(S.expected_shortfall(v.scored, "net", 0.05, ["side"]).select("side", "shortfall"), "side"), 8)


@query("max_drawdown", "scored", """
x AS (SELECT side, ts, id, sum(net) OVER (PARTITION BY side ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS c, net FROM scored),
y AS (SELECT side, net, greatest(0, max(c) OVER (PARTITION BY side ORDER BY ts, id ROWS UNBOUNDED PRECEDING))-c AS dd FROM x)
SELECT side, round(max(dd),8)+0.0 AS max_drawdown, round(sum(net),8)+0.0 AS total, count(*) AS n FROM y GROUP BY 1""")
def _(v):
    return rnd(S.max_drawdown(v.scored, "net", ["ts", "id"], ["side"]), 8)


@query("max_drawdown_global", "scored", """
x AS (SELECT sum(net) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS c, ts, id, net FROM scored), y AS (SELECT net, greatest(0, max(c) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING))-c AS dd FROM x)
SELECT round(max(dd),8)+0.0 AS max_drawdown, round(sum(net),8)+0.0 AS total, count(*) AS n FROM y""")
def _(v):
    return rnd(S.max_drawdown(v.scored, "net", ["ts", "id"]), 8)


@query("sortino_episode", "scored", "SELECT symbol, count(*) AS n, count(*) FILTER (net<0) AS negatives, round(avg(net)/stddev_pop(net) FILTER (net<0),8)+0.0 AS sortino FROM scored GROUP BY 1")
def _(v):
    return rnd(S.sortino(v.scored, "net", ["symbol"]), 8)


@query("quantile_variants", "scored", """
a AS (SELECT side, list_sort(list(net)) AS v, count(*)::INT AS n FROM scored GROUP BY 1), q AS (SELECT side, quantile_cont(net,0.9) AS l FROM scored GROUP BY 1)
SELECT a.side, round(l,8)+0.0 AS linear, round(v[ceil(round(n*0.9,9))::INT],8)+0.0 AS nearest_rank, round(v[ceil(round((n-1)*0.9,9))::INT+1],8)+0.0 AS higher, round(v[floor(round((n-1)*0.9,9))::INT+1],8)+0.0 AS floor_index, round(v[greatest(ceil(round(n*0.9,9))::INT,1)],8)+0.0 AS inverted_cdf FROM a JOIN q USING (side)""")
def _(v):
    out = None
    for k in ("linear", "nearest_rank", "higher", "floor_index", "inverted_cdf"):
        d = OS.quantiles(v.scored, ["side"], "net", {k: 0.9}, k).drop("n")
        out = d if out is None else out.join(d, "side")
    return rnd(out, 8)


@query("temporal_thirds", "scored", """
r AS (SELECT 'rows' AS variant, ((row_number() OVER (ORDER BY ts, symbol, id))*3-1)//count(*) OVER ()+1 AS third, net FROM scored),
t AS (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM scored)),
d AS (SELECT 'split' AS variant, CASE WHEN k<(n%3)*(n//3+1) THEN k//(n//3+1) ELSE n%3+(k-(n%3)*(n//3+1))//(n//3) END+1 AS third, net FROM scored JOIN t USING (ts)),
b AS (SELECT 'boundary' AS variant, CASE WHEN k<n//3 THEN 1 WHEN k<2*n//3 THEN 2 ELSE 3 END AS third, net FROM scored JOIN t USING (ts))
SELECT variant, third::INT AS third, count(*) AS n, round(avg(net),9)+0.0 AS mean FROM (SELECT * FROM r UNION ALL SELECT * FROM d UNION ALL SELECT * FROM b) GROUP BY 1,2""")
def _(v):
    one = lambda k: S.temporal_thirds(v.scored, "net", k).select(F.lit(k).alias("variant"), "third", "n", "mean")
    return rnd(one("rows").unionByName(one("split")).unionByName(one("boundary")), 9)


@query("time_folds", "scored", """
x AS (SELECT net, row_number() OVER (ORDER BY ts, id)-1 AS r, count(*) OVER () AS n FROM scored),
f AS (SELECT f, x.net FROM x, range(7) t(f) WHERE r>=n*f//7 AND r<n*(f+1)//7)
SELECT (f+1)::INT AS fold, count(*) AS n, round(avg(net),9)+0.0 AS mean, avg(net)>0 AS positive FROM f GROUP BY 1""")
def _(v):
    return rnd(S.equal_folds(v.scored, 7, "net", ["ts", "id"]), 9)


@query("wilson_ci", "scored", """
g AS (SELECT symbol, side, sum((net>0)::INT)::BIGINT AS k, count(*) AS n FROM scored GROUP BY 1,2), z AS (SELECT *, k/n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT symbol, side, k, n, round(p,8)+0.0 AS rate, round((p+z*z/(2*n))/(1+z*z/n)-z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n),8)+0.0 AS lower, round((p+z*z/(2*n))/(1+z*z/n)+z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n),8)+0.0 AS upper FROM z""")
def _(v):
    return rnd(S.wilson_ci(v.scored, ["symbol", "side"], F.col("net") > 0), 8)


@query("cluster_mean_ci", "scored", f"""
u AS (SELECT side, ts//{D} AS d, avg(net) AS m FROM scored GROUP BY 1,2)
SELECT side, count(*) AS units, round(avg(m),9)+0.0 AS mean, round(avg(m)-1.959963984540054*stddev_samp(m)/sqrt(count(*)),9)+0.0 AS lower, round(avg(m)+1.959963984540054*stddev_samp(m)/sqrt(count(*)),9)+0.0 AS upper FROM u GROUP BY 1""")
def _(v):
    return rnd(S.cluster_mean_ci(v.scored, "net", day_no("ts"), ["side"]), 9)


def _boot_sql(unit, reps, seed, m):
    return f"""
b AS (SELECT {unit} AS block, sum(net) AS s, count(*) AS c, sum(greatest(net,0)) AS g, sum(greatest(-net,0)) AS l FROM scored GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY block)-1 AS b, count(*) OVER () AS k FROM b),
d AS (SELECT r.r AS rep, ('0x' || substr(sha256('{seed}|' || r.r || '|' || j.j),1,15))::BIGINT % (SELECT max(k) FROM i) AS b FROM range({reps}) r(r), range((SELECT max(k) FROM i)) j(j)),
m AS (SELECT rep, sum(s)/sum(c) AS m0, avg(s/c) AS m1, sum(g)/sum(l) AS pf FROM d JOIN i USING (b) GROUP BY 1)
SELECT round(quantile_cont({m},0.025),9)+0.0 AS lower, round(quantile_cont({m},0.5),9)+0.0 AS median, round(quantile_cont({m},0.975),9)+0.0 AS upper, round(quantile_disc(pf,0.025),7)+0.0 AS pf_lower, round(quantile_disc(pf,0.975),7)+0.0 AS pf_upper,
 round((sum(({m}<=0)::INT)+1)/(count(*)+1.0),8)::DOUBLE+0.0 AS p_not_positive FROM m"""


def _boot(d):
    return d.select(*[(F.round(c, 9) + 0.0).alias(c) for c in ("lower", "median", "upper")], *[(F.round(c, 7) + 0.0).alias(c) for c in ("pf_lower", "pf_upper")], (F.round("p_not_positive", 8) + 0.0).alias("p_not_positive"))


@query("block_bootstrap", "scored", _boot_sql(f"((ts//{D})+3)//7", 400, "182023", "m0"))
def _(v):
    return _boot(S.block_bootstrap(v.scored, iso_week("ts"), "net", 400, "182023"))


@query("block_bootstrap_daily_means", "scored", _boot_sql(f"ts//{D}", 60, "180101", "m1"))
def _(v):
    return _boot(S.block_bootstrap(v.scored, day_no("ts"), "net", 60, "180101", "means"))


@query("moving_block_bootstrap", "scored", """
x AS (SELECT row_number() OVER (ORDER BY ts, id) AS r, sum(net) OVER w AS s, sum(greatest(net,0)) OVER w AS g, sum(greatest(-net,0)) OVER w AS l FROM scored WINDOW w AS (ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT * FROM x UNION ALL SELECT 0,0,0,0), n AS (SELECT count(*) AS n FROM scored),
d AS (SELECT r.r AS rep, j.j, n, ('0x' || substr(sha256('mb|' || r.r || '|' || j.j),1,15))::BIGINT % (n-50+1) AS a FROM n, range(40) r(r), range((SELECT (n+49)//50 FROM n)) j(j)),
e AS (SELECT *, a+least(50, n-j*50) AS b FROM d),
m AS (SELECT rep, sum(y.s-x.s)/any_value(n) AS m, sum(y.g-x.g)/sum(y.l-x.l) AS pf FROM e JOIN p x ON x.r=e.a JOIN p y ON y.r=e.b GROUP BY 1)
SELECT round(quantile_cont(m,0.025),8)+0.0 AS lower, round(quantile_cont(m,0.975),8)+0.0 AS upper, round(quantile_cont(pf,0.025),7)+0.0 AS pf_lower, round(quantile_cont(pf,0.975),7)+0.0 AS pf_upper FROM m""")
def _(v):
    d = S.moving_block(v.scored, "net", 50, 40, "mb", ["ts", "id"])
    return d.select((F.round("lower", 8) + 0.0).alias("lower"), (F.round("upper", 8) + 0.0).alias("upper"), (F.round("pf_lower", 7) + 0.0).alias("pf_lower"), (F.round("pf_upper", 7) + 0.0).alias("pf_upper"))


@query("synchronised_calendar_bootstrap", "scored", f"""
b AS (SELECT min(ts//{D}) AS lo, max(ts//{D})-min(ts//{D})+1 AS days FROM scored), y AS (SELECT ts//{D}-lo AS d, sum(net) AS s, count(*) AS c FROM scored, b GROUP BY 1),
g AS (SELECT r.r AS rep, j.j AS j, o.o AS o, ('0x' || substr(sha256('cal|' || r.r || '|' || j.j),1,15))::BIGINT % ((SELECT days FROM b)-6) + o.o AS d FROM range(50) r(r), range(53) j(j), range(7) o(o) WHERE j.j*7+o.o<365),
m AS (SELECT rep, coalesce(sum(s)/sum(c),0) AS m FROM g LEFT JOIN y USING (d) GROUP BY 1)
SELECT round(avg(m),9)+0.0 AS mean, round(quantile_cont(m,0.5),9)+0.0 AS median, round(quantile_disc(m,0.05),9)+0.0 AS p5, round(quantile_disc(m,0.95),9)+0.0 AS p95 FROM m""")
def _(v):
    b = v.scored.agg(F.min(F.floor(F.col("ts") / DAY)).alias("lo"), F.max(F.floor(F.col("ts") / DAY)).alias("hi")).first()
    return rnd(S.calendar_bootstrap(v.scored, "net", 50, "cal", b.lo, b.hi - b.lo + 1), 9)


@query("circular_shift_null", "scored", f"""
w AS (SELECT side AS fold, (ts//{D}+3)//7 AS wk, avg(net) AS v, avg(score) AS o FROM scored GROUP BY 1,2), i AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY wk)-1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM w),
s AS (SELECT DISTINCT fold, n, r.r AS rep, CASE WHEN r.r=0 THEN 0 ELSE 1+('0x' || substr(sha256('cs|' || fold || '|' || r.r),1,15))::BIGINT % (n-1) END AS sh FROM i, range(21) r(r)),
a AS (SELECT i.fold, s.rep, (i.i+sh)%i.n AS i, i.v FROM i JOIN s ON i.fold=s.fold)
SELECT rep::INT AS rep, round(corr(a.v,i.o),7)+0.0 AS statistic, count(*) AS weeks FROM a JOIN i ON a.fold=i.fold AND a.i=i.i GROUP BY 1""")
def _(v):
    return rnd(S.circular_shift(v.scored.withColumn("fold", F.col("side")).withColumn("wk", iso_week("ts")), "fold", "wk", "net", "score", 20, "cs"), 7)


@query("random_same_coverage", "scored", """
h AS (SELECT r.r AS rep, id, net, row_number() OVER (PARTITION BY r.r ORDER BY ('0x' || substr(sha256('rc|' || r.r || '|' || id),1,15))::BIGINT, id)-1 AS rk FROM scored, range(10) r(r)),
n AS (SELECT count(*) AS n, sum(net) AS al, sum((net<=0)::INT) AS bad FROM scored)
SELECT rep::INT AS rep, round(avg(net) FILTER (rk<round_even(n*0.3,0)),8)+0.0 AS net, round(sum((rk>=round_even(n*0.3,0) AND net<=0)::INT)/any_value(bad)::DOUBLE,8)+0.0 AS bad_rejected, round(sum(net) FILTER (rk<round_even(n*0.3,0))-any_value(al),6)+0.0 AS guard_value FROM h, n GROUP BY 1""")
def _(v):
    d = S.random_coverage(v.scored, 0.3, 10, "rc")
    return d.select("rep", (F.round("net", 8) + 0.0).alias("net"), (F.round("bad_rejected", 8) + 0.0).alias("bad_rejected"), (F.round("guard_value", 6) + 0.0).alias("guard_value"))


@query("bh_fdr_holm", "scored", """
p AS (SELECT symbol || '|' || side || '|' || regime AS test, abs(avg(net))*20 AS p FROM scored GROUP BY 1), q AS (SELECT test, least(1,round(p,10)) AS p FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS n FROM q)
SELECT test, p, coalesce(r<=(SELECT max(r) FROM r WHERE p<=0.05*r/n),false) AS accepted, round(min(least(1,p*n/r)) OVER (ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),9)+0.0 AS bh_adjusted,
 round(max(least(1,(n-r+1)*p)) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING),9)+0.0 AS holm_adjusted, min((p<=0.05/(n-r+1))::INT) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING)=1 AS rejected FROM r""")
def _(v):
    d = v.scored.groupBy(F.concat_ws("|", "symbol", "side", "regime").alias("test")).agg(F.least(F.lit(1.0), F.round(F.abs(F.avg("net")) * 20, 10)).alias("p"))
    d = S.holm(S.bh(d, "p", "test"), "p", "test")
    return d.select("test", "p", "accepted", (F.round("bh_adjusted", 9) + 0.0).alias("bh_adjusted"), (F.round("holm_adjusted", 9) + 0.0).alias("holm_adjusted"), "rejected")


_RK = "(SELECT *, rank() OVER (PARTITION BY side ORDER BY score)+(count(*) OVER (PARTITION BY side, score)-1)/2.0 AS rx, rank() OVER (PARTITION BY side ORDER BY net)+(count(*) OVER (PARTITION BY side, net)-1)/2.0 AS ry FROM scored)"


@query("correlations", "scored", f"SELECT side, count(*) AS n, round(corr(score,net),8)+0.0 AS pearson, round(corr(rx,ry),8)+0.0 AS spearman FROM {_RK} GROUP BY 1")
def _(v):
    return rnd(S.pearson(v.scored, "score", "net", ["side"]).join(S.spearman(v.scored, "score", "net", ["side"]).select("side", "spearman"), "side"), 8)


@query("mean_timestamp_spearman", "scored", """
r AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY score)+(count(*) OVER (PARTITION BY ts, score)-1)/2.0 AS rx, rank() OVER (PARTITION BY ts ORDER BY net)+(count(*) OVER (PARTITION BY ts, net)-1)/2.0 AS ry FROM scored),
g AS (SELECT ts, count(*) AS n, CASE WHEN var_pop(rx)>0 AND var_pop(ry)>0 THEN corr(rx,ry) END AS c FROM r GROUP BY 1)
SELECT count(*) AS timestamps, round(avg(c),7)+0.0 AS mean_ic, round(avg((c>1e-12)::INT),7)+0.0 AS positive_share FROM g WHERE n>=3 AND c IS NOT NULL""")
def _(v):
    return rnd(S.mean_spearman_by_ts(v.scored, "score", "net"), 7)


@query("rank_auc_ap", "scored", """
v AS (SELECT side, score, sum(label) AS p, count(*) AS c FROM scored GROUP BY 1,2), r AS (SELECT *, sum(p) OVER (PARTITION BY side ORDER BY score DESC) AS tp, sum(c) OVER (PARTITION BY side ORDER BY score DESC) AS al, sum(c-p) OVER (PARTITION BY side ORDER BY score)-(c-p) AS nb FROM v)
SELECT side, sum(c)::BIGINT AS n, sum(p)::BIGINT AS positives, round(sum(p*(nb+(c-p)/2.0))/(sum(p)*(sum(c)-sum(p)))::DOUBLE,8)+0.0 AS auc, round(sum(p*tp/al::DOUBLE)/sum(p),8)+0.0 AS average_precision,
 round(sum(p) FILTER (score>=0.5)/(sum(c) FILTER (score>=0.5))::DOUBLE,8)+0.0 AS precision_at_cut, round(sum(p) FILTER (score>=0.5)/sum(p)::DOUBLE,8)+0.0 AS recall_at_cut FROM r GROUP BY 1""")
def _(v):
    return rnd(S.ranking_metrics(v.scored, "score", "label", ["side"]), 8)


_PM = """b AS (SELECT symbol, least(9,floor(p_clean*10)) AS b, count(*) AS n, sum(p_clean) AS p, sum(label) AS y, sum((p_clean-label)*(p_clean-label)) AS br, sum(-(label*ln(greatest(1e-12,least(1-1e-12,p_clean)))+(1-label)*ln(1-greatest(1e-12,least(1-1e-12,p_clean))))) AS ll FROM scored GROUP BY 1,2)"""


@query("probability_metrics", "scored", _PM + """
SELECT symbol, sum(n)::BIGINT AS n, round(sum(br)/sum(n),8)+0.0 AS brier, round(sum(ll)/sum(n),7)+0.0 AS log_loss, round(sum(abs(p-y))/sum(n),8)+0.0 AS ece, round(sum(y)/sum(n),8)+0.0 AS prevalence FROM b GROUP BY 1""")
def _(v):
    return rnd(S.probability_metrics(v.scored, "p_clean", "label", by=["symbol"]).withColumn("log_loss", F.round("log_loss", 7)), 8)


@query("reliability_table", "scored", """
e AS (SELECT *, 1+least(9,(row_number() OVER (ORDER BY p_clean, id)-1)*10//count(*) OVER ())::INT AS bucket FROM scored), g AS (SELECT bucket, count(*) AS n, avg(p_clean) AS p, avg(label) AS y FROM e GROUP BY 1)
SELECT least(9,floor(p_clean*10))::INT AS bin, count(*) AS n, round(avg(p_clean),8)+0.0 AS mean_prob, round(avg(label),8)+0.0 AS rate, (SELECT round(sum(abs(p-y)*n)/sum(n),8)+0.0 FROM g) AS equal_frequency_ece FROM scored GROUP BY 1""")
def _(v):
    e = S.equal_frequency_ece(v.scored, "p_clean", "label", "id").select(F.col("ece").alias("equal_frequency_ece"))
    return rnd(S.reliability(v.scored, "p_clean", "label").crossJoin(F.broadcast(e)), 8)


@query("pinball_coverage", "scored", """
b AS (SELECT side, quantile_cont(mae,0.9) AS q FROM scored GROUP BY 1), x AS (SELECT s.side, mae, p_danger/40 AS f, q FROM scored s JOIN b USING (side)),
r AS (SELECT mae-p_danger/40 AS e, row_number() OVER (ORDER BY mae-p_danger/40, id)-1 AS k, count(*) OVER () AS n FROM scored)
SELECT side, count(*) AS n, round(avg(CASE WHEN mae>=f THEN 0.9*(mae-f) ELSE 0.1*(f-mae) END),9)+0.0 AS pinball, round(avg(CASE WHEN mae>=q THEN 0.9*(mae-q) ELSE 0.1*(q-mae) END),9)+0.0 AS baseline, round(avg((mae<=f)::INT),9)+0.0 AS coverage,
 (SELECT round(e,9)+0.0 FROM r WHERE k=least(ceil(round((n+1)*0.9,9))-1,n-1)) AS adjustment FROM x GROUP BY 1""")
def _(v):
    d = v.scored.withColumn("f", F.col("p_danger") / 40)
    a = S.conformal(d, "f", "mae", 0.9, "id").select("adjustment")
    return rnd(S.pinball(d, "f", "mae", 0.9, ["side"]).withColumn("pinball", F.col("pinball")).crossJoin(F.broadcast(a)), 9)


@query("class_metrics", "scored", """
x AS (SELECT CASE WHEN score>0.66 THEN 'LONG' WHEN score<0.33 THEN 'SHORT' ELSE 'SKIP' END AS p, CASE WHEN net>0.03 THEN 'LONG' WHEN net<-0.03 THEN 'SHORT' ELSE 'SKIP' END AS t FROM scored),
c AS (SELECT class, sum((p=class AND t=class)::INT)::BIGINT AS tp, sum((p=class AND t<>class)::INT)::BIGINT AS fp, sum((p<>class AND t=class)::INT)::BIGINT AS fn FROM x, (VALUES ('LONG'),('SHORT'),('SKIP')) v(class) GROUP BY 1),
m AS (SELECT *, tp/(tp+fp)::DOUBLE AS pr, tp/(tp+fn)::DOUBLE AS re FROM c), f AS (SELECT *, 2*pr*re/(pr+re) AS f1 FROM m)
SELECT class, tp, fp, fn, round(pr,8)+0.0 AS precision, round(re,8)+0.0 AS recall, round(f1,8)+0.0 AS f1, round(avg(pr) OVER (),8)+0.0 AS macro_precision, round(avg(re) OVER (),8)+0.0 AS macro_recall, round(avg(f1) OVER (),8)+0.0 AS macro_f1 FROM f""")
def _(v):
    d = v.scored.select(F.when(F.col("score") > 0.66, "LONG").when(F.col("score") < 0.33, "SHORT").otherwise("SKIP").alias("p"), F.when(F.col("net") > 0.03, "LONG").when(F.col("net") < -0.03, "SHORT").otherwise("SKIP").alias("t"))
    return rnd(S.class_metrics(d, "p", "t", ["LONG", "SHORT", "SKIP"]), 8)


@query("feature_separation", "scored", """
l AS (UNPIVOT (SELECT label, score, mae, size FROM scored) ON score, mae, size INTO NAME feature VALUE v),
m AS (SELECT feature, median(v) FILTER (label=1) AS g, median(v) FILTER (label=0) AS b, stddev_pop(v) AS sd, (count(*) FILTER (label=1))::DOUBLE AS n1, (count(*) FILTER (label=0))::DOUBLE AS n0 FROM l GROUP BY 1),
r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY v)+(count(*) OVER (PARTITION BY feature, v)-1)/2.0 AS rk FROM l),
a AS (SELECT feature, (sum(rk) FILTER (label=1)-count(*) FILTER (label=1)*(count(*) FILTER (label=1)+1)/2.0)/(count(*) FILTER (label=1)*count(*) FILTER (label=0)) AS auc FROM r GROUP BY 1),
t AS (SELECT feature, sum(c*c*c-c) AS t3 FROM (SELECT feature, v, count(*)::DOUBLE AS c FROM l GROUP BY 1,2) GROUP BY 1),
z AS (SELECT *, greatest(0, (abs(auc*n1*n0-n1*n0/2)-0.5)/sqrt(n1*n0/12*(n1+n0+1-t3/((n1+n0)*(n1+n0-1)))))/sqrt(2.0) AS x FROM m JOIN a USING (feature) JOIN t USING (feature)), y AS (SELECT *, 1/(1+0.3275911*x) AS u FROM z),
q AS (SELECT list_sort(list_distinct(quantile_cont(size, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM scored),
d AS (SELECT greatest(0, len(list_filter(e, lambda k: k<size))-1) AS bin, avg(label) AS y FROM scored, q GROUP BY 1)
SELECT feature, round((g-b)/nullif(sd,0),8)+0.0 AS median_difference, round(2*auc-1,8)+0.0 AS rank_biserial,
 round(least(1, u*(0.254829592+u*(-0.284496736+u*(1.421413741+u*(-1.453152027+u*1.061405429))))*exp(-x*x)),8)+0.0 AS mann_whitney_p, (SELECT round(corr(bin,y),8)+0.0 FROM d) AS size_monotonicity FROM y""")
def _(v):
    m = S.decile_monotonicity(v.scored, "size", "label").select(F.col("monotonicity").alias("size_monotonicity"))
    return rnd(S.feature_separation(v.scored, ["score", "mae", "size"], "label").crossJoin(F.broadcast(m)), 8)


_MI = lambda c: f"""(WITH q AS (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM scored),
 c AS (SELECT greatest(0, len(list_filter(e, lambda k: k<{c}))-1) AS bin, label, count(*)::DOUBLE AS c FROM scored, q GROUP BY 1,2),
 p AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY bin) AS b, sum(c) OVER (PARTITION BY label) AS y FROM c)
 SELECT '{c}' AS feature, round(sum(c/n*ln(c*n/(b*y))),8)+0.0 AS mutual_information FROM p)"""


@query("binned_mutual_information", "scored", f"SELECT * FROM {_MI('score')} UNION ALL SELECT * FROM {_MI('mae')} UNION ALL SELECT * FROM {_MI('size')}")
def _(v):
    return rnd(S.binned_mutual_information(v.scored, ["score", "mae", "size"], "label"), 8)


@query("label_alignment", "scored", """
b AS (SELECT net, side, symbol, regime, score>0.6 AS hi, p_danger<0.3 AS safe FROM scored), l AS (SELECT net, side, symbol, regime, 'hi' AS label, hi::INT AS o FROM b UNION ALL SELECT net, side, symbol, regime, 'safe', safe::INT FROM b)
SELECT label, side, symbol, regime, count(*) AS n, round(avg(o),8)+0.0 AS prevalence, round(avg(net) FILTER (o=1),8)+0.0 AS selected_mean, round(avg(net) FILTER (o=0),8)+0.0 AS other_mean, round(sum((o=1 AND net>0)::INT)/nullif(sum((net>0)::INT),0)::DOUBLE,8)+0.0 AS positive_recall,
 round(avg(net) FILTER (o=1)-avg(net),8)+0.0 AS lift FROM l GROUP BY GROUPING SETS ((label),(label,side),(label,symbol),(label,regime))""")
def _(v):
    d = v.scored.withColumns({"hi": F.col("score") > 0.6, "safe": F.col("p_danger") < 0.3})
    return rnd(S.label_alignment(d, ["hi", "safe"], "net", ["side", "symbol", "regime"]), 8)


@query("policy_guard_metrics", "scored", """
q AS (SELECT quantile_cont(net,0.1) AS a, quantile_cont(mae,0.9) AS b FROM scored), x AS (SELECT s.*, p_danger<0.7 AS ok, net<=a OR mae>=b AS tl FROM scored s, q)
SELECT symbol, count(*) AS n, sum(ok::INT)::BIGINT AS executed, round(sum((NOT ok AND net<=0)::INT)/sum((net<=0)::INT)::DOUBLE,8)+0.0 AS bad_rejected, round(sum((NOT ok AND net>0)::INT)/sum((net>0)::INT)::DOUBLE,8)+0.0 AS good_destroyed, round(sum((NOT ok AND tl)::INT)/sum(tl::INT)::DOUBLE,8)+0.0 AS tail_rejected,
 round(sum(CASE WHEN NOT ok AND net<=0 THEN -net ELSE 0 END),6)+0.0 AS loss_avoided, round(sum(CASE WHEN NOT ok AND net>0 THEN net ELSE 0 END),6)+0.0 AS profit_destroyed, round(sum(CASE WHEN NOT ok THEN -net ELSE 0 END),6)+0.0 AS net_guard_value,
 round(sum(CASE WHEN ok THEN net ELSE 0 END)/count(*),8)+0.0 AS per_signal, round(avg(net) FILTER (ok),8)+0.0 AS per_executed FROM x GROUP BY 1""")
def _(v):
    q = OS.quantiles(v.scored, [], "net", {"a": 0.1}).drop("n").crossJoin(OS.quantiles(v.scored, [], "mae", {"b": 0.9}).drop("n"))
    d = S.guard_metrics(v.scored.crossJoin(F.broadcast(q)), F.col("p_danger") < 0.7, "net", (F.col("net") <= F.col("a")) | (F.col("mae") >= F.col("b")), ["symbol"])
    six = ("loss_avoided", "profit_destroyed", "net_guard_value")
    return rnd(d.withColumns({c: F.round(c, 6) for c in six}), 8)


@query("baseline_slices", "scored", """
c AS (SELECT quantile_cont(mae,0.9) AS c FROM scored WHERE regime='F'), v AS (SELECT s.*, c FROM scored s, c WHERE regime<>'F'),
u AS (SELECT 'UNCONDITIONAL' AS slice, net FROM v UNION ALL SELECT side, net FROM v UNION ALL SELECT 'PERSISTENCE', net FROM v WHERE p_clean>0.5 UNION ALL SELECT 'TOP_VOLATILITY', net FROM v WHERE mae>=c UNION ALL SELECT 'RANDOM_10', net FROM v WHERE ('0x' || substr(sha256('bs|' || id),1,15))::BIGINT%10=0)
SELECT slice, count(*) AS n, round(avg(net),8)+0.0 AS net, round(avg((net>0)::INT),8)+0.0 AS win_rate FROM u GROUP BY 1""")
def _(v):
    return rnd(S.baseline_slices(v.scored.filter("regime = 'F'"), v.scored.filter("regime <> 'F'"), "net", "mae", F.col("p_clean") > 0.5, "bs"), 8)


@query("per_symbol_scoring", "scored", """
a AS (SELECT symbol, p_clean, label FROM scored UNION ALL SELECT 'ALL', p_clean, label FROM scored),
b AS (SELECT symbol, least(9,floor(p_clean*10)) AS b, count(*) AS n, sum(p_clean) AS p, sum(label) AS y, sum((p_clean-label)*(p_clean-label)) AS br, sum(-(label*ln(greatest(1e-12,least(1-1e-12,p_clean)))+(1-label)*ln(1-greatest(1e-12,least(1-1e-12,p_clean))))) AS ll FROM a GROUP BY 1,2),
v AS (SELECT symbol, p_clean, sum(label) AS p, count(*) AS c FROM a GROUP BY 1,2), r AS (SELECT *, sum(p) OVER (PARTITION BY symbol ORDER BY p_clean DESC) AS tp, sum(c) OVER (PARTITION BY symbol ORDER BY p_clean DESC) AS al FROM v), q AS (SELECT symbol, sum(p*tp/al::DOUBLE)/sum(p) AS ap FROM r GROUP BY 1)
SELECT b.symbol, sum(n)::BIGINT AS n, round(sum(br)/sum(n),7)+0.0 AS brier, round(sum(ll)/sum(n),7)+0.0 AS log_loss, round(sum(abs(p-y))/sum(n),7)+0.0 AS ece, round(sum(y)/sum(n),7)+0.0 AS prevalence, round(any_value(ap),7)+0.0 AS average_precision FROM b JOIN q ON q.symbol=b.symbol GROUP BY 1""")
def _(v):
    return rnd(S.symbol_scoring(v.scored, "p_clean", "label"), 7)


@query("mse_per_target", "scored", "SELECT 'mae' AS target, round(avg((p_danger/40-mae)**2),10)+0.0 AS mse FROM scored UNION ALL SELECT 'mfe', round(avg((p_clean/40-mfe)**2),10)+0.0 FROM scored")
def _(v):
    d = v.scored.select("mae", "mfe", (F.col("p_danger") / 40).alias("a"), (F.col("p_clean") / 40).alias("b"))
    return rnd(S.mse_per_target(d, {"mae": ("a", "mae"), "mfe": ("b", "mfe")}), 10)


@query("stage_funnel", "scored", """
x AS (SELECT net, score>0.3 AS a, p_danger<0.8 AS b, mae<0.015 AS c FROM scored), s AS (SELECT 1 AS stage, 'score' AS gate, net, true AS r, a AS k FROM x UNION ALL SELECT 2, 'danger', net, a, b FROM x UNION ALL SELECT 3, 'mae', net, a AND b, c FROM x)
SELECT stage, gate, sum(r::INT)::BIGINT AS reached, sum((r AND k)::INT)::BIGINT AS passed, round(avg(net) FILTER (r AND k)-avg(net) FILTER (r AND NOT k),8)+0.0 AS pass_minus_fail FROM s GROUP BY 1,2""")
def _(v):
    return rnd(S.funnel(v.scored, {"score": F.col("score") > 0.3, "danger": F.col("p_danger") < 0.8, "mae": F.col("mae") < 0.015}, "net"), 8)


@query("stability_by_dimension", "scored", f"""
l AS (SELECT net, 'symbol' AS dimension, symbol AS value FROM scored UNION ALL SELECT net, 'side', side FROM scored UNION ALL SELECT net, 'week', ((ts//{D}+3)//7)::VARCHAR FROM scored), g AS (SELECT dimension, value, count(*) AS n, sum(net) AS s FROM l GROUP BY 1,2)
SELECT dimension, value, n, round(s/n,8)+0.0 AS mean, round((sum(s) OVER w-s)/nullif(sum(n) OVER w-n,0),8)+0.0 AS leave_one_out, round(avg((s>0)::INT) OVER w,8)+0.0 AS positive_share FROM g WINDOW w AS (PARTITION BY dimension)""")
def _(v):
    return rnd(S.stability(v.scored, {"symbol": F.col("symbol"), "side": F.col("side"), "week": iso_week("ts")}, "net"), 8)


@query("concentration", "scored", f"""
g AS (SELECT symbol, sum(greatest(net,0)) AS p FROM scored GROUP BY 1), m AS (SELECT strftime(make_timestamp(ts),'%Y-%m') AS k, sum(greatest(net,0)) AS p FROM scored GROUP BY 1)
SELECT 'symbol' AS dimension, count(*) AS groups, round(max(p)/sum(p),8)+0.0 AS concentration, arg_max(symbol,p) AS top FROM g UNION ALL SELECT 'month', count(*), round(max(p)/sum(p),8)+0.0, arg_max(k,p) FROM m""")
def _(v):
    a = S.concentration(v.scored, "symbol", "net").withColumn("dimension", F.lit("symbol"))
    b = S.concentration(v.scored.withColumn("month", month_key("ts")), "month", "net").withColumn("dimension", F.lit("month"))
    return rnd(a.unionByName(b), 8)


_W = "x AS (SELECT *, 1.0::DOUBLE/count(*) OVER (PARTITION BY id//3) AS w, net+0.0014 AS gross, CASE WHEN id%4=0 THEN 'STOP' WHEN id%4=1 THEN 'TARGET' ELSE 'TIME' END AS er FROM scored)"


def weighted_input(v):
    from ..operators import events as E
    i = F.col("id")
    d = E.opportunity_weights(v.scored.withColumn("opp", F.floor(i / 3)), "opp")
    return d.withColumns({"gross": F.col("net") + 0.0014, "exit_reason": F.when(i % 4 == 0, "STOP").when(i % 4 == 1, "TARGET").otherwise("TIME")})


@query("weighted_economics", "scored", _W + """
SELECT side, count(*) AS rows, round(sum(w),6)+0.0 AS weight, round(sum(w*net)/sum(w),8)+0.0 AS expectancy, round(sum(w*greatest(net,0))/sum(w*greatest(-net,0)),8)+0.0 AS profit_factor, round(sum(w*(net>0)::INT)/sum(w),8)+0.0 AS win_rate,
 round(sum(w*(er='STOP')::INT)/sum(w),8)+0.0 AS stop_rate, round(sum(w*(er='TARGET')::INT)/sum(w),8)+0.0 AS target_rate, round(sum(w*gross)/sum(w),8)+0.0 AS break_even_cost FROM x GROUP BY 1""")
def _(v):
    return rnd(S.weighted_economics(weighted_input(v), "weight", "net", ["side"]).withColumn("weight", F.round("weight", 6)), 8)


@query("canonical_opportunity_means", "scored", "SELECT id//3 AS opp, round(avg(net),8)+0.0 AS net, round(avg(mae),8)+0.0 AS mae, max(symbol) AS symbol FROM scored GROUP BY 1")
def _(v):
    return rnd(S.canonical_means(v.scored.withColumn("opp", F.floor(F.col("id") / 3)), "opp", ["net", "mae"], ["symbol"]), 8)


@query("candidate_metrics", "scored", """
t AS (SELECT id%24 AS candidate, s.s AS scenario, id//5 AS episode, strftime(make_timestamp(ts),'%Y-%m') AS month, symbol, net-s.c AS net FROM scored, (VALUES ('BASE',0.0::DOUBLE),('STRESS',0.002)) s(s,c)),
e AS (SELECT candidate, scenario, episode, avg(net) AS m FROM t GROUP BY 1,2,3), f AS (SELECT candidate, scenario, count(*) AS episodes, avg(m) AS ee FROM e GROUP BY 1,2)
SELECT candidate, scenario, any_value(episodes) AS episodes, count(*) AS trades, round(any_value(ee),8)+0.0 AS episode_expectancy, round(avg(net),8)+0.0 AS trade_expectancy, round(avg(net) FILTER (symbol IN ('1-URGENT','2-HIGH')),8)+0.0 AS majors, round(avg(net) FILTER (symbol NOT IN ('1-URGENT','2-HIGH')),8)+0.0 AS alts,
 count(DISTINCT month) AS months, count(DISTINCT symbol) AS symbols FROM t JOIN f USING (candidate, scenario) GROUP BY 1,2""")
def _(v):
    sc = v.spark.createDataFrame([("BASE", 0.0), ("STRESS", 0.002)], "scenario string, c double")
    i = F.col("id")
    t = v.scored.crossJoin(F.broadcast(sc)).select((i % 24).alias("candidate"), "scenario", F.floor(i / 5).alias("episode"), month_key("ts").alias("month"), "symbol", (F.col("net") - F.col("c")).alias("net"))
    return rnd(S.candidate_metrics(t, ["1-URGENT", "2-HIGH"]), 8)


@query("age_half_life", "scored", """
x AS (SELECT symbol || '|' || side AS k, (id%240)/10.0::DOUBLE AS age, net FROM scored), e AS (SELECT * FROM (VALUES (0,0.0::DOUBLE,2.0::DOUBLE),(1,2,4),(2,4,8),(3,8,16),(4,16,24)) t(b,lo,hi)),
g AS (SELECT k, b, any_value(hi) AS hi, sum(net) AS s, avg(net) AS m FROM x JOIN e ON age>=lo AND age<hi GROUP BY 1,2), h AS (SELECT *, first_value(m) OVER (PARTITION BY k ORDER BY b) AS i, min(b) OVER (PARTITION BY k) AS f, sum(s) OVER (PARTITION BY k ORDER BY b) AS cu FROM g)
SELECT k, round(max(i),9)+0.0 AS initial, min(hi) FILTER (i>0 AND b>f AND m<=i/2) AS half_life, min(hi) FILTER (cu<=0) AS economic_lifetime FROM h GROUP BY 1""")
def _(v):
    d = v.scored.select(F.concat_ws("|", "symbol", "side").alias("k"), ((F.col("id") % 240) / 10.0).alias("age"), "net")
    return rnd(S.half_life(d, "k", "age", "net", [0, 2, 4, 8, 16, 24]), 9)


@query("ttl_sensitivity", "scored", "SELECT symbol, t AS ttl, count(*) AS n, round(avg(net),8)+0.0 AS net FROM scored, (VALUES (2.0::DOUBLE),(6),(24)) v(t) WHERE (id%240)/10.0<t GROUP BY 1,2")
def _(v):
    return rnd(S.ttl_sensitivity(v.scored.withColumn("age", (F.col("id") % 240) / 10.0), "age", "net", [2, 6, 24], ["symbol"]), 8)


@query("gate_assessment", "scored", """
m AS (SELECT count(*) AS n, avg(net) AS e, sum(greatest(net,0))/sum(greatest(-net,0)) AS pf FROM scored)
SELECT n>=1000 AS enough, e>0 AS positive, pf>=1.05 AS profit_factor, n>=1000 AND e>0 AND pf>=1.05 AS passed FROM m""")
def _(v):
    m = S.economic_summary(v.scored, "net")
    return S.gate(m, {"enough": F.col("n") >= 1000, "positive": F.col("expectancy") > 0, "profit_factor": F.col("profit_factor") >= 1.05})


@query("incremental_lift", "scored", """
a AS (SELECT regime AS family, avg(net) AS expectancy, avg((net>0)::INT) AS win_rate FROM scored WHERE score>0.5 GROUP BY 1), b AS (SELECT regime AS family, avg(net) AS expectancy, avg((net>0)::INT) AS win_rate FROM scored GROUP BY 1)
SELECT family, 'expectancy' AS metric, round(a.expectancy-b.expectancy,8)+0.0 AS lift FROM a JOIN b USING (family) UNION ALL SELECT family, 'win_rate', round(a.win_rate-b.win_rate,8)+0.0 FROM a JOIN b USING (family)""")
def _(v):
    m = lambda d: S.economic_summary(d.withColumn("family", F.col("regime")), "net", ["family"]).select("family", "expectancy", "win_rate")
    return rnd(S.lift(m(v.scored.filter("score > 0.5")), m(v.scored), ["family"], ["expectancy", "win_rate"]), 8)


@query("prior_symbol_metrics", "scored", f"""
o AS (SELECT symbol, id//2 AS opp, min(ts) AS ts, avg(label) AS v FROM scored GROUP BY 1,2), d AS (SELECT DISTINCT symbol, ts FROM scored),
g AS (SELECT d.symbol, d.ts, count(o.ts) AS n, avg(v) AS s FROM d LEFT JOIN o ON o.symbol=d.symbol AND o.ts>=d.ts-60*{D}::BIGINT AND o.ts+2*{D}::BIGINT<=d.ts GROUP BY 1,2)
SELECT symbol, ts, n AS samples, CASE WHEN n>=60 THEN round(s,8)+0.0 END AS score, CASE WHEN n>=60 THEN 'ELIGIBLE' ELSE 'INSUFFICIENT_HISTORY' END AS status FROM g""")
def _(v):
    return rnd(S.trailing_metrics(v.scored.withColumn("opp", F.floor(F.col("id") / 2)), 60, 60, "label", 2 * DAY, "opp"), 8)


@query("paired_delta", "scored", f"""
u AS (SELECT ts//{D} AS d, avg(net-(mfe-mae)/2) AS m FROM scored GROUP BY 1)
SELECT count(*) AS units, round(avg(m),9)+0.0 AS mean, round(avg(m)-1.959963984540054*stddev_samp(m)/sqrt(count(*)),9)+0.0 AS lower, round(avg(m)+1.959963984540054*stddev_samp(m)/sqrt(count(*)),9)+0.0 AS upper FROM u""")
def _(v):
    return rnd(S.paired_delta(v.scored.withColumn("control", (F.col("mfe") - F.col("mae")) / 2), "net", "control", day_no("ts")), 9)


@query("guard_observability", "scored", """
x AS (SELECT symbol, side, score, size/1000 AS lat, p_danger>0.75 AS bl FROM scored), l AS (SELECT 'ALL' AS dim, 'ALL' AS value, score, lat, bl FROM x UNION ALL SELECT 'symbol', symbol, score, lat, bl FROM x UNION ALL SELECT 'side', side, score, lat, bl FROM x)
SELECT dim, value, count(*) AS n, sum(bl::INT)::BIGINT AS blocked, round(avg(score),8)+0.0 AS score_mean, round(stddev_pop(score),8)+0.0 AS score_std, round(quantile_cont(score,0.5),8)+0.0 AS p50, round(quantile_cont(score,0.9),8)+0.0 AS p90, round(quantile_cont(score,0.95),8)+0.0 AS p95,
 round(quantile_cont(lat,0.95),6)+0.0 AS latency_p95, round(sum(bl::INT)/count(*)::DOUBLE,8)+0.0 AS block_rate FROM l GROUP BY 1,2""")
def _(v):
    d = v.scored.withColumns({"latency": F.col("size") / 1000, "verdict": F.when(F.col("p_danger") > 0.75, "BLOCK").otherwise("ALLOW")})
    return rnd(S.guard_stats(d, "score", "latency").withColumn("latency_p95", F.round("latency_p95", 6)), 8)


@query("capture_progress", "signals", f"""
SELECT ts//{D} AS day, symbol, side, count(*) AS signals, sum((signal_id%60<>0)::INT)::BIGINT AS captured, sum((signal_id%60=20)::INT)::BIGINT AS eligible, sum((signal_id%60=0)::INT)::BIGINT AS pending FROM signals GROUP BY 1,2,3""")
def _(v):
    q = v.signals.filter("signal_id % 60 <> 0").select("signal_id", (F.col("signal_id") % 60 == 20).alias("eligible"))
    return S.capture_progress(v.signals, q)


@query("entry_quality_assessment", "scored", """
x AS (SELECT *, row_number() OVER (ORDER BY score, id)-1 AS r, count(*) OVER () AS n FROM scored), s AS (SELECT avg((m<0)::INT) AS ns FROM (SELECT symbol, avg(net) AS m FROM scored GROUP BY 1))
SELECT round(corr(score,net),8)+0.0 AS score_return_corr, round(corr(p_danger,mae),8)+0.0 AS forecast_mae_corr, round(avg(net) FILTER (r>=n-n//10)-avg(net) FILTER (r<n//10),8)+0.0 AS top_minus_bottom, round(any_value(ns),8)+0.0 AS negative_symbol_share FROM x, s""")
def _(v):
    return rnd(S.assess_entry_quality(v.scored, "score", "p_danger", "net", "mae", "id"), 8)


@query("residual_centering", "scored", "SELECT id, round(net+0.0005,8)+0.0 AS recentred FROM scored")
def _(v):
    return rnd(S.fold_center(v.scored.withColumn("fold", F.col("id") % 5), "fold", "net").select("id", "recentred"), 8)
