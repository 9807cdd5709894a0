"""Model fitting and scoring as Spark jobs (pyspark.ml) and frozen-model scoring as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip, div, logistic
from . import order_stats, scan


def _medians(df: DataFrame, names: Sequence[str]):
    """Imputer model of the exact medians, which are taken in one distributed pass; one row comes to the driver."""
    q = order_stats.feature_quantiles(df, names, {"m": 0.5}).select("feature", "m").collect()
    med = {r.feature: float(r.m) for r in q}
    row = df.sparkSession.createDataFrame([[med.get(n, 0.0) for n in names]], [str(n) for n in names])
    return Imputer(strategy="mean", inputCols=list(names), outputCols=[f"_i_{n}" for n in names]).fit(row)


def balanced(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """Class weights rows / (classes * rows of the class), so every class weighs alike; classes are few."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    w = F.create_map(*[x for c, k in n.items() for x in (F.lit(c), F.lit(sum(n.values()) / (len(n) * k)))])
    return df.withColumn(out, w[F.col(label)])


def fit_linear(df: DataFrame, names: Sequence[str], label: str, kind: str = "logistic", reg: float = 0.0, weight: str | None = None) -> PipelineModel:
    """Median impute, standardise, then logistic, ridge or plain linear; ``weight`` is a column or "balanced"."""
    df, kw = _weighted(df, label, weight)
    est = (LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=200, tol=1e-9, standardization=False, **kw) if kind == "logistic"
           else LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0, solver="normal", standardization=False, **kw))
    imp = _medians(df, names)
    rest = Pipeline(stages=[VectorAssembler(inputCols=[f"_i_{n}" for n in names], outputCol="_v"), StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="features"), est])
    return PipelineModel([imp, *rest.fit(imp.transform(df)).stages])


def _weighted(df: DataFrame, label: str, weight: str | None) -> tuple[DataFrame, dict]:
    if weight == "balanced":
        return balanced(df, label), {"weightCol": "_weight"}
    return df, {"weightCol": weight} if weight else {}


def exported(model: PipelineModel, names: Sequence[str]) -> dict:
    """Plain parameters of a fitted linear pipeline: medians, means, scales, coefficients, intercept."""
    imp, _, sc, lin = model.stages
    med = imp.surrogateDF.first().asDict()
    return {"names": list(names), "median": [float(med[n]) for n in names], "mean": [float(x) for x in sc.mean], "scale": [float(x) or 1.0 for x in sc.std],
            "coef": [float(x) for x in lin.coefficients], "intercept": float(lin.intercept), "kind": "logistic" if hasattr(lin, "interceptVector") else "linear"}


def score_linear(p: dict) -> Column:
    """Frozen linear model as a column expression, no model objects on the executors."""
    e = F.lit(p["intercept"])
    for n, m, mu, s, c in zip(p["names"], p["median"], p["mean"], p["scale"], p["coef"]):
        e = e + c * (F.coalesce(F.col(n), F.lit(m)) - mu) / s
    return logistic(e) if p["kind"] == "logistic" else e


def score_tree(tree: dict) -> Column:
    """Frozen tree {feature, threshold, left, right} or {value} as nested conditions (x <= threshold goes left)."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    return F.when(F.col(tree["feature"]) <= tree["threshold"], score_tree(tree["left"])).otherwise(score_tree(tree["right"]))


def score_ensemble(trees: Sequence[dict], base: float, rate: float) -> Column:
    e = F.lit(float(base))
    for t in trees:
        e = e + rate * score_tree(t)
    return e


def fit_trees(df: DataFrame, names: Sequence[str], label: str, kind: str = "gbt", task: str = "classification", trees: int = 10, depth: int = 3, seed: int = 7, weight: str | None = None) -> PipelineModel:
    df, kw = _weighted(df, label, weight)
    cls = {("gbt", "classification"): GBTClassifier, ("gbt", "regression"): GBTRegressor, ("forest", "classification"): RandomForestClassifier, ("forest", "regression"): RandomForestRegressor}[kind, task]
    n = {"maxIter": trees} if kind == "gbt" else {"numTrees": trees, "bootstrap": trees > 1}
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep"), cls(featuresCol="features", labelCol=label, maxDepth=depth, seed=seed, **n, **kw)]).fit(df)


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    d = model.transform(df)
    val = vector_to_array("probability")[1] if "probability" in d.columns else F.col("prediction")
    return d.select(*df.columns, val.alias(out))


def fit_ranker(pairs: DataFrame, diffs: Sequence[str], label: str = "prefer_first", reg: float = 0.01) -> dict:
    """Logistic on pair differences without intercept; returns weights per feature."""
    d = VectorAssembler(inputCols=list(diffs), outputCol="features").transform(pairs)
    m = LogisticRegression(featuresCol="features", labelCol=label, fitIntercept=False, regParam=reg, maxIter=100).fit(d)
    return dict(zip(diffs, [float(x) for x in m.coefficients]))


def fit_panel_ranker(panel: DataFrame, value: str, features: Sequence[str], reg: float = 0.01, group: str = "ts", steps: int = 50) -> dict:
    """Logistic on the differences of all pairs of a timestamp with unequal ``value``, without a table of pairs.

    A timestamp's rows (bounded by the symbol universe) are one record; tasks go through its pairs in numpy blocks and return
    sums of loss, gradient and curvature, so a Newton step is one scan and its result is one row.  The loss does not depend on
    which of a pair comes first.  ``reg`` weighs the squared coefficients of differences scaled to a mean square of one.
    Rows with a NULL, NaN or infinite number or no timestamp are left out; without any pair all weights are 0.
    """
    import numpy as np
    import pandas as pd

    names, k = list(features), len(features)
    d = panel.select(group, F.col(value).cast("double").alias("_v"), F.array(*[F.col(f).cast("double") for f in names]).alias("_x"))
    sound = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    d = d.filter(F.col(group).isNotNull() & sound(F.col("_v")) & F.forall("_x", sound)).groupBy(group).agg(F.collect_list(F.struct("_v", "_x")).alias("_rows")).filter(F.size("_rows") > 1)
    d = scan.settled(d.select(F.transform("_rows", lambda r: r["_v"]).alias("v"), F.flatten(F.transform("_rows", lambda r: r["_x"])).alias("x")))
    out = ["n", "loss", *[f"g{i}" for i in range(k)], *[f"h{i}" for i in range(k * k)]]

    def sums(w: np.ndarray, scale: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def walk(frames):
            total = np.zeros(len(out))
            for frame in frames:
                for v, x in zip(frame["v"], frame["x"]):
                    v, x = np.asarray(v), np.asarray(x).reshape(-1, k) / scale
                    for a in range(0, len(v), 256):
                        for b in range(0, len(v), 256):
                            i, j = np.nonzero(v[a:a + 256, None] > v[None, b:b + 256])
                            e = x[a + i] - x[b + j]
                            z = e @ w
                            q = np.exp(-np.logaddexp(0.0, z))         # probability of the wrong order
                            total += np.concatenate([[len(z), np.logaddexp(0.0, -z).sum()], -(q @ e), ((e * (q * (1 - q))[:, None]).T @ e).ravel()])
            yield pd.DataFrame([total], columns=out)

        r = d.mapInPandas(walk, ", ".join(f"{c} double" for c in out)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in out]).first()
        return r[0], r[1], np.array(r[2:2 + k]), np.array(r[2 + k:]).reshape(k, k)

    n, _, _, h = sums(np.zeros(k), np.ones(k))
    if not n:
        return dict.fromkeys(names, 0.0)
    scale = np.sqrt(4 * np.diag(h) / n)                               # at zero weights a pair's curvature is a quarter of its squares
    scale[scale == 0] = 1.0

    def at(w):
        _, loss, g, h = sums(w, scale)
        return loss / n + reg / 2 * (w @ w), g / n + reg * w, h / n + reg * np.eye(k)

    w = np.zeros(k)
    loss, g, h = at(w)
    for _ in range(steps):
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        nxt = at(w - step)
        while nxt[0] > loss and np.abs(step).max() > 1e-12:
            step = step / 2
            nxt = at(w - step)
        if nxt[0] > loss:
            break
        w, (loss, g, h) = w - step, nxt
        if np.abs(g).max() < 1e-10:
            break
    return dict(zip(names, (w / scale).tolist()))


def pair_accuracy(pairs: DataFrame, weights: dict[str, float], label: str = "prefer_first") -> DataFrame:
    e = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(((e > 0).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def fit_platt(df: DataFrame, prob: str, label: str) -> tuple[float, float]:
    """Slope and intercept on the logit; a slope that would erase or invert the ranking is refused."""
    d = VectorAssembler(inputCols=["_x"], outputCol="features").transform(df.select(logit(F.col(prob)).alias("_x"), F.col(label).cast("double").alias("_y")))
    m = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=200, tol=1e-10, standardization=False).fit(d)
    a, b = float(m.coefficients[0]), float(m.intercept)
    if a <= 1e-8:
        raise ValueError("calibration would erase or invert the ranking")
    return a, b


def apply_platt(prob: str, fit: tuple[float, float]) -> Column:
    return logistic(fit[0] * logit(F.col(prob)) + fit[1])


def _lower_hull(pdf):
    """The corners of the lower convex hull of points (_N, _S) in ascending _N; both ends stay."""
    p = pdf.sort_values("_N", ignore_index=True)
    ns, ss, keep = p["_N"].tolist(), p["_S"].tolist(), []
    for i, (n, s) in enumerate(zip(ns, ss)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (ss[b] - ss[a]) * (n - ns[b]) < (s - ss[b]) * (ns[b] - ns[a]):
                break
            keep.pop()
        keep.append(i)
    return p.iloc[keep]


def fit_isotonic(df: DataFrame, prob: str, label: str, rows: int = 65_536) -> DataFrame:
    """Least-squares non-decreasing fit as blocks (block, lo, hi, n, value, next_lo, next_value), lowest first.

    Rows become counts per distinct probability, whose running sums are points; the fit's values are the slopes of their lower
    convex hull.  Windows of at most ``rows`` points keep their own hull's corners, rounds with windows shifted by half go on
    with what is left, and when neither placement drops a point every corner is convex, so the hull is whole.  Nothing but
    counts reaches the driver.  Rows with a NULL or NaN probability or a NULL label are left out.
    """
    x = F.col(prob).cast("double")
    d = df.filter(x.isNotNull() & ~F.isnan(x) & F.col(label).isNotNull()).groupBy(x.alias("_x")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(label).cast("double")).alias("_s"))
    d = scan.settled(d)
    # a point stands before its probability; the last one stands after all
    p = scan.prefix_scan(d, [], ["_x"], {"_N": ("sum", "_n"), "_S": ("sum", "_s"), "_prev": ("last", "_x")}, slice_col=scan.log_slice(F.col("_x")), exclusive=True, most=scan.MOST)
    p = p.select("_x", "_prev", F.coalesce("_N", F.lit(0.0)).alias("_N"), F.coalesce("_S", F.lit(0.0)).alias("_S"))
    p = p.unionByName(d.agg(F.lit(None).cast("double").alias("_x"), F.max("_x").alias("_prev"), F.sum("_n").alias("_N"), F.sum("_s").alias("_S")).filter("_N is not null"))

    def placed(t: DataFrame) -> DataFrame:
        return scan.settled(scan.row_index(t.select("_x", "_prev", "_N", "_S"), [], ["_N"], "_i", slice_col=scan.log_slice(F.col("_N")), most=scan.MOST))

    p, quiet, shift = placed(p), 0, 0
    left = p.count()
    while quiet < 2:
        small = left <= rows
        g = F.lit(0).cast("long") if small else F.floor((F.col("_i") + shift) / rows)
        q = scan.settled(p.withColumn("_g", g).groupBy("_g").applyInPandas(_lower_hull, "_x double, _prev double, _N double, _S double, _i long, _g long"))
        n = q.count()
        quiet = 2 if small else quiet + 1 if n == left else 0
        shift = rows // 2 - shift
        p, left = (p, n) if n == left else (placed(q), n)
    at = lambda k, **cols: p.select((F.col("_i") - k).alias("block"), *[F.col(c).alias(o) for o, c in cols.items()])
    b = at(0, lo="_x", _N0="_N", _S0="_S").join(at(1, hi="_prev", _N1="_N", _S1="_S"), "block")
    b = scan.settled(b.select("block", "lo", "hi", (F.col("_N1") - F.col("_N0")).alias("n"), ((F.col("_S1") - F.col("_S0")) / (F.col("_N1") - F.col("_N0"))).alias("value")))
    return b.join(b.select((F.col("block") - 1).alias("block"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value")), "block", "left")


def apply_isotonic(blocks: DataFrame, df: DataFrame, prob: str, out: str) -> DataFrame:
    """df with the fitted value: a block's inside it, straight lines between blocks, the nearest block's outside; NULL for NULL or NaN.

    Each row finds its block by a running last over blocks and rows in order, in row-bounded slices.
    """
    x = F.col(prob).cast("double")
    x = F.when(~F.isnan(x), x)
    names = df.columns
    rows = df.select(x.alias("_x"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    fit = blocks.select(F.col("lo").alias("_x"), F.lit(0).alias("_kind"), F.struct("lo", "hi", "value", "next_lo", "next_value").alias("_block"))
    d = rows.unionByName(fit, allowMissingColumns=True)
    d = scan.prefix_scan(d, [], ["_x", "_kind"], {"_at": ("last", "_block")}, slice_col=scan.log_slice(F.col("_x")), most=scan.MOST).filter("_kind = 1")
    first = blocks.filter("block = 0").select(F.col("value").alias("_first"))
    a = lambda c: F.col("_at")[c]
    between = a("value") + (a("next_value") - a("value")) * (F.col("_x") - a("hi")) / (a("next_lo") - a("hi"))
    v = F.when(F.col("_x").isNull(), None).when(F.col("_at").isNull(), F.col("_first")).when((F.col("_x") <= a("hi")) | a("next_lo").isNull(), a("value")).otherwise(between)
    return d.join(F.broadcast(first), how="left").select(*[F.col("_row")[c].alias(c) for c in names], v.alias(out))


def shrunk_rates(df: DataFrame, key: str, label: str, k: float) -> DataFrame:
    """Group rate pulled to the global one: local weight n / (n + k)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("local"))
    a = df.agg(F.avg(label).alias("global"))
    w = F.col("n") / (F.col("n") + k)
    return g.crossJoin(F.broadcast(a)).withColumns({"local_weight": w, "shrunk": F.col("global") * (1 - w) + F.col("local") * w})


def hierarchical(global_p: Column, local_p: Column, n: Column, k: float) -> Column:
    w = F.coalesce(n, F.lit(0)) / (F.coalesce(n, F.lit(0)) + k)
    return global_p * (1 - w) + F.coalesce(local_p, global_p) * w


def select_calibrator(df: DataFrame, candidates: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Candidates ordered by held-out ECE, then Brier (one melted scan)."""
    from .stats import probability_metrics

    d = df.select(F.col(label).alias("_y"), *candidates).unpivot(["_y"], list(candidates), "method", "p")
    return probability_metrics(d, "p", "_y", bins, ["method"]).select("method", "ece", "brier").orderBy("ece", "brier", "method")
