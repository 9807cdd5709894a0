"""Temporal splits: folds, embargoes and purges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import DAY, HOUR, day_no, div
from . import scan
from .quality import fail_if


def _times(df: DataFrame) -> DataFrame:
    """Distinct times with 0-based position ``_k`` and their number ``_n``."""
    t = scan.row_index(df.select("ts").distinct(), [], ["ts"], "_k", HOUR, most=scan.MOST)
    return t.crossJoin(F.broadcast(df.agg(F.count_distinct("ts").alias("_n"))))


def walk_forward_bounds(df: DataFrame, k: int) -> DataFrame:
    """One row per fold: train_end and validation_end from positions among the distinct times."""
    frac = [0.50 + f * (0.30 / max(1, k - 1)) for f in range(k)]
    t = _times(df)
    pos = lambda p, tail: F.least(F.col("_n") - tail, F.floor(F.col("_n") * F.lit(p)))
    aggs = []
    for f, p in enumerate(frac):
        aggs += [F.max(F.when(F.col("_k") == pos(p, 2), F.col("ts"))).alias(f"a{f}"), F.max(F.when(F.col("_k") == pos(min(0.90, p + 0.10), 1), F.col("ts"))).alias(f"b{f}")]
    rows = F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"a{f}").alias("train_end"), F.col(f"b{f}").alias("validation_end")) for f in range(k)])
    return t.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def walk_forward(df: DataFrame, k: int, embargo: int) -> DataFrame:
    """Expanding folds: rows repeat per fold with ``part`` TRAIN or VALIDATION; the fold table has k rows."""
    d = df.crossJoin(F.broadcast(walk_forward_bounds(df, k)))
    part = F.when(F.col("ts") <= F.col("train_end") - embargo, "TRAIN").when((F.col("ts") > F.col("train_end")) & (F.col("ts") <= F.col("validation_end")), "VALIDATION")
    return d.withColumn("part", part).filter("part is not null").drop("train_end", "validation_end")


def explicit_folds(df: DataFrame, windows: Sequence[tuple[int, int, int, int, int, int, int]], embargo: int) -> DataFrame:
    """Frozen (id, train, calibration, scoring) windows, inclusive; chronology and embargo are checked first."""
    last = None
    for i, (fid, a, b, c, d, e, f) in enumerate(windows, 1):
        if fid != i or not (a < b and b + embargo <= c < d and d + embargo == e < f) or (last is not None and b <= last):
            raise ValueError(f"fold {fid}: chronology or embargo is invalid")
        last = b
    ws = df.sparkSession.createDataFrame([tuple(w) for w in windows], "fold int, a long, b long, c long, d long, e long, f long")
    x = df.crossJoin(F.broadcast(ws))
    t = F.col("ts")
    part = F.when(t.between(F.col("a"), F.col("b")), "TRAIN").when(t.between(F.col("c"), F.col("d")), "CALIBRATION").when(t.between(F.col("e"), F.col("f")), "SCORING")
    return x.withColumn("part", part).filter("part is not null").drop("a", "b", "c", "d", "e", "f")


def chronological(df: DataFrame, train: float, validation: float, embargo: int, purge: int = 0) -> DataFrame:
    """TRAIN / VALIDATION / TEST by fractions of the distinct times; rows within ``purge`` of a part's end drop."""
    t = _times(df)
    at = lambda p: F.max(F.when(F.col("_k") == F.floor(F.col("_n") * F.lit(p)), F.col("ts")))
    b = t.agg(at(train).alias("_tb"), at(train + validation).alias("_vb"))
    d = df.crossJoin(F.broadcast(b))
    ts = F.col("ts")
    part = F.when(ts <= F.col("_tb") - embargo, "TRAIN").when((ts > F.col("_tb")) & (ts <= F.col("_vb") - embargo), "VALIDATION").when(ts > F.col("_vb"), "TEST")
    end = F.when(F.col("part") == "TRAIN", F.col("_tb") - embargo).when(F.col("part") == "VALIDATION", F.col("_vb") - embargo)
    d = d.withColumn("part", part).filter("part is not null")
    return d.filter(end.isNull() | (ts < end - purge + 1)).drop("_tb", "_vb") if purge else d.drop("_tb", "_vb")


def daily_walk_forward(trades: DataFrame, train_days: int, min_trades: int, per_day: tuple[float, float], top: int, cost: float) -> DataFrame:
    """Per test day: the variant with the best trailing net per day that meets the limits, its best trades that day.

    Daily totals per variant are computed once and each is handed to the test days
    whose window holds it, so trades themselves are never multiplied.
    """
    d = trades.withColumn("day", day_no("ts"))
    per = d.groupBy("variant", "day").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("gross") - cost).alias("_s"))
    g = per.select("variant", F.explode(F.sequence(F.col("day") + 1, F.col("day") + train_days)).alias("day"), "_n", "_s").groupBy("variant", "day").agg(
        F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    rate = F.col("_tn") / train_days
    ok = (F.col("_tn") >= min_trades) & rate.between(*per_day) & (F.col("_ts") > 0)
    best = g.filter(ok).groupBy("day").agg(F.max_by("variant", F.struct(F.round(F.col("_ts") / train_days, 12), "variant")).alias("variant"))
    hit = d.join(best, ["day", "variant"])
    wr = Window.partitionBy("day").orderBy(F.col("strength").desc(), "id")
    return hit.withColumn("_rn", F.row_number().over(wr)).filter(F.col("_rn") <= top).drop("_rn").withColumn("net", F.col("gross") - cost)


def heldout_ranks(scored: DataFrame, session: str = "session", tolerances: Sequence[int] = (1, 3, 6), unit: int = 60_000_000, per_session: int = 5) -> DataFrame:
    """For each held-out positive: rank and percentile in its session, capture by emitted signals, timing error.

    ``scored(session, id, ts, side, score, positive, train_negative)``; the threshold is the
    (5 * sessions)-th best training negative.
    """
    from . import joins

    n_s = scored.agg(F.count_distinct(session).alias("_s"), F.sum(F.col("train_negative").cast("long")).alias("_m"))
    neg = scan.global_index(scored.filter("train_negative").select("score", "id"), [], F.col("score"), "id", "_r", descending=True)
    cut = neg.crossJoin(F.broadcast(n_s)).filter(F.col("_r") == F.least(F.col("_m") - 1, per_session * F.col("_s") - 1)).select(F.col("score").alias("threshold"))
    d = scan.global_index(scored, [session], F.col("score"), "id", "_rank", True, "candidates")
    pos = d.filter("positive").crossJoin(F.broadcast(cut)).select(session, "id", "ts", "side", "score", (F.col("_rank") + 1).alias("rank"), "candidates", (1 - div("_rank", F.greatest(F.lit(1), F.col("candidates") - 1))).alias("percentile"), "threshold")
    emitted = scored.crossJoin(F.broadcast(cut)).filter(F.col("score") >= F.col("threshold")).select(session, "side", "ts", F.col("ts").alias("hit"))
    p = joins.asof_join(pos, emitted, by=[session, "side"], columns=["hit"]).withColumnRenamed("hit", "_b")
    p = joins.asof_join(p, emitted, by=[session, "side"], columns=["hit"], direction="forward").withColumnRenamed("hit", "_f")
    err = F.least(F.col("ts") - F.col("_b"), F.col("_f") - F.col("ts")) / unit
    return p.withColumns({"nearest_error": err, **{f"capture_{t}": F.coalesce(err <= t, F.lit(False)) for t in tolerances}}).drop("_b", "_f")


def assign_contracts(rows: DataFrame, min_group: int, min_contract: int) -> DataFrame:
    """Best contract per regime by mean utility (ties by the larger name), the global best where a regime is too small."""
    g = rows.groupBy("regime", "contract").agg(F.count(F.lit(1)).alias("_n"), F.sum("utility").alias("_s"), F.count_distinct("id").alias("_rows"))
    size = rows.groupBy("regime").agg(F.count_distinct("id").alias("_size"))
    pick = lambda df, by: df.filter(F.col("_n") >= min_contract).withColumn("_m", F.round(F.col("_s") / F.col("_n"), 12)).groupBy(*by).agg(F.max(F.struct("_m", "contract", "_n")).alias("b"))
    glob = pick(g.groupBy("contract").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")), []).select(F.col("b").alias("g"))
    loc = size.join(pick(g, ["regime"]), "regime", "left").crossJoin(F.broadcast(glob))
    use = (F.col("_size") >= min_group) & F.col("b").isNotNull()
    b = F.when(use, F.col("b")).otherwise(F.col("g"))
    return loc.select("regime", F.when(use, "REGIME").otherwise("GLOBAL").alias("source"), b["contract"].alias("contract"), b["_m"].alias("mean_utility"), b["_n"].alias("n"))


def rank_candidates(folds: DataFrame, key: str = "candidate", score: str = "score", cost: str = "cost") -> DataFrame:
    """Worst fold first, then mean, low spread, low cost and name (a table of candidates)."""
    g = folds.groupBy(key).agg(F.min(score).alias("worst_fold"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(cost).alias("cost"))
    r = lambda c: F.round(c, 12)
    w = Window.partitionBy(F.lit(0)).orderBy(r("worst_fold").desc(), r("mean").desc(), r("std"), "cost", key)
    return g.withColumn("rank", F.row_number().over(w))
