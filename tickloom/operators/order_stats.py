"""Exact order statistics that never hold a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import scan


def _rank(kind: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """0-based lower rank, upper rank, and weight of the upper one."""
    zero = F.lit(0.0)
    if kind == "linear":
        pos = (n - 1) * F.lit(p)
        return F.floor(pos), F.ceil(pos), pos - F.floor(pos)
    if kind in ("nearest_rank", "inverted_cdf"):
        r = F.greatest(F.ceil(F.round(n * F.lit(p), 9)) - 1, F.lit(0))
    elif kind == "higher":
        r = F.ceil(F.round((n - 1) * F.lit(p), 9))
    elif kind == "floor_index":
        r = F.floor(F.round((n - 1) * F.lit(p), 9))
    elif kind == "count_floor":
        r = F.least(F.floor(F.round(n * F.lit(p), 9)), n - 1)
    else:
        raise ValueError(kind)
    return r, r, zero


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], kind: str = "linear") -> DataFrame:
    """One row per group with an exact quantile per entry of ``probs``.

    Equal values collapse to counts first (map-side combined); ranks come from a
    two-level running count over value slices; the wanted values are then picked by a
    conditional aggregate.
    """
    by = list(by)
    vc = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    j = scan.prefix_scan(scan.pin(vc), by, ["_v"], {"_cum": ("sum", "_c")}, slice_col=scan.log_slice(F.col("_v").cast("double")), totals={"_n": "_cum"})
    at = lambda r: F.max(F.when((F.col("_cum") - F.col("_c") <= r) & (r < F.col("_cum")), F.col("_v")))
    aggs, outs = [], []
    for name, p in probs.items():
        lo, hi, wt = _rank(kind, p, F.col("_n"))
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(wt).alias(f"_w_{name}")]
        outs.append((F.col(f"_lo_{name}") + F.col(f"_w_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    g = j.groupBy(*by).agg(F.max("_n").alias("n"), *aggs)
    return g.select(*by, "n", *outs)


def feature_quantiles(df: DataFrame, names: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of many columns: one long pass keyed by (group, feature)."""
    long = df.select(*by, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(by), list(names), "feature", "value")
    return quantiles(long, [*by, "feature"], "value", probs)


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1-based average rank per group by counting equal values, no per-group sort in one task."""
    by = list(by)
    vc = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    run = scan.prefix_scan(scan.pin(vc), by, [value], {"_cum": ("sum", "_c")}, slice_col=scan.log_slice(F.col(value).cast("double")))
    r = run.select(*by, value, (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(r, [*by, value])
