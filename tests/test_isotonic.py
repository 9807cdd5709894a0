"""The isotonic fit against pooled blocks worked out on the driver, with windows far smaller than the data."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tickloom.operators import models as M


def rows(kind, n=900):
    rng = random.Random(kind)
    for i in range(n):
        x = {"noise": rng.random(), "falling": i / n, "rising": i / n, "ties": rng.randrange(12) / 12, "signed": rng.gauss(0, 5), "waves": i / n}[kind]
        p = {"noise": x, "falling": 1 - x, "rising": 1.0 * (x > 0.5), "ties": x * x, "signed": 0.5 + x / 30, "waves": (x * 8) % 1}[kind]
        yield x, int(rng.random() < p)


@pytest.mark.parametrize("kind", ["noise", "falling", "ties", "signed", "waves"])
def test_equals_pooled_blocks_through_many_windows(spark, kind):
    d = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows(kind))], "id int, x double, y int")
    blocks = M.fit_isotonic(d, "x", "y", rows=64)
    b = blocks.orderBy("block").collect()
    assert all(p.value < q.value and p.hi < q.lo == p.next_lo for p, q in zip(b, b[1:])) and sum(r.n for r in b) == 900
    grid = d.select("x").unionByName(spark.range(-20, 60).select((F.col("id") / 20).alias("x"))).unionByName(spark.createDataFrame([(-99.0,), (99.0,)], "x double"))
    want = IsotonicRegression(featuresCol="x", labelCol="_y").fit(d.withColumn("_y", F.col("y").cast("double"))).transform(grid).collect()
    got = M.apply_isotonic(blocks, grid, "x", "p").collect()
    assert len(got) == len(want)
    for g, w in zip(sorted((r.x, r.p) for r in got), sorted((r.x, r.prediction) for r in want)):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-9)


def test_nulls_and_one_value(spark):
    d = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (None, 1), (float("nan"), 1), (0.7, None)], "x double, y int")
    blocks = M.fit_isotonic(d, "x", "y")
    assert [(r.lo, r.hi, r.n, round(r.value, 9), r.next_lo) for r in blocks.collect()] == [(0.5, 0.5, 3.0, round(2 / 3, 9), None)]
    got = [r.p for r in M.apply_isotonic(blocks, d, "x", "p").collect()]
    assert sorted(x is None for x in got) == [False] * 4 + [True] * 2 and all(x == pytest.approx(2 / 3) for x in got if x is not None)
    none = M.fit_isotonic(d.limit(0), "x", "y")
    assert none.count() == 0 and M.apply_isotonic(none, d, "x", "p").filter("p is not null").count() == 0
