"""A slow EMA keeps the weight of a key's first rows however many groups of blocks follow."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import scan


def test_first_rows_keep_their_weight(spark, monkeypatch):
    monkeypatch.setattr(scan, "SUPER", 2)  # many groups from few rows
    n, alpha = 3000, 1e-4
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("ts"), F.when(F.col("id") == 0, 1e6).otherwise(F.col("id") % 7).cast("double").alias("x"))
    got = [r.y for r in scan.recurrences(df, ["k"], ["ts"], emas={"y": ("x", alpha)}, block=1).orderBy("ts").collect()]
    y, exp = 1e6, [1e6]
    for i in range(1, n):
        y += alpha * (i % 7 - y)
        exp.append(y)
    assert np.allclose(got, exp, rtol=1e-9)
