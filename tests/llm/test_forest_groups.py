"""Leaves compared in blocks, and classes of equal directions."""

import numpy as np

from tickloom.llm import rp_forest


def test_blocks_of_a_leaf_give_what_the_whole_leaf_gives(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1, 16)) + rng.normal(scale=0.15, size=(300, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, rp_forest.near_groups(df).collect()))
    assert sum(r[1] for r in whole) > 1000
    assert sorted(map(tuple, rp_forest.near_groups(df, spill=9.0, leaf=40, large=40).collect())) == whole


def test_multiples_of_a_vector_are_one_class(spark):
    rows = [(i, [float(c * v) for v in (3, -5, 7, 11)]) for i, c in enumerate((1, 3, 7, 1e200))]
    keys = {bytes(r.key) for r in rp_forest.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 4).limit(3).collect()}
    assert len(keys) == 1
