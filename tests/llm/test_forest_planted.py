"""Planted groups of near copies, by the parameters of the query, against brute force."""

import numpy as np
import pytest

from tickloom.llm import rp_forest


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("cosine", [0.99, 0.97])
def test_groups_of_near_copies_keep_their_links(spark, cosine):
    rng = np.random.default_rng(7)
    sizes = [2, 10, 100, rp_forest.LEAF + 200, rp_forest.LARGE + 700]
    parts, group = [unit(rng.normal(size=(4000, 64)))], [np.full(4000, -1)]
    for k, n in enumerate(sizes):
        centre = unit(rng.normal(size=(1, 64)))
        # two members have about this cosine
        parts.append(centre + rng.normal(size=(n, 64)) * np.sqrt((1 / cosine - 1) / 64))
        group.append(np.full(n, k))
    x, group = np.concatenate(parts).astype(np.float32).astype(float), np.concatenate(group)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_groups(df).collect()}
    u = unit(x)
    exp = np.concatenate([(u[i:i + 500] @ u.T >= 0.95).sum(1) - 1 for i in range(0, len(u), 500)])
    links = np.array([got[i][0] for i in range(len(x))])
    assert len(got) == len(x) and (links <= exp).all()
    for k, n in enumerate(sizes):
        mine = group == k
        assert exp[mine].sum() > 0 and links[mine].sum() >= 0.99 * exp[mine].sum(), (n, links[mine].sum() / exp[mine].sum())
        assert n < 100 or len({got[i][1] for i in np.flatnonzero(mine)}) == 1
