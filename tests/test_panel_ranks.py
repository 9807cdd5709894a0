"""Mid ranks against counting, and the tasks they take."""

import random

from pyspark.sql import functions as F

from tickloom.operators import panel, scan

COLS = "ts long, id long, opportunity double, danger double, net_mean double, mfe_q50 double, mae_q90 double"


def test_relative_quality_against_counting(frame):
    rng = random.Random(3)
    odd = [None, float("nan"), 0.0, -0.0]
    rows = [(rng.choice([1, 1, 1, 2, None]), i, *[rng.choice([*odd, 0.5, 1.0, rng.random()]) for _ in range(3)], 0.01, rng.random()) for i in range(120)] + [(9, 999, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r.id: r for r in panel.relative_quality(frame(rows, COLS)).collect()}
    assert len(got) == len(rows)
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v + 0.0)
    for k, name, low in ((2, "opportunity_pct", False), (3, "danger_pct", True), (4, "net_pct", False)):
        for r in rows:
            group = [place(x[k]) for x in rows if x[0] == r[0]]
            mine, n = place(r[k]), len(group)
            beaten, ties = sum(x > mine if low else x < mine for x in group), group.count(mine)
            assert abs(got[r[1]][name] - (1.0 if n == 1 else (beaten + (ties - 1) / 2) / (n - 1))) < 1e-12


def test_one_sort_a_rank_and_as_many_tasks_as_rows_ask_for(frame, monkeypatch):
    d = frame([(i % 50, i, float(i % 7), float(i % 5), float(i), 1.0, float(i % 3)) for i in range(500)], COLS)
    plan = panel.relative_quality(d)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Sort [") == 4 and final.count("+- Window [") + final.count("- Window [") >= 4
    assert scan.dealt(d, ["ts"], rows=100).rdd.getNumPartitions() == 5
    tasks = scan.dealt(d, ["ts"], rows=100).groupBy(F.spark_partition_id().alias("p"), "ts").count().groupBy("ts").count()
    assert tasks.filter("count > 1").count() == 0
