"""Registry shape, and a sample of queries against DuckDB on the smallest tables (check_queries.py runs them all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canon, frame as pframe

SF = "/root/testdata/sf0.001"
SAMPLE = ["ticks_to_bars", "rolling_stats", "ema_wilder", "asof_strict_by_symbol", "range_join_window", "triple_barrier", "score_deciles", "cooldown_thinning", "max_drawdown", "block_bootstrap",
          "walk_forward_expanding", "hash_ordered_sample", "bar_source_csv", "journal_tail_source"]


def test_every_oracle_has_a_query():
    from tickloom.plans import load_all

    assert set(entry.oracle_sql()) <= set(entry.queries())
    q, o = load_all()
    assert set(o) <= set(q) and len(q) > 230
    assert set(q) - set(o) == {"calibration", "level_clusters", "pairwise_ranker"}


def test_entry(spark):
    assert "expectancy" in entry.entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got, cur = pframe(df.columns, [tuple(r) for r in df.collect()]), con.sql(entry.oracle_sql()[name])
    exp = pframe(cur.columns, cur.fetchall())
    assert sorted(got.columns) == sorted(exp.columns) and canon(got) == canon(exp)


@pytest.mark.parametrize("name,scans", [("book_episode_features", 5), ("tiered_hard_negatives", 5)])
def test_plans_start_from_settled_sets(spark, name, scans):
    """Long operators read what they derived once; their last plan is short."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans
