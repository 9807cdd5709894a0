"""Bar sources whose prices go down to 0."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.functions.scalars import HOUR
from tickloom.plans import q_sources
from tickloom.sources import readers

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(frame, path, values):
    at = dt.datetime(2024, 1, 10)
    rows = [(i, at + dt.timedelta(hours=i // 2, minutes=i), i, "view", v, "{}") for i, v in enumerate(values)]
    frame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["bar_source_csv", "bar_source_zip_archive"])
def test_a_price_of_zero_is_a_bar(spark, frame, tmp_path, name):
    d = entry.queries()[name](spark, events(frame, tmp_path, [3.0, 0.0, 0.0, 0.0, 5.0, 4.0]))
    assert sorted((r.open, r.high, r.low, r.close) for r in d.collect()) == [(0.0, 0.0, 0.0, 0.0), (3.0, 3.0, 0.0, 0.0), (5.0, 5.0, 4.0, 4.0)]


@pytest.mark.parametrize("low,zero,good", [(0.0, True, True), (0.0, False, False), (-0.01, True, False)])
def test_zero_is_allowed_only_where_a_source_says_so(frame, low, zero, good):
    d = readers.validate_bars(frame([("A", 0, 1.0, 1.0, low, 1.0, 1.0)], "symbol string, ts long, open double, high double, low double, close double, volume double"), 0, HOUR, HOUR, zero=zero)
    if good:
        assert d.count() == 1
    else:
        with pytest.raises(Exception, match="invalid bar"):
            d.agg(F.sum("close")).collect()


BAR = "symbol string, ts long, open double, high double, low double, close double, volume double"


def rows_at(*at):
    return [("A", h * HOUR, 2.0, 3.0, 1.0, 2.0, 5.0) for h in at]


@pytest.mark.parametrize("at,good", [((0, 1, 4, 5), True), ((1, 4, 5), False), ((0, 1, 5), False), ((0, 1, 4), False), ((0, 1, 2, 4, 5), False), ((0, 1, 1, 4, 5), False), ((0, 1, 4, 5, 9), True)])
def test_a_step_is_longer_only_where_nothing_was_traded(spark, frame, tmp_path, at, good):
    frame(rows_at(*at), BAR).write.csv(f"{tmp_path}/bars", header=True)
    traded = frame([("A", h * HOUR) for h in (0, 0, 1, 4, 5, 8)], "symbol string, ts long")
    d = readers.load_bars_csv(spark, f"{tmp_path}/bars", 0, 8 * HOUR, HOUR, traded=traded)
    if good:
        assert sorted(r.ts // HOUR for r in d.collect()) == [0, 1, 4, 5]
    else:
        with pytest.raises(Exception, match="bar step differs"):
            d.agg(F.sum("close")).collect()


def test_the_query_checks_the_steps_of_its_bars(spark, frame, tmp_path, monkeypatch):
    path, written = events(frame, tmp_path, [3.0, 1.0, 2.0, 2.0, 5.0, 4.0]), q_sources.written
    monkeypatch.setattr(q_sources, "written", lambda df, v, **k: written(df.filter(F.col("open") != 2.0), v, **k))
    with pytest.raises(Exception, match="bar step differs"):
        entry.queries()["bar_source_csv"](spark, path).collect()


def test_columns_of_a_csv_go_by_their_names(spark, frame, tmp_path):
    d = frame(rows_at(0, 1), BAR).withColumn("note", F.lit("x"))
    d.select("note", "volume", "close", "low", "high", "open", "ts", "symbol").write.csv(f"{tmp_path}/turned", header=True)
    assert [tuple(r) for r in readers.load_bars_csv(spark, f"{tmp_path}/turned", 0, 2 * HOUR, HOUR).orderBy("ts").collect()] == rows_at(0, 1)
    d.drop("volume").write.csv(f"{tmp_path}/less", header=True)
    with pytest.raises(ValueError, match="missing columns"):
        readers.load_bars_csv(spark, f"{tmp_path}/less", 0, 2 * HOUR, HOUR)
    with pytest.raises(ValueError, match="interval"):
        readers.load_bars_csv(spark, f"{tmp_path}/turned", HOUR, HOUR, HOUR)
