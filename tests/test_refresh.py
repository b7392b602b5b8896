"""Refresh modes, conflicts, retention, fallback and casts."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import refresh, sampling
from lakeloom.operators.changes import apply_changes
from lakeloom.sources.scratch import new_dir
from lakeloom.sources.store import Store


def times(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], "t string").select(F.col("t").cast(kind).alias("t"))


OLD = ["2020-01-01T00:00:00", "2020-01-02T00:00:00", "2020-01-03T00:00:00", "2020-01-04T00:00:00"]


@pytest.mark.parametrize("new,total", [(["2019-01-01T00:00:00", "2018-01-01T00:00:00"], 4), ([], 4), (["2020-02-01T00:00:00", "2020-02-02T00:00:00"], 6), (["2020-01-04T00:00:00"] * 2, 4)])
def test_append_takes_later_rows_only(spark, new, total):
    old = times(spark, OLD)
    added = refresh.append_refresh(times(spark, new), old, "t")
    assert old.count() + added.count() == total


def test_append_into_nothing_takes_all(spark):
    assert refresh.append_refresh(times(spark, OLD), times(spark, []), "t").count() == 4


def test_overlap_takes_late_rows_and_drops_known_ones(spark):
    old = spark.createDataFrame([(1, 100, None), (2, 110, "x")], "id int, t long, s string")
    new = spark.createDataFrame([(1, 100, None), (2, 110, "x"), (3, 105, None), (4, 90, "late"), (5, 120, "y"), (2, 110, None)], "id int, t long, s string")
    got = refresh.append_refresh(new, old, "t", timedelta(seconds=15), "unix_seconds")
    assert sorted((r.id, r.s or "") for r in got.collect()) == [(2, ""), (3, ""), (5, "y")]


@pytest.mark.parametrize("kind,given,ok", [(T.StringType(), "ISO8601", True), (T.StringType(), "timestamp", False), (T.LongType(), "unix_millis", True), (T.DoubleType(), "unix_seconds", True), (T.LongType(), "ISO8601", False), (T.TimestampNTZType(), "timestamp", True), (T.TimestampNTZType(), "timestamptz", False), (T.TimestampType(), "timestamptz", True), (T.DateType(), None, False), (T.BinaryType(), None, False)])
def test_time_formats(kind, given, ok):
    if ok:
        assert refresh.check_time_format(kind, given) == given
    else:
        with pytest.raises(ValueError):
            refresh.check_time_format(kind, given)


def test_retention_keeps_the_edge_and_filters_reach_the_scan(spark, sf):
    now = datetime(2020, 1, 10, tzinfo=UTC)
    df = times(spark, ["2020-01-03 00:00:00", "2020-01-02 23:59:59.999999", None], "timestamp_ntz")
    assert sorted(str(r.t) for r in refresh.retain(df, "t", timedelta(days=7), now).collect()) == ["2020-01-03 00:00:00", "None"]
    events = spark.read.parquet(f"{sf}/events.parquet")
    plan = refresh.full_refresh(events, "ts", timedelta(days=7), datetime(2024, 1, 30, tzinfo=UTC))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan


LOG = "id int, name string, at string"


def test_conflicts_drop_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (5, "File Download", "2023")], LOG)
    new = spark.createDataFrame([(5, "File Accessed", "2024"), (6, "n", "y")], LOG)
    up = {tuple(r) for r in refresh.resolve_conflicts(old, new, {("id",): "upsert"}).collect()}
    assert up == {(1, "a", "x"), (5, "File Accessed", "2024"), (6, "n", "y")}
    kept = {tuple(r) for r in refresh.resolve_conflicts(old, new, {("id",): "drop"}).collect()}
    assert kept == {(1, "a", "x"), (5, "File Download", "2023"), (6, "n", "y")}
    with pytest.raises(ValueError):
        refresh.check_conflicts({("id",): "drop", ("name",): "upsert"}, [("id",), ("name",)])
    with pytest.raises(ValueError):
        refresh.check_conflicts({("at",): "drop"}, [("id",)])


def test_fallback(spark):
    local, source = spark.range(5), spark.range(10)
    assert [r.id for r in refresh.with_fallback(local, source, "id > 2").collect()] == [3, 4]
    assert sorted(r.id for r in refresh.with_fallback(local, source, "id > 7").collect()) == [8, 9]


def test_casts_and_write_checks(spark):
    df = spark.createDataFrame([("7", 1)], "a string, b int")
    wanted = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("c", T.DoubleType())])
    assert [tuple(r) for r in refresh.cast_to(df, wanted).collect()] == [(1, 7, None)]
    with pytest.raises(ValueError):
        refresh.cast_to(df, T.StructType([T.StructField("z", T.LongType(), False)]))
    with pytest.raises(ValueError):
        refresh.check_write(df, wanted)
    refresh.check_write(df.toDF("x", "y"), df.schema)


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    kept, count = refresh.delete_where(df, "a < 2")
    assert sorted(str(r.a) for r in kept.collect()) == ["3", "None"] and count.first()["count"] == 1


def test_changes_last_one_wins_and_unknown_are_ignored(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    rows = [(1, "u", 1, "x"), (2, "u", 1, "y"), (3, "d", 2, None), (4, "c", 1, "z"), (5, "t", 1, "t"), (6, "d", 2, "w"), (7, "c", 1, "w"), (8, "u", 3, "late")]
    changes = spark.createDataFrame([(s, op, (k, v)) for s, op, k, v in rows], "seq int, op string, data struct<k int, v string>")
    got = sorted(tuple(r) for r in apply_changes(table, changes, ["k"]).collect())
    assert got == [(1, "w"), (3, "late")]


def test_append_filters_reach_both_scans(spark, sf, tmp_path, capsys):
    events = spark.read.parquet(f"{sf}/events.parquet")
    millis = events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("s", F.col("ms") / 1000)
    millis.write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    source.where("event_id % 2 = 0 AND ts < timestamp_ntz'2024-01-20 00:00:00'").write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    for column, form in (("ts", None), ("ms", "unix_millis"), ("s", "unix_seconds")):
        fresh = refresh.append_refresh(source, kept, column, timedelta(hours=6), form)
        fresh.explain()
        plan = capsys.readouterr().out
        assert plan.count(f"GreaterThan({column},") == 2, plan
        top = kept.agg(F.max(column)).first()[0]
        edge = top - timedelta(hours=6) if column == "ts" else top - 6 * 3600 * (1000 if column == "ms" else 1)
        have = {r.event_id for r in kept.collect()}
        assert {r.event_id for r in fresh.collect()} == {r.event_id for r in source.collect() if r[column] > edge and r.event_id not in have}


def test_new_rows_of_one_key_count_once(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "e"), (None, "x"), (None, "y")], "k int, v string")
    got = refresh.resolve_conflicts(old, new, {("k",): "upsert"}, sequence="v").collect()
    assert sorted(((r.k or 0, r.v) for r in got)) == [(0, "n"), (0, "x"), (0, "y"), (1, "c"), (2, "e")]
    got = refresh.resolve_conflicts(old, new, {("k",): "drop"}, sequence="v").collect()
    assert sorted(((r.k or 0, r.v) for r in got)) == [(0, "n"), (0, "x"), (0, "y"), (1, "a"), (2, "e")]


def test_a_batch_run_again_adds_nothing(spark):
    store = Store(spark, new_dir(spark, "replayed"))
    assert store.append(spark.range(3), "c#0") == 3 and store.append(spark.range(3), "c#0") == 0 and store.append(spark.range(2), "c#1") == 2
    assert store.read().count() == 5 and store.latest()["version"] == 2


def test_orders_part_at_outer_commas(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "a int, b int")
    assert [r.a for r in sampling.sample_top(df, "ORDER BY coalesce(b, 9) DESC, a", 3).collect()] == [1, 2, 3]
    assert [r.a for r in sampling.sample_top(df, "b DESC NULLS LAST, concat('x,', a)", 3).collect()] == [2, 3, 1]
