"""Physical plans, and the streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import catalogue
from tallyforge.plans.compile import compile_plan
from tallyforge.plans.spec import Agg, Plan, Scan, Stage
from tallyforge.streaming import events as streams


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,exchanges", [("agg_sum_long", 1), ("agg_minmax_types", 1), ("agg_two_stage", 2), ("global_distinct", 1), ("distinct_on_key", 1), ("agg_representative", 1), ("scan_filter_expr", 0), ("union_all_shards", 0)])
def test_exchanges(spark, sf, name, exchanges):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert text.count("Exchange hashpartitioning") == exchanges and "Python" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["agg_minmax_types", "agg_representative", "distinct_on_key", "shape_merge", "wide_decimal_aggregates"])
def test_no_sort_for_groups(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert "Sort" not in text.replace("SortMergeJoin", "") and "HashAggregate" in text, text


def test_more_groups_than_the_map_holds(spark):
    before = spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    frame = spark.range(20_000).selectExpr("id % 5000 as k", "cast(id as string) as t")
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100")
    try:
        out = compile_plan(Plan([Scan(frame=frame)], [Stage(["k"], [Agg("min", "t", "lo"), Agg("count", None, "n")])]), spark).collect()
    finally:
        spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", before)
    assert len(out) == 5000 and all(r.n == 4 and r.lo == min(str(r.k + 5000 * j) for j in range(4)) for r in out)


def test_columns_are_pruned(spark, sf):
    text = plan(catalogue.QUERIES["agg_sum_long"](spark, sf))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in text


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def run(spark, tmp_path, rows, result):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    source = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    out = result(streams.stream(spark, source, schema).withColumn("v", F.col("v")))
    return streams.drained(out, str(tmp_path / "out"), str(tmp_path / "state")).collect()


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [[(at(1), "a", 1), (at(2), "a", 2), (at(70), "a", None), (at(200), "b", 9)]]
    got = run(spark, tmp_path, rows, lambda s: streams.windowed(s, "ts", "1 hour", "10 minutes", ["k"], {"n": ("count", None), "s": ("sum", "v")}))
    assert sorted((r.window_start.hour, r.k, r.n, r.s) for r in got) == [(0, "a", 2, 3), (1, "a", 1, None)]


def test_sessions(spark, tmp_path):
    rows = [[(at(1), "a", 1), (at(4), "a", 2), (at(30), "a", 3), (at(300), "b", 9)]]
    got = run(spark, tmp_path, rows, lambda s: streams.sessions(s, "ts", "5 minutes", "10 minutes", ["k"]))
    assert sorted(r.n for r in got) == [1, 2]


def test_distinct(spark, tmp_path):
    rows = [[(at(1), "a", 1), (at(2), "a", 2), (at(3), "b", 3)]]
    assert sorted(r.k for r in run(spark, tmp_path, rows, lambda s: streams.distinct(s, "ts", "10 minutes", ["k"]))) == ["a", "b"]
