"""Aggregates by function and kind: no rows, one row, nulls, negatives, ties, overflow and refused kinds."""

from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.errors import EngineError, ErrorCode
from tallyforge.functions import decimals
from tallyforge.job import Job
from tallyforge.plans.compile import compile_plan
from tallyforge.plans.spec import Agg, Plan, Scan, Stage
from tallyforge.types import LENGTH, Kind, kind_of


def rows(spark, data, schema, *stages, **more):
    plan = Plan([Scan(frame=spark.createDataFrame(data, schema))], list(stages), **more)
    return sorted(map(tuple, compile_plan(plan, spark).collect()), key=str)


def test_min_max_are_signed(spark):
    data = [(1, -5), (1, 3), (2, -(2**63)), (2, 2**63 - 1)]
    assert rows(spark, data, "k long, v long", Stage(["k"], [Agg("min", "v", "a"), Agg("max", "v", "b")])) == [(1, -5, 3), (2, -(2**63), 2**63 - 1)]


def test_text_is_compared_by_bytes(spark):
    data = [(1, "a"), (1, "A"), (1, ""), (1, "ä")]
    assert rows(spark, data, "k long, v string", Stage(["k"], [Agg("min", "v", "a"), Agg("max", "v", "b")])) == [(1, "", "ä")]


def test_nulls_are_skipped_and_an_all_null_group(spark):
    data = [(1, None), (1, None), (2, None), (2, 0), (None, 7), (0, 9)]
    aggs = [Agg("count", "v", "n"), Agg("sum", "v", "s"), Agg("min", "v", "m"), Agg("count_distinct", "v", "d"), Agg("avg", "v", "a")]
    out = rows(spark, data, "k long, v long", Stage(["k"], aggs))
    by = {r[0]: r[1:] for r in out}
    assert by[1] == (0, None, None, 0, None)
    assert by[2] == (1, 0, 0, 1, Decimal("0.0000"))
    assert by[None][1] == 7 and by[0][1] == 9  # a null key is a group of its own


def test_a_null_does_not_hide_a_zero_from_distinct(spark):
    assert rows(spark, [(1, None), (1, 0), (1, 0)], "k long, v long", Stage(["k"], [Agg("count_distinct", "v", "n"), Agg("sum_distinct", "v", "s")])) == [(1, 1, 0)]


@pytest.mark.parametrize("kind,values", [("long", [2**63 - 1, 1]), ("decimal(38,10)", [Decimal("9" * 28), Decimal("1")] * 11), ("double", [1.7e308, 1.7e308])])
def test_sums_raise_on_overflow(spark, kind, values):
    if kind.startswith("decimal"):
        values = [Decimal("9999999999999999999999999999.9")] * 11
    with pytest.raises(EngineError) as e:
        Job(Plan([Scan(frame=spark.createDataFrame([(v,) for v in values], f"v {kind}"))], [Stage([], [Agg("sum", "v", "s")])]), spark).rows()
    assert e.value.code == ErrorCode.OVERFLOW


def test_decimal_sums_carry(spark):
    data = [(1, Decimal(17179869184)), (1, Decimal(0)), (1, Decimal(-1))]
    assert rows(spark, data, "k long, v decimal(28,10)", Stage(["k"], [Agg("sum", "v", "s")]))[0][1] == Decimal(17179869183)


@pytest.mark.parametrize("total,n,want", [(1, 12, "0.0833333333"), (-1, 12, "-0.0833333333"), (2, 3, "0.6666666666"), (6, 3, "2.0000000000")])
def test_truncated_average(spark, total, n, want):
    data = [(1, Decimal(total))] + [(1, Decimal(0))] * (n - 1)
    assert rows(spark, data, "k long, v decimal(18,2)", Stage(["k"], [Agg("avg", "v", "a", scale=10, truncate=True)])) == [(1, Decimal(want))]


def test_sum_of_text_is_null(spark):
    assert rows(spark, [(1, "5"), (1, "6")], "k long, v string", Stage(["k"], [Agg("sum", "v", "s")])) == [(1, None)]


@pytest.mark.parametrize("func,kind", [("sum", "timestamp_ntz"), ("avg", "string"), ("min", "binary"), ("sum", "binary"), ("avg", "timestamp_ntz"), ("median", "long")])
def test_refused_before_any_job(spark, func, kind):
    frame = spark.createDataFrame([], f"k long, v {kind}")
    with pytest.raises(EngineError) as e:
        compile_plan(Plan([Scan(frame=frame)], [Stage(["k"], [Agg(func, "v", "x")])]), spark)
    assert e.value.code == ErrorCode.UNSUPPORTED


def test_unsupported_columns_are_refused(spark):
    with pytest.raises(EngineError):
        compile_plan(Plan([Scan(frame=spark.createDataFrame([], "a array<int>"))]), spark)


def test_empty_input(spark):
    aggs = [Agg("count", None, "n"), Agg("sum", "v", "s")]
    assert rows(spark, [], "v long", Stage([], aggs)) == [(0, None)]
    assert rows(spark, [], "v long", Stage([], aggs, empty_global="no_row")) == []
    assert rows(spark, [], "v long", Stage(["v"], aggs[:1])) == []


def test_binary_keys_keep_their_bounds_and_zeros_are_equal(spark):
    assert len(rows(spark, [(b"a", b"bc"), (b"ab", b"c")], "a binary, b binary", Stage(["a", "b"], [Agg("count", None, "n")]))) == 2
    assert rows(spark, [(0.0,), (-0.0,)], "v double", Stage(["v"], [Agg("count", None, "n")])) == [(0.0, 2)]


def test_shapes(spark):
    data = [(1, "x", Decimal("1.5")), (1, "y", Decimal("2.5"))]
    schema = "a long, b string, c decimal(28,10)"
    carried = rows(spark, data, schema, Stage(["a"], [Agg("sum", "c", "c")], output="input", order="b"))
    assert carried == [(1, "y", Decimal("4.0000000000"))]
    merged = rows(spark, data, schema, Stage(["a"], [Agg("count", None, "n")], output=[("a", Kind.LONG), ("n", Kind.LONG), ("c", Kind.VARCHAR)]))
    assert merged == [(1, 2, None)]
    other = rows(spark, data, schema, Stage(["a"], [Agg("count", None, "n")], output=[("a", Kind.LONG), ("n", Kind.LONG)]))
    assert other == [(None, 2)]
    assert rows(spark, data, schema, Stage()) == sorted(data, key=str)


def test_distinct_rows_and_keys(spark):
    data = [(1, "a", 0.5), (1, "a", 0.5), (1, "b", 0.5), (2, None, None)]
    assert len(rows(spark, data, "a long, b string, c double", Stage(distinct=True))) == 3
    assert rows(spark, data, "a long, b string, c double", Stage(["a"], distinct=True, order="b")) == [(1, "a", 0.5), (2, None, None)]
    with pytest.raises(EngineError):
        rows(spark, data, "a long, b string, c double", Stage(["a"], [Agg("count", None, "n")], distinct=True))


def test_two_shards_in_two_stages_equal_one(spark):
    a, b = spark.range(0, 500).selectExpr("id % 7 as k", "id as v"), spark.range(500, 900).selectExpr("id % 7 as k", "id as v")
    one = compile_plan(Plan([Scan(frame=a), Scan(frame=b)], [Stage(["k"], [Agg("sum", "v", "s"), Agg("count", None, "n"), Agg("min", "v", "m")])]), spark)
    salted = a.unionAll(b).selectExpr("k", "v", "v % 5 as salt")
    two = compile_plan(Plan([Scan(frame=salted)], [Stage(["k", "salt"], [Agg("sum", "v", "s"), Agg("count", None, "n"), Agg("min", "v", "m")]), Stage(["k"], [Agg("sum", "s", "s"), Agg("sum", "n", "n"), Agg("min", "m", "m")])]), spark)
    assert sorted(one.collect()) == sorted(two.collect()) == sorted(two.repartition(13).collect())


def test_declared_schemas(spark):
    frame = spark.createDataFrame([(1, "x")], "a int, b string")
    out = compile_plan(Plan([Scan(frame=frame, schema=[("p", Kind.LONG), ("q", Kind.VARCHAR)])]), spark)
    assert out.columns == ["p", "q"] and isinstance(out.schema["p"].dataType, T.LongType)
    with pytest.raises(EngineError):
        compile_plan(Plan([Scan(frame=frame, schema=[("p", Kind.VARCHAR), ("q", Kind.VARCHAR)])]), spark)


def test_wide_decimals_in_plans(spark):
    values = [(1, "9" * 34 + ".5"), (1, "-0.000000000000000000000000000001"), (1, None), (1, "2"), (1, "2"), (2, None), (None, "7.25"), (1, "-" + "8" * 34)]
    frame = spark.createDataFrame(values, "k long, v string").select("k", decimals.parse(F.col("v")).alias("v"))
    aggs = [Agg(f, "v", f) for f in ("min", "max", "sum", "avg", "count", "count_distinct", "sum_distinct", "avg_distinct")]
    out = compile_plan(Plan([Scan(frame=frame)], [Stage(["k"], aggs)]), spark)
    got = {r.k: r for r in out.select("k", *[decimals.render(F.col(a)).alias(a) if not a.startswith("count") else a for a in out.columns[1:]]).collect()}
    with localcontext() as c:
        c.prec = 90
        one = [Decimal(v) for k, v in values if k == 1 and v]
        cut = lambda x: x.quantize(Decimal(1).scaleb(-30), rounding="ROUND_DOWN")
        want = {"min": min(one), "max": max(one), "sum": sum(one), "avg": cut(sum(one) / 5), "sum_distinct": sum(set(one)), "avg_distinct": cut(sum(set(one)) / 4)}
        assert {a: Decimal(got[1][a]) for a in want} == want
    assert (got[1]["count"], got[1]["count_distinct"]) == (5, 4)
    assert [got[2][a.out] for a in aggs] == [None, None, None, None, 0, 0, None, None]
    assert got[None]["sum"] == got[None]["avg"] == got[None]["sum_distinct"] == "7.25"
    whole = compile_plan(Plan([Scan(frame=frame)], [Stage([], [Agg("sum_distinct", "v", "s"), Agg("count", None, "n")])]), spark)
    assert whole.select(decimals.render(F.col("s")), "n").first()[1] == 8
    assert compile_plan(Plan([Scan(frame=frame)], [Stage(["v"], [Agg("count", None, "n")])]), spark).count() == 6
    shaped = compile_plan(Plan([Scan(frame=frame)], [Stage(["k"], [Agg("sum", "v", "v")], output="input")]), spark)
    assert kind_of(shaped.schema["v"].dataType) == Kind.WIDE


def test_wide_decimals_overflow(spark):
    frame = spark.createDataFrame([("9" * 35,), ("1",)], "v string").select(decimals.parse(F.col("v")).alias("v"))
    with pytest.raises(EngineError) as e:
        Job(Plan([Scan(frame=frame)], [Stage([], [Agg("sum", "v", "s")])]), spark).rows()
    assert e.value.code == ErrorCode.OVERFLOW


def test_lengths():
    assert set(LENGTH) == set(Kind) and LENGTH[Kind.LONG] == 8 and LENGTH[Kind.VARCHAR] is None
