"""Wide decimals, timestamps and text."""

from decimal import ROUND_DOWN, Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from tallyforge.errors import EngineError
from tallyforge.functions import decimals, text, times
from tallyforge.sources.scan import from_text
from tallyforge.types import Kind

getcontext().prec = 90


def test_wide_decimals(spark):
    values = ["1" * 35 + ".000000000000000000000000000001", "-0.5", ".5", "-" + "9" * 20 + ".999999999999999999999999999999", "12", "17179869184.25"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", decimals.parse(F.col("v")).alias("w"))
    for v, t in df.select("v", decimals.render(F.col("w"))).collect():
        assert Decimal(t) == Decimal(v), (v, t)
    got = df.agg(decimals.render(decimals.total(F.col("w"))).alias("t")).first()[0]
    assert Decimal(got) == sum(map(Decimal, values))
    ordered = [r[0] for r in df.orderBy("w").select("v").collect()]
    assert ordered == sorted(values, key=Decimal)
    assert spark.range(1).select(decimals.parse(F.lit("1.2.3")).alias("w")).first()[0] is None


def cut(x):
    return x.quantize(Decimal(1).scaleb(-30), rounding=ROUND_DOWN)


def test_wide_averages_are_cut(spark):
    values = ["9" * 35 + "." + "9" * 30, "-" + "9" * 35 + "." + "9" * 30, "1", "-1", "0.000000000000000000000000000007", "-0.5", "12345678901234567890123456789.123456789012345678901234567891", "0", None]
    counts = [1, 2, 3, 7, 12, 999_999_999_999_999_999, 2**63 - 1]
    df = spark.createDataFrame([(v, n) for v in values for n in counts], "v string, n long").select("v", "n", decimals.parse(F.col("v")).alias("w"))
    for v, n, t in df.select("v", "n", decimals.render(decimals.divided(F.col("w"), F.col("n")))).collect():
        assert (t is None) if v is None else Decimal(t) == cut(Decimal(v) / n), (v, n, t)
    df = spark.createDataFrame([(v,) for v in ("1", "0", "0", None)], "v string").select(decimals.parse(F.col("v")).alias("w"))
    assert df.select(decimals.render(decimals.average(F.col("w")))).first()[0] == "0." + "3" * 30
    assert df.filter("w is null").select(decimals.average(F.col("w"))).first()[0] is None


def test_wide_comparisons_and_constants(spark):
    pairs = [("1", "-2"), ("-0.5", "0.5"), ("0", "-0"), ("3.1", "3.09"), (None, "1")]
    df = spark.createDataFrame(pairs, "a string, b string").select(decimals.parse(F.col("a")).alias("a"), decimals.parse(F.col("b")).alias("b"))
    assert [tuple(r) for r in df.select(decimals.compare(F.col("a"), F.col("b")), decimals.compare_absolute(F.col("a"), F.col("b"))).collect()] == [(1, -1), (-1, 0), (0, 0), (1, 1), (None, None)]
    least, zero, most = spark.range(1).select(*[decimals.render(x) for x in (decimals.least(), decimals.zero(), decimals.greatest())]).first()
    assert (least, zero, most) == ("-" + decimals.GREATEST, "0.0", decimals.GREATEST)


def test_wide_from_numbers(spark):
    doubles = [0.1, -12.3, 1e-25, 123456789.25, -9.007199254740993e15, 1.5e20, -3e34, 1e35, float("inf"), float("nan"), None, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in doubles], "x double").select(decimals.render(decimals.of_double(F.col("x")))).collect()]
    assert [None if t is None else Decimal(t) for t in got] == [*[Decimal(repr(x)) for x in doubles[:7]], None, None, None, None, Decimal(0)]
    longs = [2**63 - 1, -(2**63), 0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in longs], "x long").select(decimals.render(decimals.of_long(F.col("x")))).collect()]
    assert got == [None if x is None else f"{x}.0" for x in longs]


def test_time_modes(spark):
    df = spark.sql("select timestamp_ntz'2020-01-02 03:04:05.678' as t, timestamp_ntz'2021-01-01 00:00:00' as u")
    assert tuple(df.select(*[times.render(F.col("t"), m) for m in ("date", "time", "seconds", "millis")]).first()) == ("2020-01-02", "03:04:05", "2020-01-02 03:04:05", "2020-01-02 03:04:05.678")
    assert tuple(df.select(times.compare(F.col("t"), F.col("u")), times.compare(F.col("u"), F.col("u"))).first()) == (-1, 0)
    with pytest.raises(EngineError):
        times.render(F.col("t"), "year")


def test_times(spark):
    rows = ["0000-00-00 00:00:00", "2020-01-02", "2020-01-02 09:05:07", "2020-01-02 00:00:00.123", "nonsense"]
    df = spark.createDataFrame([(v,) for v in rows], "v string").select(times.parse(F.col("v")).alias("t"))
    out = [tuple(r) for r in df.select(times.packed(F.col("t")), times.render(F.col("t")), times.unpacked(times.packed(F.col("t"))) == F.col("t")).collect()]
    assert out[0] == (None, None, None) and out[4] == (None, None, None)
    assert out[1] == (20200102000000000, "2020-01-02", True)
    assert out[2] == (20200102090507000, "2020-01-02 09:05:07.0", True)
    assert out[3][0] == 20200102000000123 and out[3][2]


def test_text(spark):
    df = spark.createDataFrame([(1, 0.1, Decimal("12.5000"), "x", True, b"b"), (None, None, None, None, None, None)], "a int, b double, c decimal(18,4), d string, e boolean, f binary")
    one, none = text.rendered(df).collect()
    assert tuple(one) == ("1", "0.1000000000000000", "12.5", "x", "1", b"b") and set(none) == {None}
    assert spark.sql("select cast(3 as decimal(9,0)) as x").select(text.decimal(F.col("x"))).first()[0] == "3.0"


def test_ingestion(spark):
    df = spark.createDataFrame([("1", "0000-00-00", "2.5", "ab"), ("x", "2020-02-30", "", "")], "a string, b string, c string, d string")
    out = from_text(df, [("a", Kind.LONG), ("b", Kind.TIMESTAMP), ("c", Kind.DOUBLE), ("d", Kind.VARBINARY)]).collect()
    assert tuple(out[0]) == (1, None, 2.5, b"ab") and tuple(out[1]) == (None, None, None, b"")
