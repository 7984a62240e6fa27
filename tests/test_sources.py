"""Another database's query, statements without a result, routes of buckets."""

import pytest
from pyspark.sql import functions as F

from tallyforge.errors import EngineError
from tallyforge.job import Job
from tallyforge.operators.routing import Route, bucket, exchanged, route, routed
from tallyforge.plans.compile import compile_plan
from tallyforge.plans.spec import Agg, Plan, Scan, Stage
from tallyforge.sources.scan import database


def test_a_query_of_another_database(spark):
    url = "jdbc:derby:memory:shop"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as double) / 4 as v", "concat('n', id) as name")
    df.coalesce(1).write.format("jdbc").options(url=url + ";create=true", dbtable="sales", **options).save()
    got = database(spark, url, 'select "k", "v", "name" from sales where "id" < 500', fetch=100, **options)
    plan = Plan([Scan(frame=got)], [Stage(["k"], [Agg("sum", "v", "total"), Agg("count", None, "n")])])
    want = df.filter("id < 500").groupBy("k").agg(F.sum("v"), F.count(F.lit(1))).collect()
    assert sorted(map(tuple, Job(plan, spark))) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="(?i)nowhere|does not exist"):
        database(spark, url, "select * from nowhere", **options).collect()


def test_statements_without_a_result(spark):
    assert Job(Plan([Scan(sql="create or replace temporary view seven as select 7 as x")]), spark).rows() == []
    assert list(Job(Plan([Scan(sql="set spark.sql.shuffle.partitions=4")]), spark)) != [] and [r.x for r in Job(Plan([Scan(sql="select x from seven")]), spark)] == [7]


def test_routes(spark):
    df = spark.range(5000).selectExpr("if(id % 11 = 0, null, id % 600) as k", "id")
    routes = [Route("a", 0, 99), Route("b", 100, 199)]
    for portable in (False, True):
        rows = routed(df, ["k"], routes, portable=portable).collect()
        assert len(rows) == 5000 and all(0 <= r.bucket < 256 and r.route == ("b" if 100 <= r.bucket <= 199 else "a") for r in rows)
        assert len({(r.k, r.bucket) for r in rows}) == 601 and len({r.bucket for r in rows}) > 200
    parts = exchanged(df, ["k"], 16).select("k", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(parts) == 601 and {r.p for r in parts} <= set(range(16))
    for bad in ([], [Route("a", 5, 2)]):
        with pytest.raises(EngineError):
            route(bucket(F.col("k")), bad)


def test_routes_are_written_apart(spark, tmp_path):
    df = routed(spark.range(300), ["id"], [Route("a", 0, 127), Route("b", 128, 255)])
    df.write.partitionBy("route").parquet(str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("route=*")} == {"route=a", "route=b"}
    one = compile_plan(Plan([Scan(frame=spark.read.parquet(str(tmp_path / "out/route=a")))], [Stage([], [Agg("count", None, "n")])]), spark).first().n
    assert one == df.filter("bucket < 128").count() and 0 < one < 300
