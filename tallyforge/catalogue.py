"""The engine's own queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import decimals, text, times
from .operators import routing
from .plans.compile import compile_plan
from .plans.spec import Agg, Plan, Scan, Stage
from .session import require, scratch
from .sources.scan import from_text
from .streaming import events as streams
from .types import Kind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(require(spark), d)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def run(spark: SparkSession, frame: DataFrame, *stages: Stage, **more) -> DataFrame:
    return compile_plan(Plan([Scan(frame=frame)], list(stages), **more), spark)


def sql_scan(spark: SparkSession, d: str, sql: str, *tables: str) -> Scan:
    """SQL text whose tables, in braces, are the folder's files."""
    return Scan(frame=spark.sql(sql, **{t: table(spark, d, t) for t in tables}))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def scan_projection(spark, d):
    return compile_plan(Plan([sql_scan(spark, d, "select l_orderkey, l_partkey, l_quantity from {lineitem}", "lineitem")]), spark)


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R'")
def scan_filter_expr(spark, d):
    sql = "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from {lineitem} where l_shipdate >= timestamp_ntz'1997-01-01 00:00:00' and l_returnflag = 'R'"
    return compile_plan(Plan([sql_scan(spark, d, sql, "lineitem")]), spark)


@query("SELECT n_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def shard_star_join(spark, d):
    sql = "select n_name, o_totalprice from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey"
    out = compile_plan(Plan([sql_scan(spark, d, sql, "orders", "customer", "nation")], [Stage(["n_name"], [Agg("count", None, "n"), Agg("sum", "o_totalprice", "total")])]), spark)
    return out.withColumn("total", F.round("total", 2))


@query("SELECT l_returnflag, min(l_orderkey) AS min_long, max(l_shipdate) AS max_ts, min(l_linestatus) AS min_text, max(l_extendedprice) AS max_double FROM lineitem GROUP BY l_returnflag")
def agg_minmax_types(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_returnflag"], [Agg("min", "l_orderkey", "min_long"), Agg("max", "l_shipdate", "max_ts"), Agg("min", "l_linestatus", "min_text"), Agg("max", "l_extendedprice", "max_double")]))


@query("SELECT l_suppkey, sum(l_partkey)::BIGINT AS total FROM lineitem GROUP BY l_suppkey")
def agg_sum_long(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_suppkey"], [Agg("sum", "l_partkey", "total")]))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
def agg_sum_double(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_returnflag"], [Agg("sum", "l_extendedprice", "total")])).withColumn("total", F.round("total", 2))


def _money(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))


@query("SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM lineitem GROUP BY l_returnflag")
def agg_sum_decimal(spark, d):
    return run(spark, _money(spark, d), Stage(["l_returnflag"], [Agg("sum", "price", "total")])).withColumn("total", F.col("total").cast("decimal(38,2)"))


@query("SELECT l_returnflag, NULL::VARCHAR AS total FROM lineitem GROUP BY l_returnflag")
def agg_sum_varchar_null(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_returnflag"], [Agg("sum", "l_linestatus", "total")]))


@query("SELECT l_suppkey, (sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) / count(*))::DECIMAL(38,4) AS mean FROM lineitem GROUP BY l_suppkey")
def agg_avg_decimal(spark, d):
    return run(spark, _money(spark, d), Stage(["l_suppkey"], [Agg("avg", "price", "mean", scale=4)]))


@query("SELECT l_suppkey, (((sum((l_extendedprice::DECIMAL(18,2) * 100)::HUGEINT) * 10000) // count(*))::DECIMAL(38,0))::DECIMAL(38,0) AS micros FROM lineitem GROUP BY l_suppkey")
def agg_avg_decimal_trunc(spark, d):
    out = run(spark, _money(spark, d), Stage(["l_suppkey"], [Agg("avg", "price", "mean", scale=6, truncate=True)]))
    return out.select("l_suppkey", (F.col("mean") * 1_000_000).cast("decimal(38,0)").alias("micros"))


@query("SELECT l_returnflag, count(nullif(l_linestatus, 'O'))::BIGINT AS n, sum(nullif(l_linenumber, 1))::BIGINT AS total FROM lineitem GROUP BY l_returnflag")
def agg_count_nulls(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_returnflag", "nullif(l_linestatus, 'O') as s", "nullif(l_linenumber, 1) as v")
    return run(spark, x, Stage(["l_returnflag"], [Agg("count", "s", "n"), Agg("sum", "v", "total")]))


@query("SELECT l_returnflag, sum(DISTINCT l_linenumber)::BIGINT AS s, count(DISTINCT l_suppkey)::BIGINT AS n, count(*)::BIGINT AS rows_, count(DISTINCT l_linestatus)::BIGINT AS m FROM lineitem GROUP BY l_returnflag")
def agg_distinct_mixed(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_returnflag"], [Agg("sum_distinct", "l_linenumber", "s"), Agg("count_distinct", "l_suppkey", "n"), Agg("count", None, "rows_"), Agg("count_distinct", "l_linestatus", "m")]))


@query("SELECT l_returnflag, (sum(DISTINCT l_quantity::DECIMAL(18,2))::DECIMAL(38,2) / count(DISTINCT l_quantity))::DECIMAL(38,4) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_avg_distinct(spark, d):
    x = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    return run(spark, x, Stage(["l_returnflag"], [Agg("avg_distinct", "q", "mean", scale=4)]))


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(o_orderkey)::BIGINT AS n FROM orders")
def agg_global(spark, d):
    return run(spark, table(spark, d, "orders"), Stage([], [Agg("min", "o_orderkey", "lo"), Agg("max", "o_orderkey", "hi"), Agg("count", "o_orderkey", "n")]))


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0")
def agg_global_empty(spark, d):
    return run(spark, table(spark, d, "orders").filter("o_orderkey < 0"), Stage([], [Agg("count", None, "n")], empty_global="no_row"))


@query("SELECT nullif(l_linenumber, 1)::BIGINT AS k, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def agg_null_key(spark, d):
    return run(spark, table(spark, d, "lineitem").selectExpr("nullif(l_linenumber, 1) as k"), Stage(["k"], [Agg("count", None, "n")]))


@query("SELECT l_returnflag, min(l_orderkey) AS lo, sum(l_partkey)::BIGINT AS total, count(*)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
def agg_two_stage(spark, d):
    partial = Stage(["l_suppkey", "l_returnflag"], [Agg("min", "l_orderkey", "lo"), Agg("sum", "l_partkey", "total"), Agg("count", None, "n")])
    return run(spark, table(spark, d, "lineitem"), partial, Stage(["l_returnflag"], [Agg("min", "lo", "lo"), Agg("sum", "total", "total"), Agg("sum", "n", "n")]))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY o_custkey")
def agg_representative(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = run(spark, x, Stage(["o_custkey"], [Agg("sum", "o_totalprice", "o_totalprice")], output="input", order="o_orderkey"))
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT l_returnflag, count(*)::BIGINT AS l_linestatus, NULL::DECIMAL(38,10) AS other FROM lineitem GROUP BY l_returnflag")
def shape_merge(spark, d):
    """Same width, other types: equal kinds are carried, the rest is null, aggregates are written over."""
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey")
    return run(spark, x, Stage(["l_returnflag"], [Agg("count", None, "l_linestatus")], output=[("l_returnflag", Kind.VARCHAR), ("l_linestatus", Kind.LONG), ("other", Kind.DECIMAL)]))


@query("SELECT NULL::VARCHAR AS flag, count(*)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
def shape_null(spark, d):
    """Another width: all null but the aggregates."""
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey")
    return run(spark, x, Stage(["l_returnflag"], [Agg("count", None, "n")], output=[("flag", Kind.VARCHAR), ("n", Kind.LONG)]))


@query("SELECT count(*)::BIGINT AS second FROM lineitem GROUP BY l_returnflag")
def agg_last_wins(spark, d):
    """Two aggregates for one column: the last counts. Columns by position."""
    return run(spark, table(spark, d, "lineitem").select("l_returnflag", "l_partkey"), Stage([0], [Agg("sum", 1, "second"), Agg("count", 1, "second")])).select("second")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def global_distinct(spark, d):
    return run(spark, table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), Stage(distinct=True))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def distinct_on_key(spark, d):
    return run(spark, table(spark, d, "orders").select("o_custkey", "o_orderkey"), Stage(["o_custkey"], distinct=True, order="o_orderkey"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def union_all_shards(spark, d):
    one = sql_scan(spark, d, "select n_nationkey, n_name from {nation} where n_nationkey < 10", "nation")
    two = sql_scan(spark, d, "select n_nationkey, n_name from {nation} where n_nationkey >= 10", "nation")
    return compile_plan(Plan([one, two]), spark)


@query("SELECT n_regionkey::BIGINT AS n_regionkey FROM nation UNION SELECT r_regionkey::BIGINT FROM region")
def union_distinct(spark, d):
    return compile_plan(Plan([sql_scan(spark, d, "select n_regionkey from {nation}", "nation"), sql_scan(spark, d, "select r_regionkey as n_regionkey from {region}", "region")], [Stage(distinct=True)]), spark)


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S%g')::BIGINT AS t FROM events")
def ts_packed(spark, d):
    return table(spark, d, "events").select("event_id", times.packed(F.col("ts")).alias("t"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT * 1000 AS t FROM events")
def ts_packed_sec(spark, d):
    return table(spark, d, "events").select("event_id", times.packed(F.col("ts"), False).alias("t"))


@query("SELECT event_id, date_trunc('millisecond', ts)::TIMESTAMP AS t FROM events")
def ts_unpacked(spark, d):
    return table(spark, d, "events").select("event_id", times.unpacked(times.packed(F.col("ts"))).alias("t"))


@query("SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%H%M%S') = '000000' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.0' END AS t FROM orders")
def ts_render(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.render(F.col("o_orderdate")).alias("t"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS m FROM events")
def ts_modes(spark, d):
    return table(spark, d, "events").select("event_id", *[times.render(F.col("ts"), m).alias(n) for n, m in (("d", "date"), ("t", "time"), ("s", "seconds"), ("m", "millis"))])


@query("SELECT o_orderkey, CASE WHEN regexp_replace((o_totalprice::DECIMAL(18,4))::VARCHAR, '0+$', '') LIKE '%.' THEN regexp_replace((o_totalprice::DECIMAL(18,4))::VARCHAR, '0+$', '') || '0' ELSE regexp_replace((o_totalprice::DECIMAL(18,4))::VARCHAR, '0+$', '') END AS t FROM orders")
def decimal_render(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.decimal(F.col("o_totalprice").cast("decimal(18,4)")).alias("t"))


@query("SELECT o_orderkey, printf('%.16f', o_totalprice) AS t FROM orders")
def double_render(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.double(F.col("o_totalprice")).alias("t"))


_SPLIT = "SELECT c_nationkey::BIGINT AS k, sum({x}::DECIMAL(38,2))::DECIMAL(38,2) AS total FROM customer GROUP BY 1"


def _wide(spark: SparkSession, d: str, shift: int) -> DataFrame:
    """Customers' balances, shifted, as wide decimals."""
    x = decimals.of_decimal((F.col("c_acctbal") + shift).cast("decimal(38,2)"))
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k"), x.alias("w"))


def _narrow(w: str):
    return (F.col(f"{w}.hi") + F.col(f"{w}.lo").cast("decimal(2,2)")).cast("decimal(38,2)")


@query(_SPLIT.format(x="(c_acctbal + 10000)"))
def wide_decimal_sum(spark, d):
    return run(spark, _wide(spark, d, 10000), Stage(["k"], [Agg("sum", "w", "w")])).select("k", _narrow("w").alias("total"))


@query(_SPLIT.format(x="(c_acctbal - 5000)"))
def wide_decimal_signed(spark, d):
    return run(spark, _wide(spark, d, -5000), Stage(["k"], [Agg("sum", "w", "w")])).select("k", _narrow("w").alias("total"))


@query("SELECT c_nationkey::BIGINT AS k, min(x) AS lo, max(x) AS hi, count(x)::BIGINT AS n, count(DISTINCT x)::BIGINT AS m, sum(DISTINCT x)::DECIMAL(38,2) AS s FROM (SELECT c_nationkey, round(c_acctbal / 1000)::DECIMAL(38,2) AS x FROM customer) GROUP BY 1")
def wide_decimal_aggregates(spark, d):
    x = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k"), decimals.of_decimal(F.round(F.col("c_acctbal") / 1000).cast("decimal(38,2)")).alias("w"))
    out = run(spark, x, Stage(["k"], [Agg("min", "w", "lo"), Agg("max", "w", "hi"), Agg("count", "w", "n"), Agg("count_distinct", "w", "m"), Agg("sum_distinct", "w", "s")]))
    return out.select("k", _narrow("lo").alias("lo"), _narrow("hi").alias("hi"), "n", "m", _narrow("s").alias("s"))


@query("""
SELECT k, CASE WHEN s < 0 THEN '-' ELSE '' END || (abs(s) // (100 * n))::VARCHAR || '.' || lpad(((abs(s) % (100 * n)) * 1000000000000000 // (100 * n))::VARCHAR, 15, '0') AS mean
FROM (SELECT c_nationkey::BIGINT AS k, sum(((c_acctbal - 4000)::DECIMAL(18,2) * 100)::HUGEINT)::HUGEINT AS s, count(*)::HUGEINT AS n FROM customer GROUP BY 1)
""")
def wide_decimal_avg(spark, d):
    """Averages cut after the 30th digit; the first 15 are shown."""
    out = run(spark, _wide(spark, d, -4000), Stage(["k"], [Agg("avg", "w", "w")]))
    sign = F.when((F.col("w.hi") < 0) | (F.col("w.lo") < 0), "-").otherwise("")
    digits = F.substring(F.substring_index(F.abs("w.lo").cast("decimal(38,30)").cast("string"), ".", -1), 1, 15)
    return out.select("k", F.concat(sign, F.abs("w.hi").cast("string"), F.lit("."), digits).alias("mean"))


@query("SELECT id, try_cast(t AS TIMESTAMP) AS t, try_cast(n AS BIGINT) AS n FROM (VALUES (1, '0000-00-00 00:00:00', '5'), (2, '2020-01-02 03:04:05', 'x'), (3, '1999-12-31', '-7')) v(id, t, n)")
def zero_date_null(spark, d):
    x = spark.sql("select * from values ('1', '0000-00-00 00:00:00', '5'), ('2', '2020-01-02 03:04:05', 'x'), ('3', '1999-12-31', '-7') as v(id, t, n)")
    return from_text(x, [("id", T.IntegerType()), ("t", Kind.TIMESTAMP), ("n", Kind.LONG)])


_BUCKET = "(('0x' || substr(md5(o_custkey::VARCHAR), 1, 8))::BIGINT % 256)::INT"


@query(f"SELECT {_BUCKET} AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def bucket_256(spark, d):
    """Rows by hash bucket of the key."""
    return table(spark, d, "orders").groupBy(routing.bucket(F.col("o_custkey"), portable=True).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN b BETWEEN 64 AND 127 THEN 'b' WHEN b BETWEEN 128 AND 200 THEN 'c' ELSE 'a' END AS route, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS keys, sum(b)::BIGINT AS buckets FROM (SELECT *, {_BUCKET} AS b FROM orders) GROUP BY 1")
def bucket_routes(spark, d):
    """Buckets to routes by ranges; those of no range (201 to 255) go to the first route."""
    routes = [routing.Route("a", 0, 63), routing.Route("b", 64, 127), routing.Route("c", 128, 200)]
    x = routing.routed(table(spark, d, "orders"), ["o_custkey"], routes, portable=True)
    return run(spark, x.select("route", "o_custkey", "bucket"), Stage(["route"], [Agg("count", None, "n"), Agg("count_distinct", "o_custkey", "keys"), Agg("sum", "bucket", "buckets")]))


@query("SELECT l_returnflag, count(1)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
def count_constant(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_returnflag"], [Agg("count", None, "n")]))


@query("SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600")
def having_filter(spark, d):
    return run(spark, table(spark, d, "lineitem"), Stage(["l_suppkey"], [Agg("count", None, "n")], having="n > 600"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit(spark, d):
    return run(spark, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), sort=["-o_totalprice", "o_orderkey"], limit=10)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    return compile_plan(Plan([sql_scan(spark, d, "select c_custkey from {customer} left semi join (select * from {orders} where o_totalprice > 300000) on o_custkey = c_custkey", "customer", "orders")]), spark)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return compile_plan(Plan([sql_scan(spark, d, "select c_custkey from {customer} left anti join {orders} on o_custkey = c_custkey", "customer", "orders")]), spark)


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left_count(spark, d):
    return compile_plan(Plan([sql_scan(spark, d, "select c_custkey, o_orderkey from {customer} left join {orders} on o_custkey = c_custkey", "customer", "orders")], [Stage(["c_custkey"], [Agg("count", "o_orderkey", "n")])]), spark)


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def delegated_rollup(spark, d):
    return compile_plan(Plan([sql_scan(spark, d, "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup(l_returnflag, l_linestatus)", "lineitem")]), spark)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS r FROM orders QUALIFY r <= 3")
def delegated_window(spark, d):
    sql = "select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from {orders}) where r <= 3"
    return compile_plan(Plan([sql_scan(spark, d, sql, "orders")]), spark)


@query("SELECT text, count(*)::BIGINT AS n FROM documents GROUP BY text HAVING count(*) > 1")
def distinct_text_count(spark, d):
    return run(spark, table(spark, d, "documents").select("text"), Stage(["text"], [Agg("count", None, "n")], having="n > 1"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::BIGINT AS n, count(value)::BIGINT AS m FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 hour AS window_end, event_type, n, m FROM w WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM events)
""")
def stream_windows(spark, d):
    """Hourly windows over the events as a stream; those that the watermark has closed."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    schema = T.StructType([T.StructField("ts", T.TimestampType()) if f.name == "ts" else f for f in schema])
    out = streams.windowed(streams.stream(spark, f"{d}/events.parquet*", schema), "ts", "1 hour", "10 minutes", ["event_type"], {"n": ("count", None), "m": ("count", "value")})
    base = scratch(spark, "stream")
    got = streams.drained(out, f"{base}/out", f"{base}/state")
    return got.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "event_type", "n", "m")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by flag and status, in one stage."""
    return run(require(spark), _money(spark, d), Stage(["l_returnflag", "l_linestatus"], [Agg("count", None, "n"), Agg("sum", "price", "total"), Agg("avg", "price", "mean", scale=4), Agg("count_distinct", "l_suppkey", "suppliers")]))
