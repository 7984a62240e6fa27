"""Rows by hash bucket of their key, and buckets by route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ErrorCode

BUCKETS = 256


@dataclass(frozen=True)
class Route:
    """A target for the buckets from first to last, both included."""

    name: str
    first: int
    last: int


def bucket(*key: Column, n: int = BUCKETS, portable: bool = False) -> Column:
    """The key's bucket, 0 to n - 1. Spark's hash, or, if portable, the first bytes of the MD5 of the key's text, which other engines have."""
    if not portable:
        return F.pmod(F.hash(*key), F.lit(n))
    text = F.concat_ws("\x00", *[F.coalesce(k.cast("string"), F.lit("\x01")) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def route(bucket: Column, routes: list[Route]) -> Column:
    """The name of the first route that holds the bucket; the first of all is the default."""
    if not routes:
        raise EngineError(ErrorCode.RANGE, "no route")
    for r in routes:
        if not 0 <= r.first <= r.last:
            raise EngineError(ErrorCode.RANGE, f"buckets {r.first} to {r.last} of route {r.name}")
    out = F.lit(None).cast("string")
    for r in reversed(routes):
        out = F.when(bucket.between(r.first, r.last), F.lit(r.name)).otherwise(out)
    return F.coalesce(out, F.lit(routes[0].name))


def routed(df: DataFrame, key: list[str], routes: list[Route], n: int = BUCKETS, portable: bool = False) -> DataFrame:
    """df with its rows' bucket and route. Written with partitionBy("route"), each target gets its rows; nothing is shuffled for it."""
    b = bucket(*[F.col(f"`{k}`") for k in key], n=n, portable=portable)
    return df.withColumn("bucket", b).withColumn("route", route(F.col("bucket"), routes))


def exchanged(df: DataFrame, key: list[str], n: int = BUCKETS) -> DataFrame:
    """df in n partitions by the key's hash: rows of equal keys meet in one."""
    return df.repartition(n, *[F.col(f"`{k}`") for k in key])
