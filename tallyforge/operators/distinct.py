"""Distinct rows, and one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import UNSIZED, kind_of
from .aggregate import by_hash


def distinct(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Without key, distinct rows. With key, one row a key: that of the least order (null last), or any.

    The pick is an aggregate, so it is combined before the shuffle and a hot key costs one row a task.
    """
    if not key:
        return df.distinct()
    keys = [F.col(f"`{k}`") for k in key]
    if order is not None and order not in key and set(df.columns) == {*key, order}:  # the row is its key and its order
        least = F.min(F.col(f"`{order}`"))
        return df.groupBy(*keys).agg((by_hash(least) if kind_of(df.schema[order].dataType) in UNSIZED else least).alias(order)).select(*[F.col(f"`{c}`") for c in df.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if order is None:
        best = F.struct(F.any_value(row).alias("row"))
    else:
        best = F.min(F.struct(F.col(f"`{order}`").isNull().alias("none"), F.col(f"`{order}`").alias("by"), row.alias("row")))
    out = df.groupBy(*keys).agg(by_hash(best).alias("best"))
    return out.select(*[F.col("best.row")[c].alias(c) for c in df.columns])
