"""Aggregates as expressions, with the engine's rules on types, nulls and overflow."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, ErrorCode
from ..functions import decimals
from ..types import Kind, check_aggregate, kind_of

INF = float("inf")


def _finite(x: Column) -> Column:
    """x, or an error where it is infinite."""
    return F.when(F.abs(x) == INF, F.raise_error(F.lit("DOUBLE_OVERFLOW: a sum of doubles overflowed")).cast("double")).otherwise(x)


def as_decimal(c: Column, t: T.DataType) -> Column:
    """A number as decimal, for averages: integers with 4 more digits, doubles with 12."""
    kind = kind_of(t)
    if kind == Kind.LONG:
        return c.cast("bigint").cast("decimal(20,0)")
    return c.cast("decimal(34,12)") if kind == Kind.DOUBLE else c


def truncated(total: Column, count: Column, scale: int) -> Column:
    """total / count cut toward zero after scale digits (18 at most), exactly: what isn't a multiple of count units is taken off first."""
    if not 0 <= scale <= 18:
        raise EngineError(ErrorCode.RANGE, f"{scale} digits")
    wide = f"decimal(37,{max(10, scale)})"  # a difference takes one digit more
    n = count.cast("decimal(19,0)")
    unit = (n * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")).cast(wide)
    whole = total.cast(wide) - (total.cast(wide) % unit).cast(wide)
    return (whole / n).cast(f"decimal(38,{scale})")


def by_hash(a: Column) -> Column:
    """The aggregate a, grouped by hash though its values have no fixed size (text, rows), for which Spark would sort all input.

    The list of no values beside it has a buffer of objects, so Spark keeps the groups in a map of objects and only
    sorts from HASHED groups a task on (session.py).
    """
    return F.when(F.size(F.collect_list(F.lit(None).cast("int"))) == 0, a)


def aggregate(func: str, c: Column | None, t: T.DataType | None, scale: int | None = None, truncate: bool = False) -> Column:
    """The expression of an aggregate of a column of type t.

    Nulls are skipped. Sums of longs and decimals raise on overflow (the session is in ANSI mode), those of doubles
    where they become infinite; a sum of texts is null. Averages are decimals, rounded half up four digits past the
    input's, or to scale digits, or cut there; those of wide decimals are wide and cut after the 30th digit.
    """
    if c is None:
        if func != "count":
            raise EngineError(ErrorCode.UNSUPPORTED, f"{func} needs a column")
        return F.count(F.lit(1))
    kind = check_aggregate(func, t)
    c = c.cast("bigint") if isinstance(t, T.BooleanType) else c
    if func == "count":
        return F.count(c)
    if func == "count_distinct":
        return F.count_distinct(c)
    if func in ("min", "max"):
        return getattr(F, func)(c)
    distinct = func.endswith("_distinct")
    if kind == Kind.WIDE:
        if distinct:
            raise EngineError(ErrorCode.UNSUPPORTED, f"{func} of wide decimals beside other aggregates")
        return decimals.total(c) if func == "sum" else decimals.average(c)
    if func.startswith("sum"):
        if kind == Kind.VARCHAR:
            return F.max(F.lit(None).cast("string"))
        total = F.sum_distinct(c) if distinct else F.sum(c)
        return _finite(total) if kind == Kind.DOUBLE else total
    d = as_decimal(c, t)
    if truncate:
        total, count = (F.sum_distinct(d), F.count_distinct(d)) if distinct else (F.sum(d), F.count(d))
        return F.when(count > 0, truncated(total, F.when(count > 0, count), 10 if scale is None else scale))
    mean = F.try_divide(F.sum_distinct(d), F.count_distinct(d).cast("decimal(20,0)")) if distinct else F.avg(d)
    return mean if scale is None else mean.cast(T.DecimalType(38, scale))
