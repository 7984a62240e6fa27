"""The engine's value kinds, and what each aggregate accepts."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError, ErrorCode


class Kind(Enum):
    LONG = "long"
    DOUBLE = "double"
    DECIMAL = "decimal"
    WIDE = "wide decimal"
    TIMESTAMP = "timestamp"
    VARCHAR = "varchar"
    VARBINARY = "varbinary"


#: A decimal of 35 digits before and 30 after the point (functions/decimals.py).
WIDE_TYPE = T.StructType([T.StructField("hi", T.DecimalType(35, 0)), T.StructField("lo", T.DecimalType(30, 30))])

_KINDS = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType), Kind.LONG),
    ((T.FloatType, T.DoubleType), Kind.DOUBLE),
    ((T.DecimalType,), Kind.DECIMAL),
    ((T.TimestampNTZType, T.TimestampType, T.DateType, T.TimeType), Kind.TIMESTAMP),
    ((T.StringType,), Kind.VARCHAR),
    ((T.BinaryType,), Kind.VARBINARY),
)

#: Spark's type for each kind where none is given.
DEFAULT = {
    Kind.LONG: T.LongType(),
    Kind.DOUBLE: T.DoubleType(),
    Kind.DECIMAL: T.DecimalType(38, 10),
    Kind.WIDE: WIDE_TYPE,
    Kind.TIMESTAMP: T.TimestampNTZType(),
    Kind.VARCHAR: T.StringType(),
    Kind.VARBINARY: T.BinaryType(),
}


#: Bytes of a value, as Spark's unsafe rows hold it; texts and binary values have any length.
LENGTH = {Kind.LONG: 8, Kind.DOUBLE: 8, Kind.DECIMAL: 16, Kind.WIDE: 32, Kind.TIMESTAMP: 8, Kind.VARCHAR: None, Kind.VARBINARY: None}
#: Kinds that Spark can't keep in a hash table of rows.
UNSIZED = frozenset({Kind.VARCHAR, Kind.VARBINARY, Kind.WIDE})


def is_wide(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and [(f.name, f.dataType) for f in t] == [(f.name, f.dataType) for f in WIDE_TYPE]


def kind_of(t: T.DataType) -> Kind:
    if is_wide(t):
        return Kind.WIDE
    for types, kind in _KINDS:
        if isinstance(t, types):
            return kind
    raise EngineError(ErrorCode.UNSUPPORTED, f"values of type {t.simpleString()}")


def spark_type(kind: Kind | T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else DEFAULT[kind]


_ALL = frozenset(Kind)
_ORDERED = _ALL - {Kind.VARBINARY}
_NUMERIC = frozenset({Kind.LONG, Kind.DOUBLE, Kind.DECIMAL, Kind.WIDE})
#: By aggregate, the kinds it takes.
ACCEPTS = {
    "min": _ORDERED,
    "max": _ORDERED,
    "sum": _NUMERIC | {Kind.VARCHAR},
    "sum_distinct": _NUMERIC | {Kind.VARCHAR},
    "avg": _NUMERIC,
    "avg_distinct": _NUMERIC,
    "count": _ALL,
    "count_distinct": _ALL,
}


def check_aggregate(func: str, t: T.DataType) -> Kind:
    if func not in ACCEPTS:
        raise EngineError(ErrorCode.UNSUPPORTED, f"function {func}")
    kind = kind_of(t)
    if kind not in ACCEPTS[func]:
        raise EngineError(ErrorCode.UNSUPPORTED, f"{func} of {kind.value}")
    return kind


def check_schema(df: DataFrame) -> None:
    """Every column must be of a supported kind."""
    for f in df.schema:
        kind_of(f.dataType)


def widened(df: DataFrame) -> DataFrame:
    """Small integers and booleans as long, float as double."""
    return df.select(*[F.col(f"`{f.name}`").cast(DEFAULT[k]).alias(f.name) if (k := kind_of(f.dataType)) in (Kind.LONG, Kind.DOUBLE) else F.col(f"`{f.name}`") for f in df.schema])


def fitted(df: DataFrame, declared: list[tuple[str, Kind | T.DataType]]) -> DataFrame:
    """df as the declared columns, by position: a column of another kind is refused, one of the same kind is cast."""
    if len(declared) != len(df.columns):
        raise EngineError(ErrorCode.UNSUPPORTED, f"{len(declared)} columns are declared, the source has {len(df.columns)}")
    out = []
    for f, (name, t) in zip(df.schema, declared):
        t = spark_type(t)
        if kind_of(f.dataType) != kind_of(t):
            raise EngineError(ErrorCode.UNSUPPORTED, f"column {f.name} is {f.dataType.simpleString()}, {t.simpleString()} is declared")
        out.append(F.col(f"`{f.name}`").cast(t).alias(name))
    return df.select(*out)
