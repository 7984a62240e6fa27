"""Sources: SQL text over registered tables, Parquet, other databases, and text rows with a declared schema."""

from __future__ import annotations

from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, ErrorCode, engine_error
from ..functions import decimals
from ..types import Kind, check_schema, fitted, kind_of, spark_type, widened

if TYPE_CHECKING:
    from ..plans.spec import Columns, Scan


def register(spark: SparkSession, folder: str, tables: list[str] | None = None) -> None:
    """Parquet tables of a folder as temporary views. Without tables, all of a local folder."""
    names = tables or [p.stem for p in Path(folder).glob("*.parquet")]
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def scan(s: Scan, spark: SparkSession) -> DataFrame:
    """The scan as a DataFrame of supported types. Filters and projections reach the files through Catalyst."""
    if sum(x is not None for x in (s.sql, s.table, s.frame)) != 1:
        raise EngineError(ErrorCode.UNSUPPORTED, "a scan has SQL text, a table or a frame")
    try:
        df = spark.sql(s.sql) if s.sql is not None else spark.table(s.table) if s.table is not None else s.frame
    except Exception as e:
        raise engine_error(e) from e
    check_schema(df)
    return widened(df) if s.schema is None else fitted(df, s.schema)


def database(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A query run by another database, streamed by its cursor; user, password and driver are options."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def ingested(text: Column, kind: Kind | T.DataType, strict: bool = False) -> Column:
    """A text value as another kind. Malformed numbers are null, or an error if strict; dates of year 0 are null."""
    t = spark_type(kind)
    k = kind_of(t)
    if k == Kind.TIMESTAMP:
        zero = text.startswith("0000")
        x = text.cast(t) if strict else text.try_cast(t)
        return F.when(~zero, x)
    if k == Kind.VARBINARY:
        return F.encode(text, "utf-8")
    if k == Kind.WIDE:
        return decimals.parse(text)
    return text.cast(t) if strict else text.try_cast(t)


def from_text(df: DataFrame, schema: Columns, strict: bool = False) -> DataFrame:
    """Text columns, by position, as the declared ones."""
    if len(schema) != len(df.columns):
        raise EngineError(ErrorCode.UNSUPPORTED, f"{len(schema)} columns are declared, the source has {len(df.columns)}")
    return df.select(*[ingested(F.col(f"`{c}`").cast("string"), t, strict).alias(n) for c, (n, t) in zip(df.columns, schema)])
