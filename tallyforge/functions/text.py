"""Values as text, as a client shows them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Kind, kind_of
from . import decimals, times


def double(x: Column) -> Column:
    """Sixteen digits after the point, of the double's exact value; the JVM formats the shortest digits, so this is a vectorised UDF."""

    @F.pandas_udf("string")
    def sixteen(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else f"{v:.16f}")

    return sixteen(x.cast("double"))


def decimal(x: Column) -> Column:
    """No trailing zeros, but one digit after the point at least."""
    s = x.cast("string")
    s = F.when(F.instr(s, ".") > 0, F.regexp_replace(s, "0+$", "")).otherwise(F.concat(s, F.lit(".")))
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def rendered(df: DataFrame) -> DataFrame:
    """Every column as text; binary values as they are."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        if kind == Kind.DOUBLE:
            c = double(c)
        elif kind == Kind.DECIMAL:
            c = decimal(c)
        elif kind == Kind.WIDE:
            c = decimals.render(c)
        elif kind == Kind.TIMESTAMP and f.dataType.typeName() != "time":
            c = times.render(c.cast("timestamp_ntz"))
        elif kind != Kind.VARBINARY:
            c = c.cast("bigint").cast("string") if kind == Kind.LONG else c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
