"""Plans to lazy DataFrames. Types are checked here, before any job runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, ErrorCode
from ..operators.aggregate import aggregate, by_hash
from ..operators.distinct import distinct
from ..sources.scan import scan
from ..types import UNSIZED, Kind, check_schema, kind_of, spark_type
from .spec import Agg, Plan, Stage


def _name(df: DataFrame, col: str | int) -> str:
    """A column's name, by name or position."""
    if isinstance(col, int):
        if not 0 <= col < len(df.columns):
            raise EngineError(ErrorCode.RANGE, f"column {col} of {len(df.columns)}")
        return df.columns[col]
    if col not in df.columns:
        raise EngineError(ErrorCode.UNSUPPORTED, f"no column {col} among {', '.join(df.columns)}")
    return col


def _expression(df: DataFrame, a: Agg):
    if a.col is None:
        return aggregate(a.func, None, None)
    name = _name(df, a.col)
    return aggregate(a.func, F.col(f"`{name}`"), df.schema[name].dataType, a.scale, a.truncate)


def _apart(df: DataFrame, a: Agg) -> bool:
    """Distinct sums and averages of wide decimals: a pair has no distinct aggregate of its own."""
    return a.col is not None and a.func in ("sum_distinct", "avg_distinct") and kind_of(df.schema[_name(df, a.col)].dataType) == Kind.WIDE


def _beside(out: DataFrame, df: DataFrame, key: list[str], a: Agg, name: str) -> DataFrame:
    """out (k0, k1, ...) with a distinct aggregate of a wide decimal: that of the distinct values, joined by the key."""
    values = df.select(*[F.col(f"`{k}`").alias(f"j{i}") for i, k in enumerate(key)], F.col(f"`{_name(df, a.col)}`").alias("v")).distinct()
    one = values.groupBy(*[f"j{i}" for i in range(len(key))]).agg(aggregate(a.func.removesuffix("_distinct"), F.col("v"), values.schema["v"].dataType).alias(name))
    same = reduce(lambda x, y: x & y, [F.col(f"k{i}").eqNullSafe(F.col(f"j{i}")) for i in range(len(key))], F.lit(True))
    return out.join(one, same, "left").drop(*[f"j{i}" for i in range(len(key))])


def _grouped(df: DataFrame, stage: Stage) -> DataFrame:
    key = [_name(df, k) for k in stage.key]
    for k in key:
        kind_of(df.schema[k].dataType)
    written = {a.out: a if _apart(df, a) else _expression(df, a) for a in stage.aggs}  # of several for one column the last counts
    if stage.output is None:
        shape = [(k, None, k) for k in key] + [(a, a, None) for a in written]
    elif stage.output == "input":
        extra = [a for a in written if a not in df.columns]
        if extra:
            raise EngineError(ErrorCode.UNSUPPORTED, f"{', '.join(extra)} isn't among the input's columns")
        shape = [(c, c if c in written else None, c) for c in df.columns]
    else:
        names = [n for n, _ in stage.output]
        if missing := [a for a in written if a not in names]:
            raise EngineError(ErrorCode.UNSUPPORTED, f"{', '.join(missing)} isn't among the output's columns")
        same = len(names) == len(df.columns)
        shape = [(n, n if n in written else None, f.name if same and kind_of(f.dataType) == kind_of(spark_type(t)) else None) for (n, t), f in zip(stage.output, df.schema if same else [None] * len(names))] if same else [(n, n if n in written else None, None) for n in names]
    carried = list(dict.fromkeys(c for _, a, c in shape if a is None and c is not None and c not in key))
    last = {a.out: a for a in stage.aggs}
    sized = [o for o, a in last.items() if key and a.func in ("min", "max") and kind_of(df.schema[_name(df, a.col)].dataType) in UNSIZED]
    aggs = [(by_hash(x) if [o] == sized[:1] else x).alias(f"a{i}") for i, (o, x) in enumerate(written.items()) if not isinstance(x, Agg)]
    if carried:
        row = F.struct(*[F.col(f"`{c}`").alias(c) for c in carried])
        row = F.max_by(row, F.col(f"`{_name(df, stage.order)}`")) if stage.order else F.any_value(row)
        aggs.append((by_hash(row) if key and not sized else row).alias("row"))
    counted = stage.empty_global == "no_row" and not key
    if counted:
        aggs.append(F.count(F.lit(1)).alias("n"))
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("n")]
    out = df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)]).agg(*aggs)
    if counted:
        out = out.filter("n > 0")
    for i, x in enumerate(written.values()):
        if isinstance(x, Agg):
            out = _beside(out, df, key, x, f"a{i}")
    number = {a: i for i, a in enumerate(written)}
    types = dict(stage.output) if isinstance(stage.output, list) else {}
    columns = []
    for n, a, c in shape:
        if a is not None:
            x = F.col(f"a{number[a]}")
        elif c is None:
            x = F.lit(None)
        else:
            x = F.col(f"k{key.index(c)}") if c in key else F.col("row")[c]
        if n in types:
            if a is not None and kind_of(spark_type(types[n])) != kind_of(out.schema[f"a{number[a]}"].dataType):
                raise EngineError(ErrorCode.UNSUPPORTED, f"{n} can't hold its aggregate")
            x = x.cast(spark_type(types[n]))
        columns.append(x.alias(n))
    return out.select(*columns)


def apply_stage(df: DataFrame, stage: Stage) -> DataFrame:
    check_schema(df)
    if stage.distinct:
        if stage.aggs:
            raise EngineError(ErrorCode.UNSUPPORTED, "distinct takes no aggregates")
        out = distinct(df, [_name(df, k) for k in stage.key], stage.order)
    elif stage.key or stage.aggs:
        out = _grouped(df, stage)
    else:
        out = df
    return out.filter(stage.having) if stage.having else out


def compile_plan(plan: Plan, spark: SparkSession) -> DataFrame:
    """The plan as a lazy DataFrame: its scans' union, through the stages from left to right."""
    if not plan.scans:
        raise EngineError(ErrorCode.UNSUPPORTED, "a plan without scans")
    df = reduce(DataFrame.unionAll, [scan(s, spark) for s in plan.scans])
    df = reduce(apply_stage, plan.stages, df)
    if plan.sort:
        df = df.orderBy(*[F.col(f"`{c[1:]}`").desc() if c.startswith("-") else F.col(f"`{c}`") for c in plan.sort])
    return df if plan.limit is None else df.limit(plan.limit)
