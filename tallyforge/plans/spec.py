"""Plans: scans, and stages that group, aggregate, deduplicate and shape."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..types import Kind

Columns = list[tuple[str, "Kind | T.DataType"]]


@dataclass(frozen=True)
class Scan:
    """A source: SQL text, a registered table or a DataFrame. schema: declared columns, checked and cast by position."""

    sql: str | None = None
    table: str | None = None
    frame: DataFrame | None = None
    schema: Columns | None = None


@dataclass(frozen=True)
class Agg:
    """func of column col (a name or a position) as out. count without col counts rows. scale and truncate are avg's."""

    func: str
    col: str | int | None
    out: str
    scale: int | None = None
    truncate: bool = False


@dataclass(frozen=True)
class Stage:
    """key and aggs: a grouped aggregate; aggs alone: a global one; distinct: whole rows or one row a key; none: all rows.

    output: None for key and aggregates; "input" for the input's columns, carried from one row of the group, with
    aggregates written over them by name; or columns: as many as the input's carry the columns of equal type by
    position (null where types differ), any other number is null but for the aggregates.
    order: the column whose greatest value picks the carried row (least with distinct); any row if None.
    having: an SQL condition on the stage's output. empty_global: "row" as in SQL, or "no_row".
    """

    key: list[str | int] = field(default_factory=list)
    aggs: list[Agg] = field(default_factory=list)
    distinct: bool = False
    output: str | Columns | None = None
    order: str | None = None
    having: str | None = None
    empty_global: str = "row"


@dataclass(frozen=True)
class Plan:
    """The union of the scans, through the stages. sort and limit are the client's: columns, "-" for descending."""

    scans: list[Scan]
    stages: list[Stage] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)
    limit: int | None = None
