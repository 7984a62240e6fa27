"""Timestamps: packed decimal digits, and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, ErrorCode


def packed(ts: Column, millis: bool = True) -> Column:
    """A timestamp as the number YYYYMMDDhhmmssmmm; milliseconds 0 unless millis."""
    if millis:
        return F.date_format(ts, "yyyyMMddHHmmssSSS").cast("bigint")
    return F.date_format(ts, "yyyyMMddHHmmss").cast("bigint") * 1000


def unpacked(n: Column) -> Column:
    """Its inverse; 0 and numbers that are no time are null."""
    s = F.lpad(n.cast("string"), 17, "0")
    text = F.concat_ws("", F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2), F.lit(" "), F.substring(s, 9, 2), F.lit(":"), F.substring(s, 11, 2), F.lit(":"), F.substring(s, 13, 2), F.lit("."), F.substring(s, 15, 3))
    return F.when(~s.startswith("0000"), text.try_cast("timestamp_ntz"))


def parse(text: Column) -> Column:
    """Date, date and time, or date and time with milliseconds; of year 0 or malformed: null."""
    return F.when(~text.startswith("0000") & F.length(text).isin(10, 19, 23), text.try_cast("timestamp_ntz"))


MODES = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "seconds": "yyyy-MM-dd HH:mm:ss", "millis": "yyyy-MM-dd HH:mm:ss.SSS"}


def render(ts: Column, mode: str | None = None) -> Column:
    """By mode: date, time, date and time to the second, or with milliseconds. Without: the date alone at midnight, else date and time to the second with .0."""
    if mode is not None:
        if mode not in MODES:
            raise EngineError(ErrorCode.RANGE, f"mode {mode}")
        return F.date_format(ts, MODES[mode])
    midnight = F.date_format(ts, "HHmmss") == "000000"
    return F.when(midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".0")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is."""
    return F.when(a < b, F.lit(-1)).when(a == b, F.lit(0)).when(a > b, F.lit(1))
