"""Scalar expressions used by reads, writes and reports."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.tables import Table


def all_of(conditions: Sequence[Column]) -> Column:
    return _balanced(operator.and_, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return _balanced(operator.or_, conditions)


def _balanced(join: Callable[[Column, Column], Column], conditions: Sequence[Column]) -> Column:
    """Combine by halves, so that a long list makes a shallow expression."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return join(_balanced(join, conditions[:half]), _balanced(join, conditions[half:]))


def epoch_millis(value: Column, dtype: T.DataType) -> Column:
    """Milliseconds since 1970 of a moment; a date is its midnight, and what has no zone is in UTC."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(value)
    day = F.unix_date(value.cast("date")) * F.lit(86_400_000).cast("long")
    if isinstance(dtype, T.DateType):
        return day
    second = F.extract(F.lit("SECOND"), value)  # with its fraction
    return day + F.hour(value) * 3_600_000 + F.minute(value) * 60_000 + F.floor(second * 1000).cast("long")


def year_of(day: Column) -> Column:
    return F.substring(day, 1, 4)


def month_of(day: Column) -> Column:
    return F.substring(day, 6, 2)


def with_calendar(df: DataFrame, day: str = "date") -> DataFrame:
    """Fill Year and Month from a `yyyy-MM-dd` text column."""
    return df.withColumns({"Year": year_of(F.col(day)), "Month": month_of(F.col(day))})


def path_text(value: Column) -> Column:
    """Value as it appears in a path; null becomes empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def rendered_path(table: Table) -> Column:
    """The declared path with every column reference filled in from the row."""
    pieces: list[Column] = []
    for text, column in table.path_parts:
        if text:
            pieces.append(F.lit(text))
        if column:
            pieces.append(path_text(F.col(column)))
    return F.concat(*pieces)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024 * 1024), 2)


def fixed_width_code(code: Column, width: int) -> Column:
    """Left-pad a code with zeros; a longer code is kept whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def day_text(value: Column, pattern: str) -> Column:
    """Text in `pattern` (or a date) as `yyyy-MM-dd`; unreadable text becomes null."""
    return F.try_to_date(value, pattern).cast("string")


def time_text(value: Column, pattern: str) -> Column:
    return F.date_format(F.try_to_timestamp(value, F.lit(pattern)), "HH:mm")


def cleaned(df: DataFrame, *, codes: dict[str, int] | None = None,
            days: dict[str, str] | None = None, times: dict[str, str] | None = None,
            drop_nulls: list[str] | bool = False) -> DataFrame:
    """Optional tidy-up before a write: pad codes, format days and times, drop nulls.

    `codes` maps a column to its width, `days` and `times` map a column to the
    pattern its text is in now.
    """
    changes = {c: fixed_width_code(F.col(c), w) for c, w in (codes or {}).items()}
    changes |= {c: day_text(F.col(c), p) for c, p in (days or {}).items()}
    changes |= {c: time_text(F.col(c), p) for c, p in (times or {}).items()}
    if changes:
        df = df.withColumns(changes)
    if drop_nulls:
        df = df.dropna(subset=None if drop_nulls is True else list(drop_nulls))
    return df
