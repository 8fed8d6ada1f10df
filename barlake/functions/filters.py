"""Filter arguments to typed column predicates.

A filter value is a single value, a list, or a range ``{"start", "end"}`` with
either side optional. Literals are built on the driver in the declared type of
the column, so Spark never coerces a column to meet a literal and every
predicate stays eligible for partition pruning and Parquet pushdown.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.functions.columns import all_of
from barlake.tables import TEXT_TYPES, TYPES, WHOLE_RANGES, Table

# The comparison suffixes a filter name may carry.
SUFFIXES = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "between", "like")

# With these the text stands as it is, whatever signs it holds.
LITERAL = ("gt", "gte", "lt", "lte", "like")

_BEYOND = Decimal(10) ** 40  # outside every whole-number type


def split_name(name: str, fields: Iterable[str]) -> tuple[str, str]:
    """`close__gt` as (`close`, `gt`); a declared name always wins over a suffix."""
    if name in fields or "__" not in name:
        return name, "eq"
    field, suffix = name.rsplit("__", 1)
    return (field, suffix) if suffix in SUFFIXES else (name, "eq")


# What marks a filter argument, and the signs of its compact text.
PREFIX, RANGE_SIGN, LIST_SIGN = "f_", "~", ","


@dataclass(frozen=True)
class Asked:
    """What a filter text asks for: bounds, or the values it lists; a plain text lists itself."""

    low: str | None = None
    high: str | None = None
    listed: tuple[str, ...] | None = None
    plain: bool = False

    @classmethod
    def read(cls, text: str) -> Asked:
        """The grammar: range = [low] "~" [high]; list = item ("," item)*; else the text itself."""
        low, sign, high = text.partition(RANGE_SIGN)
        if sign:
            return cls(low=low or None, high=high or None)
        items = tuple(filter(None, map(str.strip, text.split(LIST_SIGN))))
        return cls(listed=items) if LIST_SIGN in text else cls(listed=(text,), plain=True)

    def value(self) -> Any:
        """As a value of `compile_filters`: text, a list, or a range with the sides it has."""
        if self.listed is None:
            return {k: v for k, v in (("start", self.low), ("end", self.high)) if v is not None}
        return self.listed[0] if self.plain else list(self.listed)


def filter_value(text: str) -> Any:
    """Compact filter text: `a`, `a,b`, `a~b`, `a~` or `~b`."""
    return Asked.read(text).value()


def filter_arguments(args: Mapping[str, str] | Iterable[tuple[str, str]],
                     fields: Iterable[str] | None = None) -> tuple[dict[str, Any], list[str]]:
    """The filters among the arguments, those that carry the prefix, and notes on unusable ones.

    Of a repeated name the last text counts. Without `fields` every name is taken.
    """
    pairs = list(args.items()) if isinstance(args, Mapping) else list(args)
    given = [(name.removeprefix(PREFIX), text) for name, text in pairs if name.startswith(PREFIX)]
    declared = frozenset(fields) if fields is not None else None
    strange = [] if declared is None else [n for n, _ in given if split_name(n, declared)[0] not in declared]
    filters = {name: _read_text(split_name(name, declared or ())[1], text) for name, text in given
               if name not in strange}
    return filters, [f"No column for filter '{name}', it is left out" for name in strange]


def _read_text(suffix: str, text: str) -> Any:
    literal = suffix in LITERAL or (suffix == "ne" and RANGE_SIGN in text)
    return text if literal else filter_value(text)


def compile_filters(fields: Mapping[str, str], filters: Mapping[str, Any]
                    ) -> tuple[list[Column], list[str]]:
    """One predicate per filter, and warnings for filters that were ignored or are empty."""
    predicates: list[Column] = []
    warnings: list[str] = []
    for name, value in filters.items():
        field, suffix = split_name(name, fields)
        if field not in fields:
            warnings.append(f"No column for filter '{field}', it is left out")
            continue
        if isinstance(value, (dict, list, tuple, set)) and not value:
            warnings.append(f"Empty filter on '{field}' matches nothing")
        predicates.append(_predicate(field, fields[field], suffix, value))
    return predicates, warnings


def implied_by_date(table: Table, filters: Mapping[str, Any]) -> list[Column]:
    """What the filters on `date` say about Year and Month, so partitions prune.

    Holds because writes to a calendar table check that Year and Month are the
    parts of `date`, and derived year and month columns are cut from it. Text
    order is kept by cutting a prefix, so ranges carry over as well.
    """
    by_day = "date" in table.partitions
    if table.derived and set(table.derived) == {"year", "month"}:
        year, month = F.col("year"), F.col("month")
    elif table.calendar and not by_day and {"Year", "Month"} <= set(table.partitions):
        year, month = F.col("Year"), F.col("Month")
    else:
        return []
    stored_month = F.concat(year, F.lit("-"), month)
    found: list[Column] = []
    for name, value in filters.items():
        field, suffix = split_name(name, table.columns)
        if field != "date":
            continue
        low, high, listed = sides(suffix, value)
        if listed is not None:
            months = sorted({str(v)[:7] for v in listed if v is not None})
            if len(months) == 1:
                found.append((year == months[0][:4]) & (month == months[0][5:7]))
            elif months:
                found.append(stored_month.isin(months))
        if low is not None:
            found.append(stored_month >= str(low)[:7])
        if high is not None:
            found.append(stored_month <= str(high)[:7])
    return found


def named_partitions(table: Table, filters: Mapping[str, Any], most: int = 1_000) -> list[tuple[str, ...]] | None:
    """Partition tuples the filters name outright by value or list; None if one is left open,
    or if there would be more than `most`.

    Days name their Year and Month too where those are parts of the date.
    """
    listed: dict[str, set[str]] = {}
    for name, value in filters.items():
        field, suffix = split_name(name, table.columns)
        values = sides(suffix, value)[2]
        if values is not None and table.columns.get(field) in TEXT_TYPES:
            listed[field] = {str(v) for v in values if v is not None}
    days = sorted(listed["date"]) if "date" in listed else [None]
    cut: dict[str, Callable[[str], str]] = {}
    if "date" in listed:
        year_month = (("Year", "Month") if table.calendar else ()) + table.derived
        parts = {"year": lambda d: d[:4], "month": lambda d: d[5:7]}
        cut = {"date": str} | {c: parts[c.lower()] for c in year_month}
    others = [p for p in table.partitions if p not in cut]
    texts = all(t in TEXT_TYPES for t in table.partition_types.values())
    if not table.partitions or not texts or any(p not in listed for p in others):
        return None
    if len(days) * math.prod(len(listed[p]) for p in others) > most:
        return None
    named = set()
    for day in days:
        for values in product(*[sorted(listed[p]) for p in others]):
            free = dict(zip(others, values))
            named.add(tuple(free[p] if p in free else cut[p](day) for p in table.partitions))
    return sorted(named)


def day_bounds(table: Table, filters: Mapping[str, Any]) -> tuple[str | None, str | None]:
    """Smallest and largest `date` the filters let through, as far as they say."""
    lows, highs = [], []
    for name, value in filters.items():
        field, suffix = split_name(name, table.columns)
        if field == "date":
            low, high, listed = sides(suffix, value)
            days = [str(v) for v in listed or () if v is not None]
            lows += [str(low)] if low is not None else [min(days)] if days else []
            highs += [str(high)] if high is not None else [max(days)] if days else []
    return max(lows, default=None), min(highs, default=None)


def sides(suffix: str, value: Any) -> tuple[Any, Any, list | None]:
    """(lower bound, upper bound, listed values) of a filter; None where absent."""
    if suffix in ("gt", "gte"):
        return value, None, None
    if suffix in ("lt", "lte"):
        return None, value, None
    if suffix == "between" and not isinstance(value, dict):
        low, high = _pair(value)
        return low, high, None
    if suffix in ("ne", "like"):
        return None, None, None
    if suffix == "in" and isinstance(value, str):
        return None, None, [v.strip() for v in value.split(",") if v.strip()]
    if isinstance(value, dict):
        return value.get("start"), value.get("end"), None
    if isinstance(value, (list, tuple, set)):
        return None, None, list(value)
    return None, None, [value]


def _pair(value: Any) -> tuple[Any, Any]:
    parts = filter_value(value) if isinstance(value, str) else value
    if isinstance(parts, dict):
        return parts.get("start"), parts.get("end")
    if not isinstance(parts, (list, tuple)) or len(parts) != 2:
        raise ValueError(f"between needs two values, got {value!r}")
    return parts[0], parts[1]


def _predicate(field: str, declared: str, suffix: str, value: Any) -> Column:
    column = F.col(field)
    if suffix == "like":
        if declared not in TEXT_TYPES:
            raise ValueError(f"like needs a text column, {field} is {declared}")
        return column.contains(str(value))
    if suffix == "ne":
        listed = value if isinstance(value, (list, tuple, set)) else [value]
        return column.isNotNull() & ~_in_list(column, declared, listed)
    if suffix == "gt":
        return _compare(column, declared, ">", value)
    if suffix == "lt":
        return _compare(column, declared, "<", value)
    low, high, listed = sides(suffix, value)
    if listed is not None:
        return _in_list(column, declared, listed)
    bounds = []
    if low is not None:
        bounds.append(_compare(column, declared, ">=", low))
    if high is not None:
        bounds.append(_compare(column, declared, "<=", high))
    return all_of(bounds) if bounds else F.lit(False)


def _in_list(column: Column, declared: str, values: Iterable[Any]) -> Column:
    literals = [x for x in (_literal(declared, v) for v in values) if x is not None]
    if not literals:
        return F.lit(False)
    return column == literals[0] if len(literals) == 1 else column.isin(literals)


def _literal(declared: str, value: Any) -> Column | None:
    """The value as a literal of the declared type, or None if it can equal nothing."""
    if value is None:
        return None
    if declared in TEXT_TYPES:
        return F.lit(str(value))
    number = _number(value)
    if number is None or number.is_nan():
        return None
    if declared == "bool":
        return F.lit(bool(number)) if number in (0, 1) else None
    if declared in WHOLE_RANGES:
        low, high = WHOLE_RANGES[declared]
        if not low <= number <= high or number != int(number):
            return None
        return _whole(declared, int(number))
    return F.lit(float(number)).cast(TYPES[declared])


def _whole(declared: str, number: int) -> Column:
    return F.lit(Decimal(number) if declared == "uint64" else number).cast(TYPES[declared])


def _number(value: Any) -> Decimal | None:
    if isinstance(value, bool):
        return Decimal(int(value))
    try:
        return Decimal(str(value).strip())
    except InvalidOperation:
        return None


def _compare(column: Column, declared: str, sign: str, value: Any) -> Column:
    if value is None:
        return F.lit(False)
    if declared in TEXT_TYPES:
        return _sign(column, sign, F.lit(str(value)))
    number = _number(value)
    if number is None:
        raise ValueError(f"Not a number: {value!r}")
    if number.is_nan():
        return F.lit(False)
    if declared == "bool":
        holds = [flag for flag in (False, True) if _holds(Decimal(int(flag)), sign, number)]
        return column.isin(holds) if holds else F.lit(False)
    if declared in WHOLE_RANGES:
        return _compare_whole(column, declared, sign, number)
    return _sign(column, sign, F.lit(float(number)).cast(TYPES[declared]))


def _compare_whole(column: Column, declared: str, sign: str, number: Decimal) -> Column:
    """Exact bound on a whole-number column: a fraction moves to the next whole number."""
    low, high = WHOLE_RANGES[declared]
    number = max(min(number, _BEYOND), -_BEYOND)
    if sign in (">", ">="):
        bound = math.floor(number) + 1 if sign == ">" else math.ceil(number)
        if bound > high:
            return F.lit(False)
        return column.isNotNull() if bound <= low else column >= _whole(declared, bound)
    bound = math.ceil(number) - 1 if sign == "<" else math.floor(number)
    if bound < low:
        return F.lit(False)
    return column.isNotNull() if bound >= high else column <= _whole(declared, bound)


def _holds(left: Decimal, sign: str, right: Decimal) -> bool:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[sign]


def _sign(column: Column, sign: str, literal: Column) -> Column:
    return {">": column > literal, ">=": column >= literal,
            "<": column < literal, "<=": column <= literal}[sign]
