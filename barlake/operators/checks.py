"""Batch validation: columns, types, values and partition layout."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import any_of, epoch_millis, month_of, year_of
from barlake.tables import TEXT_TYPES, TYPES, WHOLE_RANGES, Table

_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)
_MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)
_TO_NUMBER = (T.NumericType, T.StringType, T.BooleanType, T.NullType)
# wide enough for every whole number, with room for a fraction that must be zero
_EXACT = T.DecimalType(38, 10)


def fits_type(source: T.DataType, declared: str) -> bool:
    """Whether values of the type can be meant for the declared one at all."""
    if declared in TEXT_TYPES:
        return not isinstance(source, _NESTED)
    if declared == "timestamp" and isinstance(source, _MOMENTS):
        return True
    return isinstance(source, _TO_NUMBER)


def _is_moment(source: T.DataType, declared: str) -> bool:
    return declared == "timestamp" and isinstance(source, _MOMENTS)


def column_errors(df: DataFrame, table: Table) -> list[str]:
    """Why the columns of a batch do not fit the table; empty if they do."""
    errors: list[str] = []
    missing = [c for c in table.columns if c not in df.columns]
    if missing:
        errors.append(f"Missing columns: {missing}")
    nested = [f.name for f in df.schema if f.name in table.columns
              and isinstance(f.dataType, _NESTED)]
    if nested:
        errors.append(f"Nested columns: {nested}")
    strange = [f"{f.name} ({f.dataType.simpleString()})" for f in df.schema if f.name in table.columns
               and f.name not in nested and not fits_type(f.dataType, table.columns[f.name])]
    if strange:
        errors.append(f"Columns of a type that does not fit: {strange}")
    return errors


def typed_column(df: DataFrame, name: str, declared: str) -> Column:
    """The column in its declared type; a value that does not fit, and NaN, become null.

    A column the batch does not have is all null.
    """
    target = TYPES[declared]
    if name not in df.columns:
        return F.lit(None).cast(target).alias(name)
    source = df.schema[name].dataType
    value = _without_nan(F.col(name), source)
    if _is_moment(source, declared):
        value = epoch_millis(value, source)
    elif not fits_type(source, declared):
        value = F.lit(None).cast(target)
    elif isinstance(source, T.StringType) and declared in WHOLE_RANGES:
        value = _whole_text(value).try_cast(target)
    elif source != target:
        value = _without_nan(value.try_cast(target), target)
    return value.alias(name)


def _whole_text(text: Column) -> Column:
    """Text as a number that is whole, `1000.0` included; else null."""
    number = F.trim(text).try_cast(_EXACT)
    return F.when(number == F.floor(number), number)


def typed_batch(df: DataFrame, table: Table, extra: Iterable[str] = ()) -> DataFrame:
    """Declared columns in declared types and order, derived partition columns, then `extra`."""
    day = typed_column(df, "date", table.columns["date"]) if table.derived else None
    cut = {"year": year_of, "month": month_of}
    return df.select(*[typed_column(df, c, t) for c, t in table.columns.items()],
                     *[cut[c](day).alias(c) for c in table.derived], *extra)


def bad_name(column: str) -> str:
    return f"__bad_{column}"


def prepared_batch(df: DataFrame, table: Table, extra: Iterable[str] = ()) -> DataFrame:
    """The typed batch with a flag per column whose values may not fit; `extra` columns as they are."""
    flags = [bad.alias(bad_name(c)) for c, bad in cast_failures(df, table).items()]
    void = [c for c in extra if isinstance(df.schema[c].dataType, T.NullType)]
    kept = [F.col(c).cast("string").alias(c) if c in void else F.col(c) for c in extra]
    return typed_batch(df, table, [*kept, *flags])


def cast_failures(df: DataFrame, table: Table) -> dict[str, Column]:
    """Per declared column whose type differs in the batch: does this row's value not fit?

    A fraction does not fit a whole-number type, and neither does a value out of range.
    """
    failures: dict[str, Column] = {}
    for field in df.schema:
        declared = table.columns.get(field.name)
        if declared is None or field.dataType == TYPES[declared] or declared in TEXT_TYPES:
            continue
        if _is_moment(field.dataType, declared):
            continue
        if not fits_type(field.dataType, declared):
            failures[field.name] = F.col(field.name).isNotNull()
            continue
        source = _without_nan(F.col(field.name), field.dataType)
        text = isinstance(field.dataType, T.StringType) and declared in WHOLE_RANGES
        value = (_whole_text(source) if text else source).try_cast(TYPES[declared])
        bad = value.isNull()
        if declared == "uint64":
            low, high = WHOLE_RANGES[declared]
            exact = source.try_cast(T.DecimalType(38, 18))
            bad = bad | (F.lit(False) if text else exact != value) | ~value.between(
                low, F.lit(str(high)).cast("decimal(20,0)"))
        elif declared in WHOLE_RANGES and isinstance(field.dataType, _FRACTIONAL):
            bad = bad | (source != value.cast(field.dataType))
        failures[field.name] = source.isNotNull() & F.coalesce(bad, F.lit(True))
    return failures


def layout_failures(table: Table) -> dict[str, Column]:
    """Checks on typed rows: blank partition text, Year and Month against `date`."""
    failures: dict[str, Column] = {}
    texts = [p for p, t in table.partition_types.items() if t in TEXT_TYPES]
    if texts:
        failures["Blank partition value"] = any_of([F.col(p) == "" for p in texts])
    if table.calendar:
        day = F.col("date")
        agrees = ((F.col("Year").eqNullSafe(year_of(day))) & F.col("Month").eqNullSafe(month_of(day))
                  & (F.substring(day, 5, 1) == "-"))
        failures["Year or Month differs from date"] = day.isNotNull() & ~agrees
    return {reason: F.coalesce(bad, F.lit(False)) for reason, bad in failures.items()}


def type_report(df: DataFrame, table: Table) -> DataFrame:
    """(column, failed): rows per declared column whose value does not fit its type."""
    failures = cast_failures(df, table)
    counts = {c: F.count_if(failures[c]) if c in failures else F.lit(0).cast("long")
              for c in table.columns if c in df.columns}
    return _counts(df, counts, "failed")


def value_report(df: DataFrame, table: Table) -> DataFrame:
    """(column, missing, outside): nulls in required columns, values outside the allowed ones."""
    checked = [c for c in table.columns if c in table.required or c in table.allowed]
    none = F.lit(0).cast("long")
    totals = df.agg(
        *[(F.count_if(F.col(c).isNull()) if c in table.required else none).alias(f"missing {c}")
          for c in checked],
        *[(F.count_if(~F.col(c).isin(list(table.allowed[c]))) if c in table.allowed
           else none).alias(f"outside {c}") for c in checked])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"missing {c}").alias("missing"),
                              F.col(f"outside {c}").alias("outside")) for c in checked])
    return totals.select(F.inline(rows))


def value_failures(table: Table) -> dict[str, Column]:
    """Row checks for required and allowed values, used by writes."""
    failures = {f"Null in required column {c}": F.col(c).isNull() for c in table.required}
    failures |= {f"Value not allowed in column {c}": F.coalesce(~F.col(c).isin(list(v)), F.lit(False))
                 for c, v in table.allowed.items()}
    return failures


def _counts(df: DataFrame, counts: dict[str, Column], name: str) -> DataFrame:
    totals = df.agg(*[count.alias(c) for c, count in counts.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in counts])
    return totals.select(F.inline(rows))


def _without_nan(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value
