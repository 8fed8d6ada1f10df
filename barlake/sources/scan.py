"""Reads of stored tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of, any_of
from barlake.functions.filters import (compile_filters, day_bounds, filter_arguments, implied_by_date,
                                       named_partitions)
from barlake.sources.files import month_folders, partition_folders
from barlake.tables import KEY_HASH, TYPES, Store, Table

# Beyond this many touched partitions a read is bounded by the smallest and
# largest value of each partition column instead of by exact tuples.
EXACT_PARTITIONS = 1_000

# Up to this many partitions that filters name outright are looked up by folder,
# so that a point read does not list the whole table.
NAMED_FOLDERS = 100


def read_stored(store: Store, table: Table, extra_columns: bool = False,
                folders: Sequence[str] | None = None) -> DataFrame:
    """All stored rows, declared and derived columns; no rows where nothing is stored yet.

    The declared schema is always passed, so partition values such as "05" stay
    text and a column a file lacks reads as null. With `extra_columns` the
    undeclared columns of the files follow the declared ones. `folders` names the
    only partition folders to list and read.
    """
    schema = table.stored_schema
    location = store.location(table)
    if folders is not None and not folders:
        return store.spark.createDataFrame([], schema)
    try:
        if extra_columns:
            merged = (store.spark.read.option("mergeSchema", True).option("basePath", location)
                      .parquet(*(folders or [location])).schema)
            schema = T.StructType(schema.fields + [f for f in merged if f.name not in (*schema.names, KEY_HASH)])
        return (store.spark.read.schema(schema).option("basePath", location)
                .parquet(*(folders or [location])).select(*schema.names))
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return store.spark.createDataFrame([], table.stored_schema)


def read_by_key_hash(store: Store, table: Table, hashes: Sequence[int], folders: Sequence[str] | None = None) -> DataFrame:
    """Stored rows of a table with a key filter that may have a key of these hashes.

    Row groups whose Bloom filter has none of them are not read. Rows stored without hash all come: a
    scan of their own, which skips files where every row has one by their statistics.
    """
    location = store.location(table)
    if folders is not None and not folders:
        return store.spark.createDataFrame([], table.stored_schema)
    schema = T.StructType([*table.stored_schema, T.StructField(KEY_HASH, T.LongType())])
    try:
        stored = store.spark.read.schema(schema).option("basePath", location).parquet(*(folders or [location]))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return store.spark.createDataFrame([], table.stored_schema)
    # two scans, since a condition that joins both with "or" lets no filter skip a row group
    return (stored.where(F.col(KEY_HASH).isin([int(h) for h in hashes]))
            .unionAll(stored.where(F.col(KEY_HASH).isNull())).select(*table.stored_schema.names))


def read_files(store: Store, table: Table, paths: Sequence[str] | None) -> DataFrame:
    """All rows of the named files, or of all, with their undeclared columns."""
    return read_stored(store, table, extra_columns=True, folders=paths)


def read_data(store: Store, name: str, version: str = "v1", *,
              filters: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None,
              extra_columns: bool = False, **more: Any) -> DataFrame:
    """Rows that meet all filters; each stored row once, in no particular order.

    ``read_data(store, "stock_5min", date={"start": "2026-05-15"}, market=["XHKG"])``.
    Filters on columns the table does not have are ignored.
    """
    return _read(store, store.table(name, version), {**(filters or {}), **more},
                 columns, extra_columns)[0]


def query_data(store: Store, name: str, version: str = "v1",
               args: Mapping[str, str] | Iterable[tuple[str, str]] = (), *,
               columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows for `f_` text arguments, and the warnings for those that were ignored.

    ``query_data(store, "stock_5min", args={"f_date": "2026-05-15", "f_close": "400~"})``.
    """
    table = store.table(name, version)
    filters, dropped = filter_arguments(args, table.columns)
    df, warnings = _read(store, table, filters, columns, False)
    return df, dropped + warnings


def _read(store: Store, table: Table, filters: Mapping[str, Any],
          columns: Sequence[str] | None, extra_columns: bool) -> tuple[DataFrame, list[str]]:
    df = stored_versions(store, table, filters, extra_columns)
    fields = dict(table.columns)
    if extra_columns:
        fields |= {f.name: t for f in df.schema for t, spark_type in TYPES.items()
                   if f.name not in fields and f.name not in table.derived
                   and f.dataType == spark_type}
    predicates, warnings = compile_filters(fields, filters)
    predicates += implied_by_date(table, filters)
    if predicates:
        df = df.where(all_of(predicates))
    shown = list(columns) if columns else [c for c in df.columns if c not in table.derived]
    return df.select(*shown), warnings


def stored_versions(store: Store, table: Table, filters: Mapping[str, Any],
                    extra_columns: bool = False) -> DataFrame:
    """Rows of this version and of the versions it declares it can read; new columns are null.

    The filters only narrow down the folders; the caller still has to apply them. With
    `extra_columns` the undeclared columns of all versions follow.
    """
    df = read_stored(store, table, extra_columns, selected_folders(store, table, filters))
    for version in table.reads:
        older = store.table(table.name, version)
        rows = read_stored(store, older, extra_columns, selected_folders(store, older, filters))
        if not extra_columns:
            rows = rows.select(*[c for c in (*older.columns, *older.derived) if c in df.columns])
        df = df.unionByName(rows, allowMissingColumns=True)
    return df


def selected_folders(store: Store, table: Table, filters: Mapping[str, Any]) -> list[str] | None:
    """The only folders that can hold rows the filters let through; None to list the whole table.

    Partitions that are named outright are looked up one by one; for bounds on `date` the Year
    and Month levels are listed, and only the months within the bounds below them.
    """
    tuples = named_partitions(table, filters, NAMED_FOLDERS)
    if tuples is not None:
        return partition_folders(store, table, tuples)
    first, last = day_bounds(table, filters)
    if not table.partitions or tuple(c.lower() for c in table.partitions[:2]) != ("year", "month"):
        return None
    if not (table.calendar or table.derived) or (first is None and last is None):
        return None
    return month_folders(store, table, first, last)


def in_partitions(columns: Sequence[str], tuples: Sequence[Row]) -> Column:
    """Predicate that holds for exactly these partition tuples; null is a value like any other.

    Tuples sharing a value are grouped, starting with the column of fewest
    values, so Year, Month, date becomes one short list of dates per month.
    """
    at = min(range(len(columns)), key=lambda i: len({t[i] for t in tuples}))
    first, rest = columns[at], [*columns[:at], *columns[at + 1:]]
    groups: dict[Any, list[tuple]] = {}
    for values in tuples:
        groups.setdefault(values[at], []).append((*values[:at], *values[at + 1:]))
    if not rest:
        present = [v for v in groups if v is not None]
        either = [F.col(first).isin(present)] if present else []
        return any_of(either + ([F.col(first).isNull()] if None in groups else []))
    return any_of([F.col(first).eqNullSafe(F.lit(value)) & in_partitions(rest, members)
                   for value, members in groups.items()])
