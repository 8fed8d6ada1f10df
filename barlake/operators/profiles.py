"""Distinct values per column, kept as sketches of each partition and merged without a scan.

A profile lies in a hidden folder of the table: for each partition its rows, a HyperLogLog sketch of
each profiled column, and a stamp of its files (number, bytes, sum of hashes of their paths). An update
reads only partitions whose stamp has changed; merging reads the profile alone. Estimates are off by
less than a hundredth mostly, whatever the number of values; nulls do not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of
from barlake.functions.filters import compile_filters
from barlake.sources.files import stored_files
from barlake.sources.scan import EXACT_PARTITIONS, in_partitions, read_stored
from barlake.sources.scratch import folder_exists, kept, remove_folder, rename_folder
from barlake.tables import Store, Table

# 2^14 registers a sketch: a standard error of 0.8 %, and 16 KB at most.
REGISTERS = 14
STAMP = ["files", "bytes", "names"]


def _folder(store: Store, table: Table) -> str:
    return f"{store.location(table)}/_profile"


def _stored(store: Store, table: Table) -> DataFrame | None:
    folder = _folder(store, table)
    return store.spark.read.parquet(folder) if folder_exists(store.spark, folder) else None


def _sketch(df: DataFrame, name: str) -> Column:
    known = isinstance(df.schema[name].dataType, (T.StringType, T.LongType, T.IntegerType))
    return F.hll_sketch_agg(F.col(name) if known else F.col(name).cast("string"), REGISTERS).alias(f"sketch {name}")


def update_profile(store: Store, name: str, columns: Sequence[str], version: str = "v1") -> int:
    """Bring the profile up to date; the number of partitions that were read for it.

    Partitions that are gone leave the profile; other columns than before make it anew.
    """
    table = store.table(name, version)
    listed = stored_files(store, table).groupBy(*table.partitions).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("names")).where("files > 0")
    old = _stored(store, table)
    if old is not None and {f"sketch {c}" for c in columns} != {c for c in old.columns if c.startswith("sketch ")}:
        old = None
    places = [*table.partitions]
    same = all_of([F.col(f"now.{c}").eqNullSafe(F.col(f"old.{c}")) for c in (*places, *STAMP)])
    stale = listed if old is None else listed.alias("now").join(old.alias("old"), same, "left_anti")
    stale = kept(stale)
    tuples = stale.select(*places).limit(EXACT_PARTITIONS + 1).collect() if places else []
    count = stale.count()
    rows = read_stored(store, table)
    here = all_of([F.col(f"row.{c}").eqNullSafe(F.col(f"now.{c}")) for c in places] or [F.lit(True)])
    if places and len(tuples) <= EXACT_PARTITIONS:
        rows = rows.where(in_partitions(places, tuples)) if tuples else rows.where(F.lit(False))
    elif places:
        rows = rows.alias("row").join(stale.alias("now"), here, "left_semi")
    sketched = rows.groupBy(*places).agg(F.count("*").alias("rows"), *[_sketch(rows, c) for c in columns])
    fresh = sketched.alias("row").join(stale.alias("now"), here).select("row.*", *[f"now.{c}" for c in STAMP])
    if old is not None:
        fresh = fresh.unionByName(old.alias("old").join(listed.alias("now"), same, "left_semi").select(*fresh.columns))
    beside = f"{store.location(table)}/_new-{uuid.uuid4().hex}"
    if count or old is not None:
        fresh.write.parquet(beside)
        remove_folder(store.spark, _folder(store, table))  # a reader finds none for a moment, never a part of one
        rename_folder(store.spark, beside, _folder(store, table))
    return count


def merged_profile(store: Store, name: str, version: str = "v1", filters: Mapping[str, Any] | None = None) -> DataFrame:
    """(column, about): estimated distinct values, over the partitions that filters on them leave."""
    table = store.table(name, version)
    found = _stored(store, table)
    if found is None:
        raise ValueError(f"{name} has no profile yet")
    predicates, _ = compile_filters(table.partition_types, filters or {})
    found = found.where(all_of(predicates)) if predicates else found
    columns = [c.removeprefix("sketch ") for c in found.columns if c.startswith("sketch ")]
    merged = found.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.col(f"`sketch {c}`"))), F.lit(0)).alias(c) for c in columns])
    return merged.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("about")) for c in columns])))
