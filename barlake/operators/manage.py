"""Partition listing, coverage and deletion."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barlake.functions.columns import all_of
from barlake.functions.filters import compile_filters, split_name
from barlake.sources.files import footers, stored_files, stored_partitions
from barlake.sources.scan import read_data, read_stored, selected_folders
from barlake.sources.scratch import folder_exists, remove_folder
from barlake.tables import Store

DELETING_THREADS = 16


def partitions(store: Store, name: str, version: str = "v1",
               filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Files and bytes per stored partition; filters on partition columns prune the listing."""
    table = store.table(name, version)
    files = stored_files(store, table)
    predicates, _ = compile_filters(table.partition_types, filters or {})
    if predicates:
        files = files.where(all_of(predicates))
    return files.groupBy(*table.partitions).agg(F.count("*").alias("files"),
                                                F.sum("length").alias("bytes"))


def partition_counts(store: Store, name: str, version: str = "v1") -> DataFrame:
    """Rows per stored partition."""
    table = store.table(name, version)
    return (read_stored(store, table).groupBy(*table.partitions)
            .agg(F.count("*").alias("rows")))


def mark_existing(store: Store, wanted: DataFrame, name: str, version: str = "v1",
                  within: Column | None = None) -> DataFrame:
    """The wanted partition tuples with a flag `present`; null matches null.

    `wanted` holds some or all partition columns of the table. Where they are known to lie
    `within` a predicate on partition columns, it prunes the listing.
    """
    table = store.table(name, version)
    shared = [p for p in table.partitions if p in wanted.columns]
    if not shared:
        raise ValueError(f"Name at least one partition column of {table.partitions}")
    stored = stored_partitions(store, table)
    if within is not None:
        stored = stored.where(within)
    found = stored.select(*shared).distinct().withColumn("present", F.lit(True))
    same = all_of([F.col(f"wanted.{p}").eqNullSafe(F.col(f"found.{p}")) for p in shared])
    return (wanted.alias("wanted").join(found.alias("found"), same, "left")
            .select("wanted.*", F.coalesce("found.present", F.lit(False)).alias("present")))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end as `yyyy-MM-dd` text; none if start is after end."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = spark.range(0, max((last - first).days + 1, 0))
    return days.select(F.date_add(F.lit(first), F.col("id").cast("int")).cast("string").alias("date"))


def calendar_coverage(store: Store, name: str, start: str, end: str,
                      version: str = "v1") -> DataFrame:
    """Days of a range with a flag whether rows are stored for them.

    Answered from the file listing where `date` is a partition column, else from
    the `date` column alone, read for the months of the range.
    """
    table = store.table(name, version)
    days = calendar(store.spark, start, end)
    if "date" in table.partitions:
        return mark_existing(store, days, name, version, F.col("date").between(start, end))
    found = (read_data(store, name, version, date={"start": start, "end": end}, columns=["date"])
             .distinct().withColumn("present", F.lit(True)))
    return (days.join(found, "date", "left")
            .select("date", F.coalesce("present", F.lit(False)).alias("present")))


@dataclass(frozen=True)
class DeleteResult:
    partitions_deleted: int = 0
    files_deleted: int = 0
    rows_deleted: int = 0
    filters: dict[str, Any] = field(default_factory=dict)
    errors: list[dict[str, str]] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)  # removed folders with files whose rows nobody could count


def delete_partitions(store: Store, name: str, version: str = "v1", *,
                      filters: Mapping[str, Any] | None = None, **more: Any) -> DeleteResult:
    """Remove the partitions whose values meet all filters.

    Only partition columns may be filtered, so a partition goes whole or stays
    whole. The predicate runs on the listing, rows are counted from footers, so
    files that cannot be read go like all others. A folder the file system does
    not remove is an error. Only folder names come to the driver.
    """
    if not store.allow_delete:
        raise PermissionError("Deleting is switched off for this store")
    table = store.table(name, version)
    wanted = {**(filters or {}), **more}
    if not wanted:
        raise ValueError("Deleting needs at least one filter")
    other = [f for f in wanted if split_name(f, table.partition_types)[0] not in table.partitions]
    if other:
        raise ValueError(f"Deleting takes partition columns only, not {other}")
    predicates, warnings = compile_filters(table.partition_types, wanted)
    if warnings:
        raise ValueError("; ".join(warnings))
    chosen = all_of(predicates)

    folder = F.regexp_replace("path", "/[^/]*$", "")
    listed = stored_files(store, table, selected_folders(store, table, wanted)).where(chosen)
    folders = (footers(listed).groupBy(folder.alias("folder"))
               .agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("error").alias("error")))

    def remove(found: Row) -> tuple[Row, str | None]:
        try:
            if remove_folder(store.spark, found["folder"]) or not folder_exists(store.spark, found["folder"]):
                return found, None
            return found, "The file system refused to remove the folder"
        except Exception as problem:  # the other partitions are still removed
            return found, str(problem)

    deleted, files, rows, errors, unreadable = 0, 0, 0, [], []
    with ThreadPoolExecutor(DELETING_THREADS) as pool:  # folder names come a few at a time
        for found, problem in pool.map(remove, folders.toLocalIterator()):
            if problem:
                errors.append({"folder": found["folder"], "error": problem})
                continue
            deleted, files, rows = deleted + 1, files + found["files"], rows + (found["rows"] or 0)
            if found["error"]:
                unreadable.append(found["folder"])
    return DeleteResult(deleted, files, rows, wanted, errors, unreadable)
