"""Checked, partitioned writes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameWriter, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of, rendered_path
from barlake.operators import checks, keys
from barlake.operators.layout import FilePlan, bytes_of_a_row, save_sized, stored_form
from barlake.sources.files import partition_folders, stored_files
from barlake.sources.scan import EXACT_PARTITIONS, in_partitions, read_by_key_hash, read_stored
from barlake.sources.scratch import drop_kept, folder_exists, kept, new_folder, remove_folder, rename_folder
from barlake.tables import Store, Table

# The Parquet codecs Spark knows.
CODECS = ("none", "uncompressed", "snappy", "gzip", "lzo", "brotli", "lz4", "lz4_raw", "zstd")

# Stored files of the touched partitions from this many bytes on are narrowed to what
# the batch can meet before their keys are shuffled.
NARROW_STORED_BYTES = 256 << 20

# Batch keys up to this many bytes, measured in the first pass over the batch, are
# broadcast to such stored rows; beyond it both sides shuffle one row per key. So are
# those that are stored or repeated, to the rows of the batch.
BROADCAST_KEY_BYTES = 64 << 20

# A batch of up to so many rows is looked for through the key filters of the stored files.
FILTERED_KEYS = 1_000

# A write raises the configured number of shuffle partitions no further than this.
MOST_SHUFFLE_PARTITIONS = 10_000

# Files of limited rows that one task makes, where there are more than that.
FILES_OF_A_TASK = 100


@dataclass(frozen=True)
class WriteResult:
    success: bool
    total_rows: int = 0
    partitions_written: int = 0
    paths: list[str] = field(default_factory=list)
    duplicates_found: int = 0
    duplicates_removed: int = 0
    duplicates_in_batch: int = 0
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Route:
    """What one pass over a batch says about it: rows, failed checks, touched partitions."""

    rows: int
    key_bytes: int
    partitions: int
    failures: dict[str, int]
    touched: Column | None  # predicate on partition columns; a superset beyond EXACT_PARTITIONS
    tuples: list[Row]  # the partition tuples
    counts: list[int]  # and their rows
    paths: list[str]


def write_data(store: Store, data: DataFrame, name: str, version: str = "v1",
               mode: str = "append", *, validate_schema: bool = True,
               check_duplicates: bool = True, remove_duplicates: bool = False,
               drop_repeats: bool = False, order: Sequence[str] = (), count_repeats: bool = True,
               extra_columns: bool = False, max_records_per_file: int | None = None,
               max_mb_per_file: float | None = None, spread: bool = True, stage: bool = True) -> WriteResult:
    """Check a batch, match its keys against stored rows, then append or replace partitions.

    The whole batch is checked before anything is written. `append` fails on a
    stored key, or leaves those rows out with `remove_duplicates`. `overwrite`
    replaces exactly the partitions the batch has rows for and checks no keys;
    a table without partitions is exchanged after the new rows are written.

    Repeated keys inside a batch are kept and counted; `drop_repeats` keeps one
    row each, the smallest by the columns of `order` (which may be undeclared,
    and are not stored then) and after that by all columns. A first load of new
    partitions can skip the count, and with it the only shuffle of keys, by
    ``count_repeats=False``.

    The source is read once: its typed rows are written to the shared folder and
    all checks read them there. ``stage=False`` saves that where the source is
    cheap to read again and cannot change between the checks and the write.
    `spread` shuffles rows to their partitions before the write; leave it off
    for input that already lies in partition order.

    `max_mb_per_file` cuts a partition with more into files of key ranges that do not overlap, by the
    bytes that a row took when the batch was staged; it always stages. Partitions with a file that
    comes out too large are cut again by the bytes that were written. A file is seldom larger, and not
    by more than a fifth unless rows of some key ranges take far more bytes than others.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"Unsupported mode: {mode}, expected 'append' or 'overwrite'")
    if store.compression.lower() not in CODECS:
        raise ValueError(f"Unknown compression {store.compression}, expected one of {CODECS}")
    table = store.table(name, version)
    if mode == "overwrite" and not store.allow_overwrite:
        raise PermissionError("Overwriting is switched off for this store")

    errors = checks.column_errors(data, table) if validate_schema else []
    lost = [p for p in table.partitions if p not in data.columns and p not in table.derived]
    if errors or lost:
        if data.isEmpty():
            return WriteResult(True)
        if errors:
            return WriteResult(False, errors=errors)
        raise ValueError(f"Data lacks partition columns: {lost}")
    undeclared = [c for c in data.columns if c not in table.stored_schema.names and c not in order]
    warnings = ([f"Undeclared columns dropped: {undeclared}"]
                if undeclared and not extra_columns else [])
    extra = undeclared if extra_columns else []
    clashes = extra_clashes(store, table, data, extra)
    if clashes:
        return WriteResult(False, warnings=warnings, errors=clashes)

    own_order = [c for c in order if c not in table.stored_schema.names]
    prepared = checks.prepared_batch(data, table, [*extra, *own_order])
    staged = None
    try:
        if stage or max_mb_per_file or (mode == "overwrite" and not table.partitions):  # the last may read what it replaces
            staged = new_folder(store.spark, "stage")
            prepared.write.option("compression", store.compression).parquet(staged)
            prepared = store.spark.read.schema(prepared.schema).parquet(staged)
        return _write(store, table, prepared, mode, extra, own_order, order, warnings,
                      check_duplicates and mode == "append", remove_duplicates, drop_repeats,
                      count_repeats, max_records_per_file, spread, staged, max_mb_per_file)
    finally:
        if staged:
            remove_folder(store.spark, staged.rpartition("/")[0])


def extra_clashes(store: Store, table: Table, data: DataFrame, extra: Sequence[str]) -> list[str]:
    """Undeclared columns that are stored with another type already, in this or a readable older version."""
    found = []
    for version in (table.version, *table.reads) if extra else ():
        stored = read_stored(store, store.table(table.name, version), extra_columns=True).schema
        found += [f"Column {c} is stored as {stored[c].dataType.simpleString()}, "
                  f"not {data.schema[c].dataType.simpleString()}"
                  for c in extra if c in stored.names and stored[c].dataType != data.schema[c].dataType]
    return list(dict.fromkeys(found))


def _write(store: Store, table: Table, prepared: DataFrame, mode: str, extra: list[str], own_order: list[str],
           order: Sequence[str], warnings: list[str], check: bool, remove: bool, drop: bool, count: bool,
           max_records: int | None, spread: bool, staged: str | None, max_mb: float | None) -> WriteResult:
    route = route_prepared(prepared, table)
    if route.rows == 0:
        return WriteResult(True, warnings=warnings)
    if route.failures:
        return WriteResult(False, warnings=warnings, errors=[
            f"{reason}: {rows} rows" for reason, rows in route.failures.items()])

    batch = prepared.select(*table.stored_schema.names, *extra, *own_order)
    folders = touched_folders(store, table, route) if check else []
    size = touched_bytes(store, table, route, folders) if check else 0
    stored = read_touched(store, table, route, folders, batch) if size else None
    if size >= NARROW_STORED_BYTES and not _filters_keys(table, route):
        stored = within_key_bounds(stored, batch, table)
        if route.key_bytes <= BROADCAST_KEY_BYTES:
            stored = keys.shared_keys(batch, stored, table.identity)
    marked = None
    try:
        rows, found, repeated = route.rows, 0, 0
        if stored is not None or drop or (check and count):
            if drop or (remove and stored is not None):
                # written, so that the rows are grouped by key once for the counts and for what is left out
                marked = kept(keys.marked_keys(batch, stored, table.identity))
                counts, number = keys.marked_counts(marked, route.rows)
            else:
                counts, number = keys.count_keys(batch, stored, table.identity), 0
            found, repeated = counts.stored, counts.repeated
            if found and not remove:
                return WriteResult(False, duplicates_found=found, duplicates_in_batch=repeated,
                                   warnings=warnings, errors=[f"Found {found} duplicate rows"])
            single = drop and counts.repeats_left
            if found or single:
                few = number * route.key_bytes <= BROADCAST_KEY_BYTES * route.rows
                batch = keys.without_marked(batch, F.broadcast(marked) if few else marked, table.identity,
                                            drop=single, order=order)
                rows = counts.fresh_keys if single else rows - found
        if rows and max_mb:
            limit = int(max_mb * (1 << 20))
            plan = FilePlan.of_size(table, route.tuples, route.counts, bytes_of_a_row(store, staged, route.rows), limit)
            save_sized(store, table, batch.drop(*own_order), plan, limit, _touched_files(store, table, route) if mode == "overwrite" else None)
        elif rows:
            _save(store, table, batch.drop(*own_order), mode, max_records, route if spread else None)
        return WriteResult(True, rows, route.partitions, route.paths, found, found, repeated,
                           warnings=warnings)
    finally:
        if marked is not None:
            drop_kept(marked)


def route_batch(data: DataFrame, table: Table) -> Route:
    """What one pass over a batch says about it."""
    return route_prepared(checks.prepared_batch(data, table), table)


def route_prepared(batch: DataFrame, table: Table) -> Route:
    """One aggregation over a prepared batch, one row per partition it touches.

    Only counts and sums are taken, which hash-aggregate without sorting the rows. The driver gets
    a row per touched partition, as it does from the write itself.
    """
    failures = {f"Value does not fit type {table.columns[c]} in column {c}": F.col(checks.bad_name(c))
                for c in table.columns if checks.bad_name(c) in batch.columns}
    failures |= checks.layout_failures(table) | checks.value_failures(table)
    # text by its length, anything else by more than its size
    width = reduce(lambda a, b: a + b, [
        F.coalesce(F.octet_length(c), F.lit(0)) + 8 if isinstance(batch.schema[c].dataType, T.StringType)
        else F.lit(16) for c in table.identity])
    counters = [f"failure {i}" for i in range(len(failures))]
    found = (batch.groupBy(*table.partitions).agg(
        F.count("*").alias("rows"), F.sum(width).alias("key bytes"),
        *[F.count_if(bad).alias(c) for c, bad in zip(counters, failures.values())])
        .withColumn("path", rendered_path(table)).where("rows > 0").collect())
    total = {c: sum(t[c] or 0 for t in found) for c in ["rows", "key bytes", *counters]}
    tuples = [Row(*[t[p] for p in table.partitions]) for t in found]
    touched = None
    if table.partitions and len(tuples) > EXACT_PARTITIONS:
        touched = all_of([_bounds(p, _ends_of([t[i] for t in tuples], p)) for i, p in enumerate(table.partitions)])
    elif table.partitions and tuples:
        touched = in_partitions(table.partitions, tuples)
    return Route(total["rows"], total["key bytes"], len(found),
                 {reason: total[c] for c, reason in zip(counters, failures) if total[c]},
                 touched, tuples, [t["rows"] for t in found], sorted(t["path"] for t in found))


def touched_folders(store: Store, table: Table, route: Route) -> list[str] | None:
    """Stored folders of the partitions the batch has rows for; None if they cannot be named."""
    if not table.partitions or len(route.tuples) > EXACT_PARTITIONS:
        return None
    return partition_folders(store, table, route.tuples)


def touched_bytes(store: Store, table: Table, route: Route, folders: list[str] | None = None) -> int:
    """Size of the stored files in the partitions the batch has rows for; 0 if there are none."""
    files = stored_files(store, table, folders)
    if route.touched is not None:
        files = files.where(route.touched)
    return files.agg(F.sum("length")).first()[0] or 0


def _touched_files(store: Store, table: Table, route: Route) -> DataFrame:
    """The stored files of exactly the partitions the batch has rows for."""
    files = stored_files(store, table, touched_folders(store, table, route))
    if not table.partitions:
        return files
    if len(route.tuples) <= EXACT_PARTITIONS:
        return files.where(route.touched)
    schema = T.StructType([f for p in table.partitions for f in table.stored_schema if f.name == p])
    touched = F.broadcast(store.spark.createDataFrame(route.tuples, schema)).alias("touched")
    same = all_of([F.col(f"file.{p}").eqNullSafe(F.col(f"touched.{p}")) for p in table.partitions])
    return files.alias("file").join(touched, same, "left_semi")


def _filters_keys(table: Table, route: Route) -> bool:
    return table.key_filter and route.rows <= FILTERED_KEYS


def read_touched(store: Store, table: Table, route: Route, folders: list[str] | None = None,
                 batch: DataFrame | None = None) -> DataFrame:
    """Stored rows of the partitions the batch has rows for.

    With the `batch`, if it is small and the table has a key filter, only those rows that may have
    one of its keys: their row groups are found by Bloom filters.
    """
    if batch is not None and _filters_keys(table, route):
        hashes = [r[0] for r in batch.select(keys.key_hash(table.identity)).distinct().collect()]  # FILTERED_KEYS at most
        stored = read_by_key_hash(store, table, hashes, folders)
    else:
        stored = read_stored(store, table, folders=folders)
    return stored if route.touched is None else stored.where(route.touched)


def within_key_bounds(stored: DataFrame, batch: DataFrame, table: Table) -> DataFrame:
    """Stored rows whose first key column inside the files lies in the range of the batch.

    Files are sorted by that column, so a batch of one day skips most row groups
    of the month it goes to.
    """
    loose = [c for c in table.key if c not in table.partitions][:1]
    if not loose:
        return stored
    return stored.where(_bounds(loose[0], batch.agg(*_ends(loose)).first()))


def _ends(columns: Sequence[str]) -> list[Column]:
    return [end for c in columns for end in (
        F.min(c).alias(f"low {c}"), F.max(c).alias(f"high {c}"),
        F.count_if(F.col(c).isNull()).alias(f"null {c}"))]


def _ends_of(values: list, column: str) -> dict[str, Any]:
    known = [v for v in values if v is not None]
    return {f"low {column}": min(known, default=None), f"high {column}": max(known, default=None),
            f"null {column}": len(values) - len(known)}


def _bounds(column: str, total: Row | Mapping[str, Any]) -> Column:
    """The values of the column lie between those of the batch, nulls only if it has nulls."""
    low, high, nulls = total[f"low {column}"], total[f"high {column}"], total[f"null {column}"]
    inside = F.col(column).between(F.lit(low), F.lit(high)) if low is not None else F.lit(False)
    return inside | F.col(column).isNull() if nulls else inside


def _dealt_by_files(store: Store, table: Table, batch: DataFrame, route: Route, max_records: int) -> DataFrame:
    """The batch dealt so that each task makes about FILES_OF_A_TASK files of limited rows.

    Rebalancing goes by bytes, and would leave many small files to the few tasks that hold them. Here
    the files of all partitions lie in a row that is cut into tasks: a large partition is dealt over
    several, small ones share one.
    """
    fields = [f for p in table.partitions for f in table.stored_schema if f.name == p]
    rows, first = [], 0
    for values, count in zip(route.tuples, route.counts):
        files = math.ceil(count / max_records)
        rows.append((*values, first, files))
        first += files
    schema = T.StructType([T.StructField(f"p{i}", f.dataType) for i, f in enumerate(fields)]
                          + [T.StructField("first", T.LongType()), T.StructField("files", T.LongType())])
    plan = F.broadcast(store.spark.createDataFrame(rows, schema))  # a row per touched partition
    same = all_of([F.col(f"row.{p}").eqNullSafe(F.col(f"plan.p{i}")) for i, p in enumerate(table.partitions)])
    # by all declared columns, so that rows of one key are dealt too
    turn = F.pmod(F.xxhash64(*[F.col(f"row.`{c}`") for c in table.stored_schema.names]), F.col("plan.files"))
    own = max(FILES_OF_A_TASK, math.ceil(first / MOST_SHUFFLE_PARTITIONS))
    task = F.floor((F.col("plan.first") + turn) / own).cast("int")
    return (batch.alias("row").join(plan.alias("plan"), same).repartitionById(math.ceil(first / own), task)
            .select(*[F.col(f"row.`{c}`") for c in batch.columns]))


def _save(store: Store, table: Table, batch: DataFrame, mode: str, max_records: int | None, route: Route | None) -> None:
    # The rebalance hint brings rows of a partition together; adaptive execution
    # splits shuffle partitions above the advisory size and joins small ones, so
    # neither a hot partition nor many tiny files come out. A few shuffle partitions
    # per table partition keep small ones from sharing the fate of a hot one.
    # Sorting by key keeps the row-group ranges of Parquet narrow, and includes the
    # sort by partition that a partitioned write needs anyway.
    if route and table.partitions and max_records and sum(route.counts) > max_records * FILES_OF_A_TASK:
        batch = _dealt_by_files(store, table, batch, route, max_records)
    elif route and table.partitions:
        configured = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
        shuffled = max(configured, min(4 * route.partitions, MOST_SHUFFLE_PARTITIONS))
        batch = batch.hint("rebalance", shuffled, *table.partitions)
    batch = stored_form(batch, table).sortWithinPartitions(*table.identity)
    writer = table.writer(batch.write.mode(mode), store)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if table.partitions:
        writer = writer.partitionBy(*table.partitions)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
    elif mode == "overwrite":
        return _exchange(store, table, writer)
    writer.parquet(store.location(table))


def _exchange(store: Store, table: Table, writer: DataFrameWriter) -> None:
    """Write next to the stored rows and take their place only when all new rows are there."""
    location = store.location(table)
    beside = f"{location.rpartition('/')[0]}/_{table.version}-{uuid.uuid4().hex}"
    new, old = f"{beside}-new", f"{beside}-old"
    try:
        writer.parquet(new)
    except Exception:
        remove_folder(store.spark, new)
        raise
    replaced = folder_exists(store.spark, location)
    if replaced:
        rename_folder(store.spark, location, old)
    try:
        rename_folder(store.spark, new, location)
    except Exception:
        if replaced:
            rename_folder(store.spark, old, location)
        raise
    if replaced:
        remove_folder(store.spark, old)


def route_preview(data: DataFrame, table: Table) -> DataFrame:
    """Where a batch would go: partition values, rendered path and row count."""
    lost = [p for p in table.partitions if p not in data.columns and p not in table.derived]
    if lost:
        raise ValueError(f"Data lacks partition columns: {lost}")
    counted = (checks.typed_batch(data, table).groupBy(*table.partitions)
               .agg(F.count("*").alias("rows")))
    return counted.withColumn("path", rendered_path(table))
