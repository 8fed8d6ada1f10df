"""Files of a wanted size: key ranges inside a partition, and compaction of small files.

Rows are cut into ranges of their key by boundaries from a sample, one file for each range, and
written to a folder beside the stored ones that no reader sees. Only when all files are there and
complete, a mark is set and they take their place, partition by partition, the files they replace
going first. `finish_exchanges` completes or undoes what a lost driver left behind, so an exchange
happens as a whole or not at all. A reader that lists a partition in the moment of its exchange may
miss rows; like all writes this is for one writer at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of
from barlake.functions.filters import compile_filters
from barlake.operators import keys
from barlake.sources.files import LISTING, footers, stored_files
from barlake.sources.scan import read_files, selected_folders
from barlake.sources.scratch import (child_folders, folder_bytes, folder_exists, kept, make_folder, remove_folder,
                                     rename_folder)
from barlake.tables import KEY_HASH, Store, Table

# Keys sampled for each file to come: its size is then off by a twentieth, seldom by more than a tenth.
SAMPLED_KEYS = 400
# A range is aimed at this part of the limit, so that a file above it is rare.
AIMED = 0.92
# A file with more rows than a range and this part of it is split, as where one key fills several files.
SPLIT_ABOVE = 1.2
# A partition with a file beyond that part of the limit is staged again, at most so often, if its bytes call for more files.
STAGED_AGAIN = 3
# Boundaries are looked up in two steps, the first one over every so many.
RUNG = 64
# Boundaries up to this many bytes are broadcast to the rows.
BROADCAST_BOUNDS_BYTES = 64 << 20
# Small files that one job of a compaction rewrites; their names pass the driver.
FILES_AT_ONCE = 10_000
EXCHANGING_THREADS = 16
MOST_FILE_TASKS = 20_000

_STAGING = "_exchange-"


@dataclass(frozen=True)
class FilePlan:
    """Files each partition shall have: (partition values, rows, files)."""

    table: Table
    entries: list[tuple[Sequence, int, int]]

    @classmethod
    def of_size(cls, table: Table, tuples: Sequence[Sequence], rows: Sequence[int], row_bytes: float, limit: int) -> FilePlan:
        most = max(1.0, AIMED * limit / max(row_bytes, 1e-9))
        return cls(table, [(t, n, max(1, math.ceil(n / most))) for t, n in zip(tuples, rows)])

    def closer(self, sizes: Mapping[tuple, Row], limit: int) -> FilePlan:
        """The partitions with a file that came out too large, with the files that their written bytes call for."""
        found = []
        for t, n, files in self.entries:
            seen = sizes.get(tuple(t))
            if seen is None or seen["largest"] <= SPLIT_ABOVE * limit:
                continue
            wanted = math.ceil(seen["bytes"] / (AIMED * limit))
            if wanted > files:
                found.append((t, n, wanted))
        return FilePlan(self.table, found)

    @property
    def files(self) -> int:
        return sum(files for _, _, files in self.entries)

    @property
    def rows_of_a_file(self) -> int:
        return max((math.ceil(rows / files) for _, rows, files in self.entries), default=1)

    def several(self, store: Store) -> DataFrame:
        """(partition columns, share of rows to sample, files) of the partitions with several files."""
        fields = [f for p in self.table.partitions for f in self.table.stored_schema if f.name == p]
        schema = T.StructType([T.StructField(f"p{i}", f.dataType) for i, f in enumerate(fields)] + [
            T.StructField("share", T.DoubleType()), T.StructField("files", T.IntegerType())])
        rows = [(*t, min(1.0, SAMPLED_KEYS * files / max(rows, 1)), files) for t, rows, files in self.entries if files > 1]
        return store.spark.createDataFrame(rows, schema)


def _key(df: DataFrame, table: Table) -> Column:
    """What orders the rows inside a partition: the key without partition columns, else all columns of the file."""
    loose = [c for c in table.identity if c not in table.partitions]
    return F.struct(*(loose or [c for c in df.columns if c not in table.partitions]))


def _same_partition(table: Table, left: str, right: str) -> Column:
    return all_of([F.col(f"{left}.{p}").eqNullSafe(F.col(f"{right}.p{i}")) for i, p in enumerate(table.partitions)]
                  or [F.lit(True)])


def range_bounds(store: Store, rows: DataFrame, plan: FilePlan) -> DataFrame:
    """(partition columns p0, p1, ..., bounds): the least keys of all files of a partition but the first."""
    table = plan.table
    names = [f"p{i}" for i in range(len(table.partitions))]
    wanted = F.broadcast(plan.several(store))  # a row per partition of the plan, which the driver holds
    keyed = rows.select(*table.partitions, _key(rows, table).alias("key"))
    sample = (keyed.alias("row").join(wanted.alias("plan"), _same_partition(table, "row", "plan"))
              .where(F.rand(17) < F.col("share")).select(*names, "key", "files"))
    order = Window.partitionBy(*names).orderBy("key")
    at = F.row_number().over(order) - 1
    file = F.floor(at * F.col("files") / F.count("*").over(Window.partitionBy(*names)))
    ranked = sample.withColumn("file", file).withColumn("before", F.lag("file", 1, 0).over(order))
    return ranked.where("file != before").groupBy(*names).agg(
        F.array_distinct(F.array_sort(F.collect_list("key"))).alias("bounds"))


def _rungs(bounds: Column) -> Column:
    return F.filter(bounds, lambda _, i: i % RUNG == 0)


def _range_of(bounds: Column, key: Column, rungs: Column | None = None) -> Column:
    """Number of bounds up to the key, found among every RUNG-th and then among those that follow it."""
    up_to = F.size(F.filter(_rungs(bounds) if rungs is None else rungs, lambda b: b <= key))
    # the number of rungs is an argument of the lambda, so that it is found once a row
    after = F.transform(F.array(up_to), lambda n: F.when(n > 0, (n - 1) * RUNG + F.size(
        F.filter(F.slice(bounds, (n - 1) * RUNG + 1, F.lit(RUNG)), lambda b: b <= key))).otherwise(0))
    return F.when(bounds.isNull(), 0).otherwise(after[0]).cast("int")


def with_ranges(store: Store, rows: DataFrame, plan: FilePlan, name: str) -> DataFrame:
    """The rows with the number of their file inside the partition as column `name`."""
    table = plan.table
    if all(files == 1 for _, _, files in plan.entries):
        return rows.withColumn(name, F.lit(0))
    bounds = kept(range_bounds(store, rows, plan).withColumn("rungs", _rungs(F.col("bounds"))))
    size = bounds.agg(F.sum(F.octet_length(F.to_json(F.struct("bounds"))))).first()[0] or 0
    if size <= BROADCAST_BOUNDS_BYTES:
        bounds = F.broadcast(bounds)
    keyed = rows.withColumn(name, _key(rows, table))
    return (keyed.alias("row").join(bounds.alias("bound"), _same_partition(table, "row", "bound"), "left")
            .select(*[f"row.`{c}`" for c in rows.columns], _range_of(F.col("bound.bounds"), F.col(f"row.{name}"), F.col("bound.rungs")).alias(name)))


def stored_form(rows: DataFrame, table: Table) -> DataFrame:
    """The rows with the columns only the files have."""
    return rows.withColumn(KEY_HASH, keys.key_hash(table.identity)) if table.key_filter else rows


def _free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def stage_files(store: Store, rows: DataFrame, plan: FilePlan, staging: str | None = None) -> str:
    """The rows as files of the planned ranges, in a new folder beside the stored ones or added to `staging`."""
    table, rows = plan.table, stored_form(rows, plan.table)
    number = _free_name(rows, "file")
    staging = staging or f"{store.location(table)}/{_STAGING}{uuid.uuid4().hex}"
    placed = with_ranges(store, rows, plan, number)
    spread = [*table.partitions, number]
    placed = (placed.repartition(min(max(plan.files, 1), MOST_FILE_TASKS), *spread)
              .sortWithinPartitions(*spread, *[c for c in table.identity if c not in table.partitions]))
    (table.writer(placed.write.mode("append"), store).option("maxRecordsPerFile", math.ceil(SPLIT_ABOVE * plan.rows_of_a_file))
     .partitionBy(*spread).parquet(f"{staging}/new"))
    return staging


def _staged(store: Store, staging: str) -> DataFrame:
    """(path, length) of the files staged for an exchange."""
    return (store.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .load(f"{staging}/new").select("path", "length"))


def exchange(store: Store, staging: str, old: DataFrame) -> tuple[int, int]:
    """Put the staged files in place of the files `old` (path); (files removed, files added)."""
    old.select("path").write.parquet(f"{staging}/old")
    make_folder(store.spark, f"{staging}/ready")
    return _finish(store, staging)


def finish_exchanges(store: Store, table: Table) -> int:
    """Complete the exchanges that were ready when their driver was lost, and remove the others."""
    found = child_folders(store.spark, store.location(table), _STAGING)
    for staging, _ in found:
        if folder_exists(store.spark, f"{staging}/ready"):
            _finish(store, staging)
        else:
            remove_folder(store.spark, staging)
    return len(found)


def _finish(store: Store, staging: str) -> tuple[int, int]:
    """May be run again after any failure: what is gone or moved already is passed over."""
    spark = store.spark
    folder = F.regexp_replace("path", "/[^/]*$", "")
    old = spark.read.schema("path string").parquet(f"{staging}/old").select(folder.alias("folder"), "path", F.lit(False).alias("new"))
    goal = F.regexp_replace(F.regexp_replace("path", f"/{_STAGING}[0-9a-f]+/new", ""), "/[^/]*/[^/]*$", "")
    new = _staged(store, staging).select(goal.alias("folder"), "path", F.lit(True).alias("new"))
    moves = old.unionByName(new).groupBy("folder").agg(
        F.collect_list(F.when(~F.col("new"), F.col("path"))).alias("old"), F.collect_list(F.when(F.col("new"), F.col("path"))).alias("new"))

    def move(found: Row) -> tuple[int, int]:
        for path in found["old"]:
            remove_folder(spark, path)
        if found["new"]:
            make_folder(spark, found["folder"])
        for path in found["new"]:
            step, name = path.rsplit("/", 2)[1:]
            number = int(step.rpartition("=")[2])
            rename_folder(spark, path, f"{found['folder']}/part-{number:05}-{name.removeprefix('part-')}")
        return len(found["old"]), len(found["new"])

    removed = added = 0
    with ThreadPoolExecutor(EXCHANGING_THREADS) as pool:  # names come a few at a time
        for gone, put in pool.map(move, moves.toLocalIterator()):
            removed, added = removed + gone, added + put
    remove_folder(spark, staging)
    return removed, added


# ---------------------------------------------------------------- compaction

@dataclass(frozen=True)
class CompactResult:
    partitions: int = 0
    files_before: int = 0  # files that were rewritten
    files_after: int = 0
    rows: int = 0
    skipped: list[dict[str, str]] = field(default_factory=list)  # partitions with files that cannot be read


def small_files(store: Store, table: Table, target: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """The files to rewrite so that each partition has at most ceil(bytes / target): (partition
    columns, path, length, files), `files` being how many take their place.

    Of the files below the target the smallest ones are taken, as few as it needs; larger files stay.
    """
    files = stored_files(store, table, selected_folders(store, table, filters or {}))
    predicates, _ = compile_filters(table.partition_types, filters or {})
    files = files.where(all_of([F.col("length") < target, *predicates]))
    own = Window.partitionBy(*table.partitions)
    upto = own.orderBy("length", "path")
    sized = files.withColumns({"at": F.row_number().over(upto), "some": F.sum("length").over(upto.rowsBetween(Window.unboundedPreceding, 0)),
                               "every": F.sum("length").over(own), "count": F.count("*").over(own)})
    packed = F.ceil(F.col("some") / target)
    enough = (F.col("count") - F.col("at") + packed <= F.ceil(F.col("every") / target)) & (F.col("at") > 1)
    last = F.min(F.when(enough & (F.col("count") > F.ceil(F.col("every") / target)), F.struct("at", packed.alias("files")))).over(own)
    return (sized.withColumn("last", last).where(F.col("at") <= F.col("last.at"))
            .select(*table.partitions, "path", "length", F.col("last.files").cast("int").alias("files")))


def compact(store: Store, name: str, version: str = "v1", *, target_mb: float = 128,
            filters: Mapping[str, Any] | None = None) -> CompactResult:
    """Rewrite small files into files of about `target_mb`, with key ranges that do not overlap.

    Afterwards a partition has at most ceil(bytes / target) files, all of them readable before; one
    with a file that cannot be read is left alone and named. Undeclared columns stay. Rows are
    counted from footers before and after, and nothing is exchanged unless they agree.
    """
    table, target = store.table(name, version), int(target_mb * (1 << 20))
    finish_exchanges(store, table)
    chosen = kept(small_files(store, table, target, filters))
    read = footers(chosen).select("path", "rows", "error")
    grouped = chosen.join(read, "path").groupBy(*table.partitions).agg(
        F.collect_list("path").alias("paths"), F.sum("rows").alias("rows"), F.first("files").alias("files"), F.max("error").alias("error")).where(F.size("paths") > 0)
    partitions = before = after = rows = 0
    skipped = []
    for batch in _batches(kept(grouped).toLocalIterator()):
        good = [p for p in batch if not p["error"]]
        skipped += [{"folder": p["paths"][0].rpartition("/")[0], "error": p["error"]} for p in batch if p["error"]]
        if good:
            removed, added = _rewrite(store, table, good)
            partitions, before, after = partitions + len(good), before + removed, after + added
            rows += sum(p["rows"] for p in good)
    return CompactResult(partitions, before, after, rows, skipped)


def _batches(found: Iterator[Row]) -> Iterator[list[Row]]:
    batch, size = [], 0
    for row in found:
        if batch and size + len(row["paths"]) > FILES_AT_ONCE:
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += len(row["paths"])
    if batch:
        yield batch


def _rewrite(store: Store, table: Table, chosen: list[Row]) -> tuple[int, int]:
    paths = [path for p in chosen for path in p["paths"]]
    plan = FilePlan(table, [(tuple(p[c] for c in table.partitions), p["rows"], p["files"]) for p in chosen])
    staging = stage_files(store, read_files(store, table, paths), plan)
    wrote = footers(_staged(store, staging)).agg(F.sum("rows"), F.max("error")).first()
    if (wrote[0] or 0) != sum(p["rows"] for p in chosen) or wrote[1]:
        remove_folder(store.spark, staging)
        raise OSError(f"{wrote[0]} rows written of {sum(p['rows'] for p in chosen)}: {wrote[1]}")
    return exchange(store, staging, store.spark.createDataFrame([(p,) for p in paths], "path string"))


# ---------------------------------------------------------------- writes of a limited file size

def save_sized(store: Store, table: Table, batch: DataFrame, plan: FilePlan, limit: int, old: DataFrame | None) -> None:
    """Add the batch as files of the planned ranges, in place of the files `old`.

    The plan goes by the bytes of a row in the batch as it came. In files of their own and in the
    order of their key rows may take more or less, so the files that were written tell which
    partitions are staged again before anything is exchanged.
    """
    finish_exchanges(store, table)
    staging = stage_files(store, batch, plan)
    for _ in range(STAGED_AGAIN):
        sizes = _staged_sizes(store, table, staging)
        plan = plan.closer(sizes, limit)
        if not plan.entries:
            break
        for t, _, _ in plan.entries:
            remove_folder(store.spark, sizes[tuple(t)]["folder"])
        stage_files(store, _of_partitions(store, batch, plan), plan, staging)
    exchange(store, staging, old if old is not None else store.spark.createDataFrame([], "path string"))


def _staged_sizes(store: Store, table: Table, staging: str) -> dict[tuple, Row]:
    """Folder, bytes and largest file of each staged partition; a row for each, as the plan has."""
    fields = [f for p in table.partitions for f in table.stored_schema if f.name == p]
    files = (store.spark.read.format("binaryFile").schema(T.StructType(LISTING.fields + fields))
             .option("pathGlobFilter", "*.parquet").load(f"{staging}/new"))
    folder = F.regexp_replace("path", "/[^/]*/[^/]*$", "")
    found = files.select(*table.partitions, "length", folder.alias("folder")).groupBy(*table.partitions).agg(
        F.first("folder").alias("folder"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))
    return {tuple(r[p] for p in table.partitions): r for r in found.collect()}


def _of_partitions(store: Store, batch: DataFrame, plan: FilePlan) -> DataFrame:
    """The rows of the batch that belong to partitions of the plan."""
    table = plan.table
    if not table.partitions:
        return batch
    fields = [f for p in table.partitions for f in table.stored_schema if f.name == p]
    schema = T.StructType([T.StructField(f"p{i}", f.dataType) for i, f in enumerate(fields)])
    wanted = F.broadcast(store.spark.createDataFrame([tuple(t) for t, _, _ in plan.entries], schema))
    return batch.alias("row").join(wanted.alias("plan"), _same_partition(table, "row", "plan"), "left_semi")


def bytes_of_a_row(store: Store, folder: str, rows: int) -> float:
    """Bytes that a row of the written `folder` takes."""
    return folder_bytes(store.spark, folder) / max(rows, 1)


def key_ranges(store: Store, name: str, version: str = "v1") -> DataFrame:
    """Per file: partition, rows, least and greatest key, and whether the next file begins after it."""
    table = store.table(name, version)
    rows = read_files(store, table, None)
    shown = rows.select(*table.partitions, F.col("_metadata.file_path").alias("path"), _key(rows, table).alias("key"))
    files = shown.groupBy(*table.partitions, "path").agg(F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("greatest"))
    after = F.lead("least").over(Window.partitionBy(*table.partitions).orderBy("least", "greatest", "path"))
    return files.withColumn("apart", F.coalesce(F.col("greatest") < after, F.lit(True)))
