"""The files of a stored table as rows: one listing, and Parquet footers on top of it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barlake.sources.scratch import child_folders, folder_exists
from barlake.tables import Store, Table

LISTING = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

FOOTER = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField("format_version", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
    T.StructField("error", T.StringType())])


# Partition values with these characters alone stand in folder names as they are.
_PLAIN = re.compile(r"[A-Za-z0-9_-]+")


def partition_folders(store: Store, table: Table, tuples: Sequence[Sequence]) -> list[str] | None:
    """Folders that exist for these partition tuples, so that nothing else need be listed.

    None if a value would be escaped in its folder name, or is null: list the
    whole table and filter then.
    """
    folders = []
    for values in tuples:
        if not all(isinstance(v, str) and _PLAIN.fullmatch(v) for v in values):
            return None
        steps = "/".join(f"{p}={v}" for p, v in zip(table.partitions, values))
        folders.append(f"{store.location(table)}/{steps}")
    return [f for f in folders if folder_exists(store.spark, f)]


def month_folders(store: Store, table: Table, first: str | None, last: str | None) -> list[str] | None:
    """Folders of the months whose days can lie between `first` and `last`, for a table laid out by
    Year and Month. Lists two levels only. None if a folder name is escaped."""
    year, month = table.partitions[:2]
    location, found = store.location(table), []
    for year_folder, year_text in child_folders(store.spark, location, f"{year}="):
        if (first and year_text < first[:4]) or (last and year_text > last[:4]):
            continue
        if not _PLAIN.fullmatch(year_text):
            return None
        for folder, month_text in child_folders(store.spark, year_folder, f"{month}="):
            if not _PLAIN.fullmatch(month_text):
                return None
            day = f"{year_text}-{month_text}"
            if (not first or day >= first[:7]) and (not last or day <= last[:7]):
                found.append(folder)
    return found


def stored_files(store: Store, table: Table, folders: Sequence[str] | None = None) -> DataFrame:
    """Path and size of every file with its partition values; file contents are not read.

    A filter on the partition columns prunes the files; `folders` bounds the listing itself.
    """
    partitions = [f for f in table.stored_schema if f.name in table.partitions]
    schema = T.StructType(LISTING.fields + partitions)
    shown = [*table.partitions, "path", "length"]
    location = store.location(table)
    if folders is not None and not folders:
        return store.spark.createDataFrame([], schema).select(*shown)
    try:
        files = (store.spark.read.format("binaryFile").schema(schema).option("basePath", location)
                 .option("pathGlobFilter", "*.parquet").load(list(folders or [location])))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        files = store.spark.createDataFrame([], schema)
    return files.select(*shown)


def stored_partitions(store: Store, table: Table) -> DataFrame:
    """Distinct partition tuples that hold at least one file."""
    return stored_files(store, table).select(*table.partitions).distinct()


def footers(files: DataFrame) -> DataFrame:
    """Row count, format version and stored columns of each file, from its footer only.

    Needs `path` and `length`. A file that cannot be read gives a row with
    `error`; a file system that cannot be reached fails the job.
    """
    names = FOOTER.names

    # All helpers are local so that they travel to the workers by value.
    def file_system(root: str) -> tuple:
        """(file system, its path of the root) for `scheme://authority/`."""
        import pyarrow.fs

        if root.startswith("file:"):
            return pyarrow.fs.LocalFileSystem(), "/"
        return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))

    def read_footer(system, inner: str) -> tuple:
        import pyarrow.parquet as pq

        try:
            with system.open_input_file(inner) as file:
                parquet = pq.ParquetFile(file)
                fields = [{"name": f.name, "type": str(f.type)} for f in parquet.schema_arrow]
                return parquet.metadata.num_rows, parquet.metadata.format_version, fields, None
        except Exception as problem:  # reported in the row; the other files still count
            return None, None, None, f"{type(problem).__name__}: {problem}"

    def read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        systems: dict[str, tuple] = {}
        for batch in batches:
            found = []
            for path, length in zip(batch["path"], batch["length"]):
                # names may hold escapes such as %2F, so the path is cut and never decoded
                scheme, authority, rest = re.fullmatch(r"([^:/]+):(?://([^/]*))?(/.*)", path).groups()
                root = f"{scheme}://{authority or ''}/"
                if root not in systems:
                    systems[root] = file_system(root)
                system, base = systems[root]
                found.append((path, int(length), *read_footer(system, base.rstrip("/") + rest)))
            yield pd.DataFrame(found, columns=names).astype({"rows": "Int64"})

    # files are listed in tasks by their size, so large ones would each be a Python task of their own
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "length").repartition(tasks).mapInPandas(read_footers, FOOTER)
