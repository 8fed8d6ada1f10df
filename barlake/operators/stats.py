"""Storage statistics, file metadata, conformance, profiles and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of, megabytes
from barlake.sources.files import footers, stored_files
from barlake.sources.scan import EXACT_PARTITIONS, in_partitions
from barlake.sources.scratch import kept
from barlake.tables import KEY_HASH, Store, Table

# How each declared type reads in a Parquet footer.
STORED_TYPES = {
    "string": "string", "int64": "int64", "int32": "int32", "int16": "int16", "int8": "int8",
    "uint64": "decimal128(20, 0)", "float": "float", "double": "double", "bool": "bool",
    "date": "string", "datetime": "string", "timestamp": "int64",
}


def storage_stats(store: Store, name: str, version: str = "v1") -> DataFrame:
    """Files, rows and bytes of a dataset from listing and footers.

    A file that cannot be read counts as a file, and as `unreadable`, but adds no rows and no bytes.
    """
    read = footers(stored_files(store, store.table(name, version)))
    size = F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("length"))), F.lit(0))
    return read.agg(F.count("*").alias("files"),
                    F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                    size.alias("bytes"), megabytes(size).alias("size_mb"),
                    F.count("error").alias("unreadable")).select(
        F.lit(name).alias("dataset"), F.lit(version).alias("version"), "*")


def file_metadata(store: Store, name: str, version: str = "v1") -> DataFrame:
    """Per file: rows, columns, size, Parquet format version, column names and types."""
    return footers(stored_files(store, store.table(name, version))).select(
        "path", "rows", F.size("fields").alias("column_count"), "length", "format_version",
        F.col("fields.name").alias("columns"), "fields", "error")


def stored_conformance(store: Store, name: str, version: str = "v1") -> DataFrame:
    """Files and rows per column and stored type, next to the declared type.

    A declared column that a file lacks has stored type null, an undeclared one
    has declared type null.
    """
    table = store.table(name, version)
    read = footers(stored_files(store, table)).where("error IS NULL")
    stored = read.select("path", "rows", F.inline("fields")).where(F.col("name") != KEY_HASH)
    lacking = read.select("path", "rows", F.explode(F.array_except(
        F.array(*[F.lit(c) for c in _file_columns(table)]), F.col("fields.name"))).alias("name"),
        F.lit(None).cast("string").alias("type"))
    declared, expected = F.lit(None).cast("string"), F.lit(None).cast("string")
    for column in _file_columns(table):
        kind = table.columns[column]
        declared = F.when(F.col("column") == column, kind).otherwise(declared)
        expected = F.when(F.col("column") == column, STORED_TYPES[kind]).otherwise(expected)
    return (stored.unionByName(lacking).withColumnsRenamed({"name": "column", "type": "stored_type"})
            .groupBy("column", "stored_type")
            .agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))
            .select("column", declared.alias("declared"), "stored_type",
                    F.col("stored_type").eqNullSafe(expected).alias("conforms"), "files", "rows"))


def _file_columns(table: Table) -> list[str]:
    """Columns kept inside the files; partition columns live in the folder names."""
    return [c for c in table.columns if c not in table.partitions]


def value_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values per column, in one row."""
    return df.agg(*[F.count_distinct(c).alias(f"{c}_values") for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, sorted."""
    return df.select(column).distinct().orderBy(column)


def reconcile(before: DataFrame, after: DataFrame, sums: Sequence[str],
              distinct: Sequence[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """(measure, before, after, agrees): row count, distinct counts and sums of both sides.

    One aggregation per side. Counts and sums of whole numbers and decimals are compared exactly,
    as decimals. Sums of floating-point numbers may differ by `tolerance` times the sum of absolute
    values, because they depend on the order of the rows. `before` and `after` are shown as doubles.
    """
    def measures(df: DataFrame, side: str) -> DataFrame:
        floating = [c for c in sums if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
        aggregates, pairs = [F.count("*").alias("rows")], [("rows", F.col("rows"), None)]
        for c in distinct:
            aggregates.append(F.count_distinct(c).alias(f"distinct {c}"))
            pairs.append((f"distinct {c}", F.col(f"distinct {c}"), None))
        for c in sums:
            value = F.col(c) if c in floating else F.col(c).cast(_summable(df.schema[c].dataType))
            aggregates.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"sum {c}"))
            if c in floating:
                aggregates.append(F.coalesce(F.sum(F.abs(c)), F.lit(0.0)).alias(f"size {c}"))
            pairs.append((f"sum {c}", F.col(f"sum {c}"), F.col(f"size {c}") if c in floating else None))
        row = df.agg(*aggregates)
        entries = F.array(*[F.struct(
            F.lit(name).alias("measure"), value.cast("double").alias("value"),
            (F.lit(None) if size is not None else value).cast("string").alias("exact"),
            F.coalesce(size if size is not None else F.lit(None), F.lit(0.0)).cast("double").alias("size"))
            for name, value, size in pairs])
        return row.select(F.inline(entries)).withColumn("side", F.lit(side))

    both = measures(before, "before").unionByName(measures(after, "after"))
    sides = {(c, side): F.max(F.when(F.col("side") == side, F.col(c)))
             for c in ("value", "exact") for side in ("before", "after")}
    met = both.groupBy("measure").agg(
        sides["value", "before"].alias("before"), sides["value", "after"].alias("after"),
        sides["exact", "before"].alias("exact_before"), sides["exact", "after"].alias("exact_after"),
        F.max("size").alias("size"))
    close = F.abs(F.col("before") - F.col("after")) <= tolerance * F.col("size")
    return met.select("measure", "before", "after",
                      F.when(F.col("exact_before").isNotNull() & F.col("exact_after").isNotNull(),
                             F.col("exact_before") == F.col("exact_after")).otherwise(close).alias("agrees"))


def partition_digests(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rows, digest0, digest1): per partition its rows and two sums of hashes of whole rows.

    The sums do not depend on the order of the rows, and repeated rows count each time. One hash
    aggregation: a row per partition and task is shuffled.
    """
    values = [F.struct(F.col(c).isNull(), _one_zero(df, c)) for c in sorted(df.columns)]  # a null is a value
    sums = [F.sum(F.xxhash64(*values, F.lit(k)).cast("decimal(38,0)")).alias(f"digest{k}") for k in range(2)]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *sums)


def _one_zero(df: DataFrame, name: str) -> Column:
    """The column with 0.0 for -0.0, which are equal but hash differently."""
    return F.col(name) + 0 if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else F.col(name)


def differing_partitions(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rows_before, rows_after) of the partitions whose rows differ, found by their digests alone.

    Both sides need the same columns. Null is a partition like any other; a partition that one side
    lacks has 0 rows there.
    """
    sides = [partition_digests(df.select(*before.columns), by).withColumnsRenamed({c: f"{side}_{i}" for i, c in enumerate(by)})
             .alias(side) for side, df in (("before", before), ("after", after))]
    same = all_of([F.col(f"before_{i}").eqNullSafe(F.col(f"after_{i}")) for i in range(len(by))] or [F.lit(True)])
    agrees = all_of([F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in ("rows", "digest0", "digest1")])
    return sides[0].join(sides[1], same, "full_outer").where(~agrees).select(
        *[F.coalesce(f"before_{i}", f"after_{i}").alias(c) for i, c in enumerate(by)],
        F.coalesce("before.rows", F.lit(0)).alias("rows_before"), F.coalesce("after.rows", F.lit(0)).alias("rows_after"))


def differing_rows(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """(side, times, all columns): rows that one side has more often, and how much more often.

    Whole rows of both sides meet only for partitions whose digests differ; these are written to the
    shared folder once. Up to EXACT_PARTITIONS of them become a filter, which prunes the folders of a
    stored side; beyond that they are joined.
    """
    names = before.columns
    found = kept(differing_partitions(before, after, by).select(*by)) if by else None
    tuples = found.limit(EXACT_PARTITIONS + 1).collect() if by else []

    def concerned(df: DataFrame) -> DataFrame:
        if not by:
            return df
        if not tuples:
            return df.where(F.lit(False))
        if len(tuples) <= EXACT_PARTITIONS:
            return df.where(in_partitions(list(by), tuples))
        same = all_of([F.col(f"row.{c}").eqNullSafe(F.col(f"found.{c}")) for c in by])
        return df.alias("row").join(found.alias("found"), same, "left_semi")

    both = concerned(before.select(*names)).withColumn("times", F.lit(1)).unionByName(
        concerned(after.select(*names)).withColumn("times", F.lit(-1)))
    left = both.groupBy(*names).agg(F.sum("times").alias("times")).where("times != 0")
    return left.select(F.when(F.col("times") > 0, "before").otherwise("after").alias("side"),
                       F.abs("times").alias("times"), *names)


def _summable(dtype: T.DataType) -> T.DataType:
    """Wide enough that no sum of the type overflows, and of one text form on both sides."""
    return T.DecimalType(38, dtype.scale if isinstance(dtype, T.DecimalType) else 0)
