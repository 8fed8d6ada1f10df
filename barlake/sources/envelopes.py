"""Record envelopes: JSON documents ``{"version": ..., "data": [{...}, ...]}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.tables import Store, Table

# Values are read as text so nothing is lost before the typed checks of a write,
# and records as maps so a column no record has can be told from one that is null.
ENVELOPE = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("data", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def read_envelopes(store: Store, path: str, multi_line: bool = False) -> DataFrame:
    """One row per record: `version` and the `record` map. A malformed document raises."""
    documents = (store.spark.read.schema(ENVELOPE).option("mode", "FAILFAST")
                 .option("multiLine", multi_line).json(path))
    return envelope_records(documents)


def stream_envelopes(store: Store, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = store.spark.readStream.schema(ENVELOPE).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return envelope_records(reader.json(path))


# How records arrived: time and name of their file.
ARRIVAL = ("__file_time", "__file_path")


def envelope_records(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.coalesce("version", F.lit("v1")).alias("version"), F.explode("data").alias("record"),
        F.col("_metadata.file_modification_time").alias(ARRIVAL[0]), F.col("_metadata.file_path").alias(ARRIVAL[1]))


def record_columns(records: DataFrame, table: Table, split: Sequence[str] = ()) -> DataFrame:
    """The declared columns of each record, as text, and how it arrived; a column the record lacks is null.

    `split` are the columns the records were split by, if they were.
    """
    value = {c: F.col(f"value {i}") for i, c in enumerate(split)} or {c: F.col("record")[c] for c in table.columns}
    return records.select(*[value[c].alias(c) for c in table.columns], *[c for c in ARRIVAL if c in records.columns])


def split_records(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The records with a text column `value N` for the Nth of the columns in place of their map, and with
    `has N` whether they have it at all, so that a pass over them reads only the columns it needs."""
    split = []
    for i, c in enumerate(columns):
        value = F.col("record")[c]
        split += [value.alias(f"value {i}"), (value.isNotNull() | F.map_contains_key("record", F.lit(c))).alias(f"has {i}")]
    return records.select("version", *[c for c in ARRIVAL if c in records.columns], *split)


def found_versions(split: DataFrame, columns: Sequence[str], declared: Sequence[str]) -> dict[str | None, set[str]]:
    """Declared versions of split records with the columns that some record has; None stands for all other versions."""
    known = F.col("version").isin(list(declared))
    found = split.groupBy(F.when(known, F.col("version")).alias("known")).agg(
        *[F.max(f"has {i}").alias(f"has {i}") for i in range(len(columns))])
    return {r["known"]: {c for i, c in enumerate(columns) if r[f"has {i}"]} for r in found.collect()}
