"""Matching a batch against stored rows by key; null keys match null keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of

# What `marked_keys` says of a key: rows of the batch, and whether it is stored.
MARKS = ("__rows", "__stored")


def find_duplicates(batch: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Batch rows whose key is stored."""
    return _match(batch, stored, key, "left_semi")


def remove_duplicates(batch: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored; repeats inside the batch stay."""
    return _match(batch, stored, key, "left_anti")


def distinct_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.select(*key).distinct()


def marked_keys(batch: DataFrame, stored: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """The batch keys that are stored or repeated, with their batch rows and whether they are stored."""
    names = [F.when(F.col("nulls").bitwiseAND(1 << i) == 0, F.col(f"k{i}")).alias(c) for i, c in enumerate(key)]
    return _grouped(batch, stored, key).where((F.col("n") > 1) | F.col("stored")).select(
        *names, F.col("n").alias(MARKS[0]), F.coalesce("stored", F.lit(False)).alias(MARKS[1]))


def without_marked(batch: DataFrame, marked: DataFrame, key: Sequence[str], *, drop: bool,
                   order: Sequence[str] = ()) -> DataFrame:
    """Batch rows whose key is not stored, with `drop` one per key: the smallest by `order` and then by all columns.

    Only rows of repeated keys are grouped; all others pass by.
    """
    same = _same_key("batch", "marked", key)
    settled = marked if drop else marked.where(F.col(MARKS[1]))
    once = batch.alias("batch").join(settled.alias("marked"), same, "left_anti")
    if not drop:
        return once
    names = batch.columns
    least = [*order, *[c for c in names if c not in order]]
    several = batch.alias("batch").join(marked.where(~F.col(MARKS[1])).alias("marked"), same, "left_semi")
    first = several.groupBy(*key).agg(F.min(F.struct(*least)).alias("row")).select("row.*")
    return once.unionByName(first.select(*names))


def key_hash(key: Sequence[str]) -> Column:
    """Hash of partition and key as tables with a key filter store it; equal keys have equal hashes."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in key])


def shared_keys(batch: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct stored keys that the batch has too, found without shuffling the stored rows.

    The batch keys are broadcast, so call it only for a batch of checked size.
    """
    same = _same_key("stored", "batch", key)
    mine = F.broadcast(distinct_keys(batch, key)).alias("batch")
    return distinct_keys(stored, key).alias("stored").join(mine, same, "left_semi")


def _match(batch: DataFrame, stored: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    # The stored side is made distinct before the join, so a key that fills a
    # third of the table arrives as one row. The join then has its own exchange
    # on either side, which lets adaptive execution split a hot batch key.
    same = _same_key("batch", "stored", key)
    return batch.alias("batch").join(distinct_keys(stored, key).alias("stored"), same, how)


def _same_key(left: str, right: str, key: Sequence[str]) -> Column:
    return all_of([F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in key])


@dataclass(frozen=True)
class KeyCounts:
    rows: int
    stored: int    # batch rows whose key is stored
    repeated: int  # batch rows beyond the first of their key
    fresh_keys: int  # distinct batch keys that are not stored

    @property
    def repeats_left(self) -> bool:
        """Whether rows that are not stored share a key."""
        return self.rows - self.stored > self.fresh_keys


def count_keys(batch: DataFrame, stored: DataFrame | None, key: Sequence[str]) -> KeyCounts:
    row = key_counts(batch, stored, key).first()
    return KeyCounts(row["rows"], row["stored"], row["repeated"], row["fresh_keys"])


def marked_counts(marked: DataFrame, rows: int) -> tuple[KeyCounts, int]:
    """Counts of a batch of so many rows from its marked keys, and the number of those."""
    total = marked.agg(
        F.count("*").alias("keys"), F.count_if(MARKS[1]).alias("stored keys"),
        F.coalesce(F.sum(F.when(F.col(MARKS[1]), F.col(MARKS[0]))), F.lit(0)).alias("stored"),
        F.coalesce(F.sum(F.col(MARKS[0]) - 1), F.lit(0)).alias("repeated")).first()
    fresh = rows - total["repeated"] - total["stored keys"]  # keys without a mark have one row each
    return KeyCounts(rows, total["stored"], total["repeated"], fresh), total["keys"]


def key_counts(batch: DataFrame, stored: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Duplicate counts in one row, without moving rows: each side shuffles one row per key."""
    return _grouped(batch, stored, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("stored"), F.col("n"))), F.lit(0)).alias("stored"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
        F.count_if(F.col("stored").isNull()).alias("fresh_keys"))


def _grouped(batch: DataFrame, stored: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Batch keys with their rows `n`, and `stored` where they are.

    Keys are written null-free (value plus a bit mask of nulls), so grouping and
    join share one exchange per side and a hot key collapses before the shuffle.
    """
    names = [*[f"k{i}" for i in range(len(key))], "nulls"]
    mine = batch.select(*_null_free(batch, key)).groupBy(*names).agg(F.count("*").alias("n"))
    if stored is None:
        mine = mine.withColumn("stored", F.lit(None).cast("boolean"))
    else:
        # grouped rather than distinct, which would not keep the order of the key columns
        theirs = (stored.select(*_null_free(stored, key)).groupBy(*names)
                  .agg(F.lit(True).alias("stored")))
        mine = mine.join(theirs, names, "left")
    return mine


def _null_free(df: DataFrame, key: Sequence[str]) -> list[Column]:
    values, mask = [], F.lit(0)
    for i, name in enumerate(key):
        column = F.col(name)
        values.append(F.coalesce(column, _stand_in(df.schema[name].dataType)).alias(f"k{i}"))
        mask = mask + F.when(column.isNull(), 1 << i).otherwise(0)
    return [*values, mask.alias("nulls")]


def _stand_in(dtype: T.DataType) -> Column:
    """Any value of the type; the null mask tells it from a real one."""
    return F.lit("" if isinstance(dtype, T.StringType) else 0).cast(dtype)
