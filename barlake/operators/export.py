"""Filtered rows as JSON records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barlake.functions.filters import filter_arguments
from barlake.sources.scan import query_data
from barlake.tables import Store


def records(df: DataFrame) -> DataFrame:
    """One JSON object per row; nulls are written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def export_records(store: Store, name: str, path: str, version: str = "v1",
                   args: Mapping[str, str] | Iterable[tuple[str, str]] = ()) -> dict[str, Any]:
    """Write the answer to `f_` arguments as JSON lines and describe it."""
    args = list(args.items() if isinstance(args, Mapping) else args)
    df, warnings = query_data(store, name, version, args)
    written = Observation()
    records(df).observe(written, F.count("*").alias("rows")).write.text(path)
    described = {"data_type": name, "version": version, "total_rows": written.get["rows"],
                 "filters": filter_arguments(args, store.table(name, version).columns)[0]}
    if warnings:
        described["warnings"] = warnings
    return described
