"""Record envelopes into stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.write import WriteResult, write_data
from barlake.sources.envelopes import ARRIVAL, found_versions, read_envelopes, record_columns, split_records
from barlake.sources.scratch import new_folder, remove_folder
from barlake.tables import Store


def ingest_envelopes(store: Store, path: str, name: str, mode: str = "append", *,
                     multi_line: bool = False, **options) -> list[WriteResult]:
    """Read a folder of JSON envelopes and write their records, one write per version found."""
    return ingest_records(store, read_envelopes(store, path, multi_line), name, mode, **options)


def ingest_records(store: Store, records: DataFrame, name: str, mode: str = "append",
                   **options) -> list[WriteResult]:
    """Write (version, record map) rows. JSON is parsed once and staged as Parquet, a column for each declared one.

    Only the versions declared for the dataset are written; any other is an error.
    """
    tables = {t.version: store.table(name, t.version) for t in store.tables if t.name == name}
    if not tables:
        raise KeyError(f"Dataset not declared: {name}")
    columns = list(dict.fromkeys(c for t in tables.values() for c in t.columns))
    folder = new_folder(store.spark, "records")
    split = split_records(records, columns)
    try:
        split.write.parquet(folder)
        staged = store.spark.read.schema(split.schema).parquet(folder)
        found = found_versions(staged, columns, list(tables))
        if None in found:
            unknown = staged.where(~F.coalesce(staged["version"].isin(list(tables)), F.lit(False))).first()
            raise KeyError(f"Dataset not declared: {name} {unknown['version']}")
        results = []
        for version in sorted(found):
            table = tables[version]
            absent = [c for c in table.columns if c not in found[version]]
            if absent:
                results.append(WriteResult(False, errors=[f"Missing columns: {absent}"]))
            else:
                part = record_columns(staged.where(staged["version"] == version), table, columns)
                results.append(write_data(store, part, name, version, mode,
                                          order=[c for c in ARRIVAL if c in part.columns], stage=False, **options))
        return results or [WriteResult(True)]
    finally:
        remove_folder(store.spark, folder.rpartition("/")[0])
