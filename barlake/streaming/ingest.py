"""Envelopes dropped into a folder, appended to a stored table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from barlake.operators.ingest import ingest_records
from barlake.sources.envelopes import stream_envelopes
from barlake.tables import Store


def ingest_stream(store: Store, path: str, name: str, checkpoint: str, *,
                  files_per_batch: int | None = None, interval: str | None = None,
                  **options) -> StreamingQuery:
    """Start a query that appends each drop of envelopes; of records with one key the first stays.

    First is the record of the oldest file, by file name among equally old ones, and the smallest
    row within a file; so it does not matter how the files are cut into micro-batches.

    A micro-batch that is run again after a failure adds nothing, because its
    keys are already stored; no streaming state is kept. Without `interval` the
    query takes everything available and stops. `checkpoint` must be a folder
    that survives the loss of a machine. A batch that fails its checks fails the
    query, so no record is dropped silently.
    """
    options.setdefault("remove_duplicates", True)
    options.setdefault("drop_repeats", True)

    def append(batch: DataFrame, batch_id: int) -> None:
        for result in ingest_records(store, batch, name, **options):
            if not result.success:
                raise ValueError(f"Batch {batch_id} of {name} refused: {result.errors}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (stream_envelopes(store, path, files_per_batch).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
