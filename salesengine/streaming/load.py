"""The append load (A09 / A14) as a stream: files landing in a folder are appended as they arrive.

``readStream`` tracks which files were taken in its checkpoint; every
micro-batch is appended to the keyed table through ``foreachBatch``.  Its rows
carry the stream's id and the batch id.  A batch that is replayed after a failure
is skipped when all its rows are there, and what a broken commit left of it is
deleted before it is appended again, so every batch is in the table once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from salesengine.session import storage_root
from salesengine.sources.csv import CSV_OPTIONS
from salesengine.sources.keyed_table import KeyedTable


def batch_appender(table: KeyedTable, order_by: Sequence[str], stream_id: str):
    """The ``foreachBatch`` function: append a micro-batch once, whatever an earlier try of it left behind."""

    def append_batch(batch: DataFrame, batch_id: int) -> None:
        label = f"{stream_id}:{batch_id}"
        n, stored = batch.count(), table.batch_rows(label)
        if stored == n:
            return
        if stored:
            table.discard_batch(label)
        table.append(batch, order_by=list(order_by), label=label)

    return append_batch


def start_append_stream(spark: SparkSession, source_dir: str, table: KeyedTable, schema: T.StructType,
                        order_by: Sequence[str], fmt: str = "csv", stream_id: str | None = None,
                        available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the load; ``available_now`` processes what is there and stops (a scheduled incremental job)."""
    stream_id = stream_id or table.path.rsplit("/", 1)[-1]
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    src = reader.format(fmt).load(source_dir)
    writer = src.writeStream.foreachBatch(batch_appender(table, order_by, stream_id)).option(
        "checkpointLocation", f"{storage_root(spark)}/streams/{stream_id}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
