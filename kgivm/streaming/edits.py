"""Edits that arrive as files, applied in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kgivm.operators.pipeline import run_batch
from kgivm.schemas import EDIT
from kgivm.store import Store


def edit_stream(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(EDIT).format(kind).load(path)


def apply_once(store: Store, batch: DataFrame, number: int, mode: str = "immediate") -> bool:
    """Apply a numbered batch unless the state holds it; an empty one changes nothing."""
    if number <= store.load().batch or batch.isEmpty():
        return False
    run_batch(store, batch, mode, number=number)
    return True


def maintain(edits: DataFrame, store: Store, checkpoint: str, mode: str = "immediate", **trigger) -> StreamingQuery:
    """Apply each micro-batch as one step, once only: its number is committed with the state by the same rename, so a batch that comes again after a failure finds itself applied or nothing of itself."""
    return edits.writeStream.foreachBatch(lambda batch, number: apply_once(store, batch, number, mode)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
