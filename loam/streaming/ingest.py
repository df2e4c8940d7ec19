"""Streams of records into a store, and a live view of the newest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, name: str, order: str | None = None, flush: bool = True) -> StreamingQuery:
    """Puts each micro-batch of (key, value) once, however often it is tried; with ``flush``, full buffers are flushed."""

    def put(df: DataFrame, batch: int) -> None:
        store.put_all(df, order=order, batch_of=(name, batch))
        while flush and store.flush_next():
            pass

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_view(stream: DataFrame, order: str) -> DataFrame:
    """(key, value) of the greatest ``order`` so far, kept by the engine: an update for each key that changes."""
    return stream.groupBy("key").agg(F.max_by("value", F.col(order)).alias("value"))
