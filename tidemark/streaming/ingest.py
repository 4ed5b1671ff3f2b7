"""Streaming ingest: each micro-batch of mutations is one batch of the store's log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import state
from tidemark.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Append a stream of mutations (k, op, v and their sequence numbers) to an open store until its source is drained.

    The numbers decide which mutation of a key is the newest, whichever batch it comes in. The store's manifest names
    the last batch applied from this checkpoint, so one that is repeated after a failure is applied once.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.apply(batch, order, numbered=True, batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(stream: DataFrame) -> DataFrame:
    """The newest mutation of each key as a continuous aggregation (update or complete mode)."""
    return state.latest(stream)
