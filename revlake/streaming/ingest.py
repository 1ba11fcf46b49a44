"""Structured Streaming as a way in: micro-batches of log entries are validated and committed once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from revlake.sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Commits each micro-batch of (key, revision, deleted, value) with its number in the manifest.

    A batch that is repeated after a crash is skipped, so entries are written exactly once. There are
    no watermarks: lateness is judged per key by revision, and a late entry fails its batch.
    """

    def commit(rows: DataFrame, number: int) -> None:
        if number > store.manifest.batches.get(name, -1):
            store.apply(rows, batch=(name, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
