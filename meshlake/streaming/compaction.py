"""Compaction of a store as a stream: each arrival of log commits folds the log into a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meshlake.plans import replay
from meshlake.sources.store import GraphStore


def start_compaction(store: GraphStore, checkpoint: str, interval: str | None = "30 seconds") -> StreamingQuery:
    """Watch the store's log; without an interval, handle what is there and end. A replayed batch finds an empty log and does nothing."""
    schema = store._ddl(replay.MUTATION)

    def fold(batch: DataFrame, _: int) -> None:
        store._open()
        store.flush()

    source = store.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("cleanSource", "off").parquet(f"{store.path}/log")
    writer = source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
