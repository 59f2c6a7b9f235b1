"""Topic stream to edge table, batch by batch."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirebook.operators.fold import fold_edges
from wirebook.schemas import WIDE_EVENT
from wirebook.sources import messages
from wirebook.sources.events import normalize
from wirebook.sources.tables import compact, write_delta

TRIGGER_SECONDS = 5
#: Deltas between two merges into a base.
COMPACT_EVERY = 200


def ingest_batch(batch: DataFrame, batch_id: int, root: str, prefix: str = "") -> None:
    """Decode and fold one batch of messages.

    Edges, rejected messages and counts go below the batch's own number and
    replace what an earlier attempt may have left there.
    """
    decoded = messages.decode_messages(batch.select("topic", "value"), prefix).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_delta(fold_edges(normalize(messages.good(decoded))), f"{root}/edges", batch_id)
        messages.dead_letters(decoded).write.mode("overwrite").parquet(f"{root}/dead_letters/batch={batch_id}")
        counts = decoded.agg(
            F.count("*").alias("consumed"),
            F.count(F.when(F.col("reason").isNull(), 1)).alias("ingested"),
            F.count("reason").alias("errors"),
        )
        counts.write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")
    finally:
        decoded.unpersist()


def start_consumer(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    prefix: str = "",
    trigger_seconds: int = TRIGGER_SECONDS,
    available_now: bool = False,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Run the fold over a message stream; returns the query to stop or await.

    Every so many batches the deltas are merged into a base, so that readers
    find few of them.

    The checkpoint gives every batch its number and content again after a
    failure, which together with replacing writes counts each message once.
    """
    def ingest(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, root, prefix)
        if batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, f"{root}/edges")

    writer = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


def stream_communications(stream: DataFrame, prefix: str = "", delay: str = "10 minutes", dedupe: bool = False) -> DataFrame:
    """Messages to communications with a watermark on event time.

    With ``dedupe`` a message delivered twice within the delay counts once; messages
    that differ in any field of the event are different.
    """
    events = messages.good(messages.decode_messages(stream.select("topic", "value"), prefix))
    events = events.withWatermark("ts", delay)
    if dedupe:
        events = events.dropDuplicatesWithinWatermark(WIDE_EVENT.names)
    return normalize(events)
