"""Incremental ingestion: a file source of chunk rows, merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import ChunkStore
from ..schema import CHUNKS


def chunk_stream(spark: SparkSession, folder: str, files_each: int = 1000) -> DataFrame:
    """New Parquet files of chunk rows below folder, as a stream."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_each).parquet(folder)


def merge_into(stream: DataFrame, store: ChunkStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert every batch; a batch that is repeated after a failure changes nothing, because rows are keyed by chunk_id."""

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                store.upsert(batch)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def first_seen(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each chunk_id once within the watermark."""
    return stream.withWatermark("indexed_at", delay).dropDuplicatesWithinWatermark(["chunk_id"])


def ingest_rates(stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows in windows of event time, by content type."""
    window = F.window("indexed_at", width)
    return stream.withWatermark("indexed_at", delay).groupBy(window, "content_type").agg(F.count(F.lit(1)).alias("n"))
