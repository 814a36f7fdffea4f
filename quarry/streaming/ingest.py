"""Streams: windowed counts of events, and documents chunked as they arrive."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import models
from quarry.plans import retrieval
from quarry.sources.segments import Index
from quarry.sources.sinks import scratch

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling or sliding windows; works on streams and tables."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return kept.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): runs of a user's events with less than `gap` between."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def ingest(stream: DataFrame, index: str, checkpoint: str, embedder: models.Embedder | None = None, config: Config = Config(), key: str = "doc_id", event_time: str | None = None, late: str = "1 day"):
    """Starts a query that chunks and embeds each new batch of documents (doc_id, text) and adds it to the index as a segment, where searches find it.

    A document that comes again replaces what it was before. With event_time, a column of the stream, an id that comes again with the same text within
    `late` is a repeated delivery and passed over, by state that the watermark bounds. A segment is named after the checkpoint and the batch,
    so a batch that is tried again after a restart is added once.
    """
    model = embedder or models.HashingEmbedder(config.embedding_size)
    name = f"stream-{zlib.crc32(checkpoint.encode()):08x}"
    if event_time:
        marked = stream.withColumn("_text", F.xxhash64("text")).withWatermark(event_time, late)
        stream = marked.dropDuplicatesWithinWatermark([key, "_text"]).drop("_text")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Of rows that share an id in one batch the one with the greatest text counts; without it a try again could choose another.
        rows = batch.groupBy(key).agg(F.max("text").alias("text")).withColumnRenamed(key, "doc_id")
        if not rows.limit(1).count():
            return
        with scratch(spark):
            Index.opened_or_empty(spark, index).add(*retrieval.build(rows, model, config), segment=f"{name}-{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
