"""Streams: new files into the library, and counts of events in windows. Both run as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sniff


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value); on a stream, ``late`` is the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts over a folder that Parquet files of events arrive in."""
    return windowed(spark.readStream.schema(schema).parquet(folder), size, late)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, content_hash, kind) of PDF and EPUB files as they arrive."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    rows = rows.where(F.lower("path").rlike(r"\.(pdf|epub)$"))
    return rows.select("path", "content", F.sha2("content", 256).alias("content_hash"), sniff(F.col("content")).alias("kind"))


def ingest(stream: DataFrame, library: Callable[[], DataFrame], act: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that hands each batch's unknown files, one of each hash, to ``act``.

    ``library`` gives the stored items (content_hash) as they are when a batch runs. A batch that is run again after
    a failure finds its files known, so that none is stored twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        act(rows.dropDuplicates(["content_hash"]).join(library().select("content_hash"), "content_hash", "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
