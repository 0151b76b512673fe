"""Event-time aggregation and streaming ingestion. These are extensions of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, by, n, total: tumbling or sliding windows; late rows are dropped after ``late`` in a stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if events.isStreaming else rows
    grouped = rows.groupBy(F.window(at, window, slide), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", user: str = "user_id") -> DataFrame:
    """user, session_start, session_end, n."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if events.isStreaming else rows
    grouped = rows.groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def latest_once(events: DataFrame, key: str = "event_id", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Each key once; in a stream, within the watermark."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def ingest_chunks(documents: DataFrame, folder: str, checkpoint: str, size: int = 512, overlap: int = 100):
    """Starts a stream that splits new documents into chunks and appends them to a Parquet folder, once through."""
    from vellum.operators.text_splitter import split_text

    query = split_text(documents, "text", size, overlap).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
