"""Incremental ingest, deduplication, counts and enrichment.

All operators take and give streaming DataFrames. Burst flags are in ``bursts``,
upserts and recounted days in ``store``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barograph.operators.enrich import process_alerts


def read_alert_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", ts: str = "issued_date", files_per_trigger: int | None = None, **options: str
) -> DataFrame:
    """New alert files of a folder as they arrive, with ``ts`` as an event time."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # Event time must be a timestamp with time zone.
    return reader.load(path).withColumn(ts, F.col(ts).cast("timestamp"))


def start(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = None, fmt: str = "parquet", mode: str = "append"
) -> StreamingQuery:
    """Write a stream to files: everything available once, or every ``interval`` such as '1 hour'."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
    )


def dedupe_stream(df: DataFrame, keys: Sequence[str] = ("alert_id",), ts: str = "issued_date", lateness: str = "1 day") -> DataFrame:
    """Drop repeated alerts that arrive within ``lateness``; the first one stays.

    State is kept per key only until the watermark has passed it.
    """
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(
    df: DataFrame,
    keys: Sequence[str] = ("type", "region"),
    ts: str = "issued_date",
    width: str = "1 hour",
    slide: str | None = None,
    lateness: str | None = "1 day",
) -> DataFrame:
    """Alert counts per window and key, each emitted once its window is closed.

    Pass ``lateness=None`` for a stream that has its watermark already.
    ``width='7 days', slide='1 day'`` gives the live form of the weekly average.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    marked = df.withWatermark(ts, lateness) if lateness else df
    return (
        marked.groupBy(window.alias("window"), *keys)
        .agg(F.count(F.lit(1)).alias("total_alerts"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "total_alerts")
    )


def enrich_stream(df: DataFrame, **options) -> DataFrame:
    """The per-alert enrichment on a stream; it keeps no state."""
    return process_alerts(df, **options)
