"""Replays of a stored table as a stream of arrivals, one trigger after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(rows: DataFrame, slice_no: Column, folder: str, start: Callable[[DataFrame], StreamingQuery], ts: str = "issued_date") -> None:
    """Append slice after slice, by its whole number, to ``folder`` and run the stream over what is new.

    ``start`` gets the stream of the folder and starts a query that ends when all
    available rows are done, always with the same checkpoint. So the watermark that a
    slice meets comes from the slices before it, and every slice is read by many tasks.
    """
    spark = rows.sparkSession
    first, last = rows.agg(F.min(slice_no), F.max(slice_no)).first()
    if first is None:
        raise ValueError("no row has a slice")
    for i in range(first, last + 1):
        rows.filter(slice_no == i).withColumn(ts, F.col(ts).cast("timestamp")).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        start(stream).awaitTermination()
