"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.functions.timeparts import parse_timestamp
from barograph.operators.dedupe import keep_last
from barograph.schemas import ALERT_RAW, ANOMALIES, DAILY, FORECASTS, INSIGHTS

DEFAULT_INSIGHTS = [
    "System initializing - data collection in progress",
    "Monitoring weather alerts for pattern detection",
    "Forecast models ready for prediction generation",
    "Real-time alert monitoring active",
]

RESULT_TABLES = {"daily_stats": DAILY, "anomalies": ANOMALIES, "forecasts": FORECASTS, "alerts": ALERT_RAW, "dashboard": DAILY}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table of one of Spark's file formats with a declared schema.

    CSV files have a header; malformed values become null. A CSV is matched to
    the schema by column name through its header.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
        found = reader.load(path)
        if schema is None:
            return found
        known = {f.name: f for f in schema.fields}
        return found.select(*[_typed(F.col(f"`{c}`"), known[c]) if c in known else F.col(f"`{c}`") for c in found.columns])
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def _typed(text: Column, target: T.StructField) -> Column:
    if isinstance(target.dataType, T.DateType):
        return F.to_date(parse_timestamp(text)).alias(target.name)
    if isinstance(target.dataType, T.TimestampType):
        return parse_timestamp(text).alias(target.name)
    if isinstance(target.dataType, T.LongType):
        # Counts written by other tools may look like "3.0".
        return text.try_cast("double").cast("long").alias(target.name)
    return text.try_cast(target.dataType).alias(target.name)


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Give costly per-row work on a small table to all cores.

    A table with fewer input splits than there are cores is shuffled by
    ``key``; a larger one already occupies them and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_alerts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw alerts; dates stay strings until they are parsed."""
    return read_table(spark, path, ALERT_RAW if fmt != "csv" else None, fmt)


def read_daily(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A daily series; unreadable dates become null."""
    return read_table(spark, path, DAILY, fmt)


def load_tables(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, T.StructType] = RESULT_TABLES, fmt: str = "parquet") -> dict[str, DataFrame]:
    """A named set of tables; one that is missing or unreadable is empty.

    Tables with a day column also get it as ``date``.
    """
    tables = {}
    for name, path in paths.items():
        try:
            table = read_table(spark, path, schemas.get(name), fmt)
            table.schema  # noqa: B018 - resolves the path
        except AnalysisException:
            table = spark.createDataFrame([], schemas.get(name, T.StructType([])))
        if "issued_date" in table.columns and "date" not in table.columns:
            table = table.withColumn("date", F.to_date("issued_date") if name != "alerts" else F.to_date(parse_timestamp(F.col("issued_date").cast("string"))))
        tables[name] = table
    return tables


def read_insights(spark: SparkSession, path: str, default: Sequence[str] = DEFAULT_INSIGHTS) -> DataFrame:
    """The stored insights as rows ``(seq, text)``; ``default`` when missing or invalid."""
    fallback = spark.createDataFrame(list(enumerate(default, 1)), "seq int, text string")
    try:
        stored = spark.read.schema(INSIGHTS).option("multiLine", True).json(path)
        rows = stored.filter(F.col("insights").isNotNull()).select(F.posexplode("insights").alias("seq", "text"))
        return fallback if rows.isEmpty() else rows.select((F.col("seq") + 1).alias("seq"), "text")
    except AnalysisException:
        return fallback


# Sinks ------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write a table; nested columns become JSON text in CSV."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


BATCHES = "_batches"


def append_batch(batch: DataFrame, path: str, ingest_date: Column, batch_seq: int) -> bool:
    """Append a batch to the raw table, in a partition of its own; whether it was new.

    One partitioned table is both the dated copy and the main table. The number of a
    batch is noted beside the data once all of it is written: one that comes again adds
    nothing, and what a failed attempt has left is replaced by the next. Readers take
    ``current_alerts`` of ``read_batches``, in which the latest batch wins.
    """
    context = batch.sparkSession.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCHES}/{batch_seq}")
    files = mark.getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(mark):
        return False
    dated = batch.withColumn("ingest_date", ingest_date.cast("date"))
    dated.write.partitionBy("ingest_date").mode("overwrite").parquet(f"{path}/batch_seq={batch_seq}")
    files.create(mark, False).close()
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches that are wholly written, with ``batch_seq`` and ``ingest_date``."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCHES}")
    listed = folder.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(folder)
    whole = sorted(int(s.getPath().getName()) for s in listed)
    found = spark.read.option("basePath", path).parquet(*[f"{path}/batch_seq={n}" for n in whole])
    return found.withColumn("batch_seq", F.col("batch_seq").cast("long"))


def current_alerts(raw: DataFrame, keys: Sequence[str] = ("alert_id",)) -> DataFrame:
    """The raw table without superseded copies."""
    return keep_last(raw, list(keys), ["batch_seq"])


def compact_alerts(spark: SparkSession, path: str, target: str, keys: Sequence[str] = ("alert_id",)) -> None:
    """Write a new snapshot of the raw table, each key once."""
    current_alerts(read_batches(spark, path), keys).write.partitionBy("ingest_date").mode("overwrite").parquet(target)


def write_processed(alerts: DataFrame, daily: DataFrame, base: str, fmt: str = "parquet") -> None:
    """Write processed alerts, their daily series and its dashboard copy below ``base``."""
    write_table(alerts, f"{base}/alerts_processed", fmt)
    write_table(daily, f"{base}/alerts_daily", fmt)
    # The copy is taken from the written series, which saves computing it twice.
    stored = daily.sparkSession.read.format(fmt)
    stored = stored.option("header", True) if fmt == "csv" else stored
    write_table(stored.load(f"{base}/alerts_daily"), f"{base}/dashboard_data", fmt)


def write_anomalies(anomalies: DataFrame, explanations: DataFrame, base: str, fmt: str = "parquet") -> None:
    """Write the anomaly table and the explanations as JSON."""
    write_table(anomalies, f"{base}/anomaly_results", fmt)
    explanations.write.mode("overwrite").json(f"{base}/anomaly_explanations")


def write_forecasts(forecasts: DataFrame, evaluation: DataFrame, base: str, fmt: str = "parquet") -> None:
    """Write the long forecast table and the evaluation as JSON."""
    write_table(forecasts, f"{base}/forecast_results", fmt)
    evaluation.write.mode("overwrite").json(f"{base}/forecast_evaluation")


def write_insights(document: DataFrame, path: str) -> None:
    """Write the one-row insights document as JSON."""
    document.write.mode("overwrite").json(path)
