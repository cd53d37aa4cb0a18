"""The star-schema and event tables in the shape of alerts and daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.operators.daily import daily_series, fill_days
from barograph.sources.tables import spread_small

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SEVERITY_SCALE = 491.0
SEVERITIES = ["Extreme", "Severe", "Moderate", "Minor", "Unknown"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table of long texts, spread over all cores where it is small."""
    return spread_small(read(spark, sf_dir, name), key)


def event_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts: eight regions by user, severity from the value."""
    return as_event_alerts(read(spark, sf_dir, "events"))


def as_event_alerts(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("alert_id"),
        F.col("ts").alias("issued_date"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("region_"), F.pmod("user_id", F.lit(8))).alias("region"),
        F.least(F.col("value") / SEVERITY_SCALE, F.lit(1.0)).alias("severity_score"),
    )


def document_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as alerts of thirty days in 2024, typed by their text."""
    return read_texts(spark, sf_dir).select(
        F.col("doc_id").alias("alert_id"),
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("region"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.pmod("doc_id", F.lit(5)).cast("int") + 1).alias("severity"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(30)).cast("int")).cast("timestamp_ntz").alias("issued_date"),
    )


def event_daily(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The daily series of the events."""
    return daily_series(event_alerts(spark, sf_dir), keys, EVENT_TYPES)


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long daily series of the orders: ``issued_date, total_alerts``."""
    counts = (
        read(spark, sf_dir, "orders")
        .filter("o_orderdate IS NOT NULL")
        .groupBy(F.to_date("o_orderdate").alias("issued_date"))
        .agg(F.count(F.lit(1)).alias("total_alerts"))
    )
    return fill_days(counts)


ORDER_TYPES = ["urgent", "high", "medium", "not_specified", "low"]


def order_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alerts: type from the priority, severity from the price, region by nation."""
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    located = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )
    return located.select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_orderdate").alias("issued_date"),
        order_type().alias("type"),
        F.col("n_name").alias("region"),
        F.least(F.col("o_totalprice") / 500_000.0, F.lit(1.0)).alias("severity_score"),
    )


def order_type():
    """``1-URGENT`` → ``urgent``, ``4-NOT SPECIFIED`` → ``not_specified``."""
    return F.lower(F.replace(F.substring_index("o_orderpriority", "-", -1), F.lit(" "), F.lit("_")))


def order_full_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series of the orders with type counts, severity and trends."""
    alerts = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_orderdate").alias("issued_date"),
        order_type().alias("type"),
        F.least(F.col("o_totalprice") / 500_000.0, F.lit(1.0)).alias("severity_score"),
    )
    return daily_series(alerts, (), ORDER_TYPES)
