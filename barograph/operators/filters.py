"""Filters on alerts, anomalies and forecasts. All of them reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERE_LABELS = ["high", "critical"]


def valid_dates(df: DataFrame, ts: str = "issued_date") -> DataFrame:
    """Rows that have a date."""
    return df.filter(F.col(ts).isNotNull())


def anomalies_only(df: DataFrame) -> DataFrame:
    """Rows flagged as anomalies."""
    return df.filter(F.col("is_anomaly"))


def severe_anomalies(df: DataFrame, labels: Sequence[str] = SEVERE_LABELS) -> DataFrame:
    """Anomalies of the given severity labels."""
    return df.filter(F.col("is_anomaly") & F.col("anomaly_severity").isin(*labels))


def date_range(df: DataFrame, start, end, ts: str = "issued_date") -> DataFrame:
    """Rows from ``start`` up to and including the day ``end``.

    The timestamp itself is compared, so Parquet row groups can be skipped.
    """
    dtype = dict(df.dtypes)[ts]
    first = F.lit(start).cast("date").cast(dtype)
    after = F.date_add(F.lit(end).cast("date"), 1).cast(dtype)
    return df.filter((F.col(ts) >= first) & (F.col(ts) < after))


def by_values(df: DataFrame, **allowed: Sequence) -> DataFrame:
    """Rows whose columns hold one of the given values, e.g. ``region=[…], type=[…]``."""
    for name, values in allowed.items():
        if values is not None:
            df = df.filter(F.col(name).isin(*values))
    return df


def retain_recent(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    dtype = dict(df.dtypes)[ts]
    limit = (as_of.cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")).cast(dtype)
    return df.filter(F.col(ts) >= limit)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the given columns."""
    return df.na.drop(subset=list(columns))


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the table has, in the wanted order."""
    return [c for c in wanted if c in df.columns]
