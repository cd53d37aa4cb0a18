"""Numbers and dates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Exactly ``digits`` decimals, no grouping; exact ties go to the even digit."""
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def format_number(value: Column) -> Column:
    """Short readable form: N/A, 1.5M, 2.0K, 0, 1.00e-03, 0.250, 12.3, 250."""
    v = value.cast("double")
    size = F.abs(v)
    return (
        F.when(v.isNull() | F.isnan(v), "N/A")
        .when(v >= 1_000_000, F.concat(fixed(v / 1_000_000, 1), F.lit("M")))
        .when(v >= 1_000, F.concat(fixed(v / 1_000, 1), F.lit("K")))
        .when(v == 0, "0")
        .when(size < 0.01, F.format_string("%.2e", v))
        .when(size < 1, fixed(v, 3))
        .when(size < 100, fixed(v, 1))
        .otherwise(fixed(v, 0))
    )


def change_metrics(current: Column, previous: Column, significant_above: float = 10.0) -> Column:
    """``struct<change, percentage, direction, significant>``; all neutral when previous is 0."""
    cur, prev = current.cast("double"), previous.cast("double")
    change = cur - prev
    percentage = F.abs(F.try_divide(change, prev) * 100)
    usable = prev != 0
    return F.struct(
        F.when(usable, change).otherwise(0.0).alias("change"),
        F.when(usable, percentage).otherwise(0.0).alias("percentage"),
        F.when(usable & (change > 0), "increase")
        .when(usable & (change < 0), "decrease")
        .otherwise("neutral")
        .alias("direction"),
        F.coalesce(usable & (percentage > significant_above), F.lit(False)).alias("significant"),
    )


def anomaly_display(day: Column, total: Column, severity: Column, confidence: Column) -> list[Column]:
    """Columns of the anomaly table as shown to readers."""
    return [
        F.date_format(day, "yyyy-MM-dd").alias("Date"),
        total.alias("Alert Count"),
        severity.alias("Severity Level"),
        fixed(confidence, 3).alias("Confidence Score"),
    ]
