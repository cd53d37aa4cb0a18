"""From alerts to gap-free daily series.

The alerts are reduced with one partial+final aggregation, so a key or a day
that holds a large share of the rows costs no more than any other. Everything
after that runs on at most one row per key and calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barograph.schemas import ALERT_TYPES, DAILY_MEANS


def series_window(keys: Sequence[str] = (), day: str = "issued_date") -> WindowSpec:
    """Days in order within each series."""
    return Window.partitionBy(*keys).orderBy(day)


def discover_types(df: DataFrame, type_col: str = "type", limit: int = 200) -> list[str]:
    """The distinct types, for ``types=``; more than ``limit`` is an error, not a cut."""
    rows = df.select(type_col).na.drop().distinct().orderBy(type_col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values in {type_col}; use it as a key instead")
    return [r[0] for r in rows]


def daily_counts(
    df: DataFrame,
    keys: Sequence[str] = (),
    types: Sequence[str] = ALERT_TYPES,
    ts: str = "issued_date",
    id_col: str | None = "alert_id",
    type_col: str = "type",
    means: Sequence[str] = DAILY_MEANS,
) -> DataFrame:
    """Counts, means and one count per type for every (keys, day) that has alerts."""
    counted = F.count(id_col) if id_col and id_col in df.columns else F.count(F.lit(1))
    aggregates = [counted.alias("total_alerts")]
    aggregates += [F.avg(c).alias(c) for c in means if c in df.columns]
    if type_col in df.columns:
        aggregates += [F.count_if(F.col(type_col) == t).alias(t) for t in types]
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.to_date(ts).alias("issued_date"))
        .agg(*aggregates)
    )


def fill_days(df: DataFrame, keys: Sequence[str] = (), day: str = "issued_date") -> DataFrame:
    """Emit every calendar day between a series' first and last, new days as zeros.

    Each row is stretched up to the day before its successor. That needs one
    window over the series and neither a spine table nor a join, and later
    windows over the same keys reuse its partitioning.
    """
    values = [c for c in df.columns if c not in keys and c != day]
    following = F.lead(day).over(series_window(keys, day))
    bounded = df.withColumn("_last", F.coalesce(F.date_sub(following, 1), F.col(day)))
    stretched = bounded.select(
        *df.columns, F.posexplode(F.sequence(F.col(day), F.col("_last"))).alias("_gap", "_day")
    )
    types = dict(df.dtypes)
    return stretched.select(
        *keys,
        F.col("_day").alias(day),
        *[
            F.when(F.col("_gap") == 0, F.coalesce(F.col(c), F.lit(0).cast(types[c])))
            .otherwise(F.lit(0).cast(types[c]))
            .alias(c)
            for c in values
        ],
    )


def with_trends(df: DataFrame, keys: Sequence[str] = (), day: str = "issued_date") -> DataFrame:
    """Add intensity, 7- and 30-day averages and the day-over-day change in percent."""
    w = series_window(keys, day)
    total = F.col("total_alerts")
    previous = F.lag(total).over(w)
    intensity = (
        [(total * F.col("severity_score")).alias("alert_intensity")] if "severity_score" in df.columns else []
    )
    return df.select(
        "*",
        *intensity,
        F.avg(total).over(w.rowsBetween(-6, 0)).alias("7_day_avg"),
        F.avg(total).over(w.rowsBetween(-29, 0)).alias("30_day_avg"),
        (F.try_divide((total - previous).cast("double"), previous) * 100).alias("day_over_day_change"),
    )


def daily_series(
    df: DataFrame,
    keys: Sequence[str] = (),
    types: Sequence[str] = ALERT_TYPES,
    ts: str = "issued_date",
    id_col: str | None = "alert_id",
    type_col: str = "type",
    means: Sequence[str] = DAILY_MEANS,
) -> DataFrame:
    """The gap-free daily series of alerts with its trend columns."""
    counts = daily_counts(df, keys, types, ts, id_col, type_col, means)
    return with_trends(fill_days(counts, keys), keys)


def subtotals(df: DataFrame, dims: Sequence[str], mode: str = "rollup") -> DataFrame:
    """Alert counts by the dimensions with their subtotals; ``level`` is the grouping id."""
    grouped = {"rollup": df.rollup, "cube": df.cube}[mode](*dims)
    return grouped.agg(F.count(F.lit(1)).alias("total_alerts"), F.grouping_id().alias("level"))


def unpivot_types(df: DataFrame, types: Sequence[str], keys: Sequence[str] = (), day: str = "issued_date") -> DataFrame:
    """Long form ``(keys, day, type, total_alerts)`` of the per-type columns."""
    return df.unpivot([*keys, day], list(types), "type", "total_alerts")
