"""Summary tables over alerts and daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.display import fixed
from barograph.functions.severity import freshness
from barograph.operators.daily import unpivot_types
from barograph.operators.series import rank_from_end
from barograph.schemas import ALERT_TYPES, CORRELATED_TYPES, DOMINANT_TYPES

DAY = "issued_date"


# Tables over alerts -----------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The ``n`` most frequent values, ties in value order."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(n)


def null_report(df: DataFrame) -> DataFrame:
    """``(column_name, nulls, null_ratio)``; one aggregate over the table."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(names)]
    )
    entry = [F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(names)]
    return counted.select("_rows", F.inline(F.array(*entry))).select(
        "column_name",
        "nulls",
        F.coalesce(F.try_divide(F.col("nulls").cast("double"), "_rows"), F.lit(0.0)).alias("null_ratio"),
    )


def record_summary(df: DataFrame, ts: str = DAY) -> DataFrame:
    """Record count, first and last day and the whole days between them."""
    start, end = F.min(ts), F.max(ts)
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.to_date(start).alias("start"),
        F.to_date(end).alias("end"),
        F.floor(seconds / 86400).alias("days"),
    )


def validation_report(df: DataFrame, required: Sequence[str], max_null_ratio: float = 0.5) -> DataFrame:
    """``(column_name, status)``: ok, missing, empty or mostly_null for each required column."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in present])

    def status(name: str) -> Column:
        if name not in present:
            return F.when(F.col("_rows") == 0, "empty").otherwise("missing")
        mostly = F.try_divide(F.col(f"_{name}").cast("double"), "_rows") > max_null_ratio
        return F.when(F.col("_rows") == 0, "empty").when(mostly, "mostly_null").otherwise("ok")

    entries = [F.struct(F.lit(c).alias("column_name"), status(c).alias("status")) for c in required]
    return counts.select(F.inline(F.array(*entries)))


def is_valid(df: DataFrame, required: Sequence[str]) -> bool:
    """True when the table has rows and all required columns."""
    return all(c in df.columns for c in required) and not df.isEmpty()


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The modal value as ``(name, value, n)``; ties go to the smallest value.

    Counts per value are aggregated first, so no task holds all values.
    """
    return (
        value_counts(df, column)
        .orderBy(F.desc("n"), column)
        .limit(1)
        .select(F.lit(column).alias("name"), F.col(column).cast("string").alias("value"), "n")
    )


def repository_summary(df: DataFrame) -> DataFrame:
    """Modal type, modal region and mean severity of an alert table."""
    mean = df.agg(
        F.lit("severity_score").alias("name"),
        fixed(F.avg("severity_score"), 2).alias("value"),
        F.count("severity_score").alias("n"),
    )
    return most_common(df, "type").unionByName(most_common(df, "region")).unionByName(mean)


def recent_alerts(df: DataFrame, n: int = 25, ts: str = DAY, id_col: str = "alert_id", columns: Sequence[str] = ("type", "region", "severity_score")) -> DataFrame:
    """The ``n`` latest alerts, ties by descending id."""
    kept = [c for c in columns if c in df.columns]
    return (
        df.orderBy(F.col(ts).desc(), F.col(id_col).desc())
        .limit(n)
        .select(id_col, F.date_format(ts, "yyyy-MM-dd HH:mm").alias(ts), *kept)
    )


def week_over_week(df: DataFrame, keys: Sequence[str], as_of: Column | None = None, ts: str = DAY) -> DataFrame:
    """Alerts of the last 7 days against the 7 before, per key.

    ``as_of`` is the last day that counts, by default the latest day of the
    whole table. The ratio is null without earlier alerts.
    """
    day = F.to_date(ts)
    counts = df.filter(F.col(ts).isNotNull()).groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    if as_of is None:
        as_of = df.agg(F.max(day)).scalar()
    age = F.date_diff(as_of, F.col("_day"))
    this, last = age.between(0, 6), age.between(7, 13)
    sums = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(this, F.col("_n"))), F.lit(0)).alias("this_week"),
        F.coalesce(F.sum(F.when(last, F.col("_n"))), F.lit(0)).alias("last_week"),
    )
    ratio = F.try_divide(F.col("this_week").cast("double"), F.col("last_week"))
    return sums.select("*", ratio.alias("ratio"), F.coalesce(ratio >= 2, F.lit(False)).alias("doubled"))


def freshness_report(tables: dict[str, tuple[DataFrame, str]], as_of: Column) -> DataFrame:
    """Age and status of each named table from its latest timestamp, ``(df, ts column)``."""
    report = None
    for name, (df, ts) in tables.items():
        latest = df.agg(F.lit(name).alias("table_name"), F.max(F.col(ts).cast("timestamp")).alias("last_updated"))
        report = latest if report is None else report.unionByName(latest)
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("last_updated")) / 3600.0
    return report.select("*", age.alias("age_hours")).select("*", freshness(F.col("age_hours")).alias("status"))


# Tables over daily series -----------------------------------------------------


def type_share(daily: DataFrame, types: Sequence[str] = ALERT_TYPES) -> DataFrame:
    """Total and share of each type."""
    present = [t for t in types if t in daily.columns]
    sums = daily.agg(*[F.sum(t).alias(t) for t in present])
    overall = sum((F.coalesce(F.col(t), F.lit(0)) for t in present), F.lit(0))
    entries = [F.struct(F.lit(t).alias("type"), F.coalesce(F.col(t), F.lit(0)).alias("total")) for t in present]
    return sums.select(overall.alias("_all"), F.inline(F.array(*entries))).select(
        "type", "total", F.try_divide(F.col("total").cast("double"), "_all").alias("share")
    )


def kpis(daily: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Total, mean and peak, mean of the last 7 days and its change to the 7 before."""
    total = F.col("total_alerts")
    ranked = daily.select(*keys, total, rank_from_end(keys, day).alias("_rank"))
    rank = F.col("_rank")
    out = ranked.groupBy(*keys).agg(
        F.sum(total).alias("total_alerts"),
        F.avg(total).alias("avg_daily"),
        F.max(total).alias("peak_daily"),
        F.avg(F.when(rank <= 7, total)).alias("recent_avg"),
        F.when(F.count(F.lit(1)) >= 14, F.avg(F.when(rank.between(8, 14), total))).otherwise(0.0).alias("previous_avg"),
    )
    change = F.try_divide(F.col("recent_avg") - F.col("previous_avg"), F.col("previous_avg")) * 100
    return out.withColumn("change_pct", F.when(F.col("previous_avg") > 0, change).otherwise(0.0))


def correlation_matrix(daily: DataFrame, types: Sequence[str] = CORRELATED_TYPES) -> DataFrame:
    """Pearson correlation of the per-type columns in long form, null for constant columns.

    All pairs come from one aggregate; each pair is computed once.
    """
    present = [t for t in types if t in daily.columns]
    if len(present) < 2:
        raise ValueError("at least two types are needed")
    pairs = [(i, j) for i in range(len(present)) for j in range(i, len(present))]

    def r(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    matrix = daily.agg(*[r(present[i], present[j]).alias(f"_{i}_{j}") for i, j in pairs])
    entries = [
        F.struct(
            F.lit(present[i]).alias("type_a"),
            F.lit(present[j]).alias("type_b"),
            F.col(f"_{min(i, j)}_{max(i, j)}").alias("correlation"),
        )
        for i in range(len(present))
        for j in range(len(present))
    ]
    return matrix.select(F.inline(F.array(*entries)))


def monthly_averages(daily: DataFrame, value: str = "total_alerts", keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Mean per calendar month beside the mean of the monthly means."""
    months = daily.groupBy(*keys, F.month(day).alias("month")).agg(F.avg(value).alias("month_avg"))
    # At most twelve rows per series remain.
    return months.withColumn("yearly_avg", F.avg("month_avg").over(Window.partitionBy(*keys)))


def dominant_type(
    daily: DataFrame, types: Sequence[str] = DOMINANT_TYPES, days: int = 7, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """The most frequent type of the last ``days`` days; ties go to the first listed."""
    present = [t for t in types if t in daily.columns]
    ranked = daily.select(*keys, *present, rank_from_end(keys, day).alias("_rank")).filter(F.col("_rank") <= days)
    sums = ranked.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in present])
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(t).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("type"))
                for i, t in enumerate(present)
            ]
        )
    )
    return (
        sums.select(*keys, best.alias("_best"))
        .filter(F.col("_best.n") > 0)
        .select(*keys, F.col("_best.type").alias("type"), F.col("_best.n").alias("n"))
    )


def metric_correlation(daily: DataFrame, metric: DataFrame, on: Sequence[str], metric_col: str, value: str = "total_alerts", by: Sequence[str] = ()) -> DataFrame:
    """Correlation of a daily metric with the alert counts, joined on e.g. region and day."""
    joined = daily.select(*on, value).join(metric.select(*on, metric_col), list(on))
    return joined.groupBy(*by).agg(
        F.try_divide(F.covar_pop(value, metric_col), F.stddev_pop(value) * F.stddev_pop(metric_col)).alias("correlation"),
        F.count(F.lit(1)).alias("n_days"),
    )


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Number and rate of anomalies and of severe ones."""
    hit = F.col("is_anomaly")
    n = F.count_if(hit)
    return anomalies.agg(
        n.alias("total_anomalies"),
        F.count(F.lit(1)).alias("total_days"),
        F.coalesce(F.try_divide(n.cast("double"), F.count(F.lit(1))) * 100, F.lit(0.0)).alias("anomaly_rate"),
        F.count_if(hit & F.col("anomaly_severity").isin("high", "critical")).alias("high_severity"),
    )


def severity_breakdown(anomalies: DataFrame) -> DataFrame:
    """Anomalies per severity label."""
    return anomalies.filter("is_anomaly").groupBy("anomaly_severity").agg(F.count(F.lit(1)).alias("n"))


def timeline(daily: DataFrame, anomalies: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """The daily series with the anomaly flag of each day, false where none is known."""
    flags = anomalies.select(*keys, day, "is_anomaly", "anomaly_severity")
    joined = daily.join(flags, [*keys, day], "left")
    severity = [(F.col("severity_score") * 100).alias("severity_index")] if "severity_score" in daily.columns else []
    return joined.select(
        *keys,
        day,
        "total_alerts",
        *[c for c in ("7_day_avg",) if c in daily.columns],
        *severity,
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        "anomaly_severity",
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Mean, highest and lowest forecast."""
    return forecasts.agg(
        F.avg("forecast").alias("avg_forecast"), F.max("forecast").alias("max_forecast"), F.min("forecast").alias("min_forecast")
    )


# Keywords ---------------------------------------------------------------------


def keyword_counts(df: DataFrame, tokens: Column, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every token, overall or per day, type or other column.

    The aggregation is partial before its shuffle, so frequent words do not
    pile up in one task.
    """
    exploded = df.select(*by, F.explode(tokens).alias("token"))
    return exploded.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
