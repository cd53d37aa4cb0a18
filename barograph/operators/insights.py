"""Plain-English findings as a table ``(seq, rule, text)``.

Every rule reads one-row aggregates of the daily series, the anomalies or the
forecasts and gives one sentence or none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.display import fixed
from barograph.operators.filters import existing_columns
from barograph.operators.series import rank_from_end
from barograph.operators.stats import dominant_type
from barograph.schemas import DOMINANT_TYPES

NO_DATA = "No historical data available for analysis."
OPERATIONAL = "System operational. Monitoring weather alerts for anomalies."


def _sentence(table: DataFrame, seq: int, rule: str, text: Column) -> DataFrame:
    return table.select(F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), text.alias("text"))


def activity(daily: DataFrame, day: str = "issued_date") -> DataFrame:
    """Mean of the last week against the week before, or the note that there is no data."""
    total = F.col("total_alerts")
    rank = F.col("_rank")
    means = daily.select(total, rank_from_end((), day).alias("_rank")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(rank <= 7, total)).alias("recent"),
        F.avg(F.when(rank.between(8, 14), total)).alias("before"),
    )
    recent = F.col("recent")
    before = F.when(F.col("n") >= 14, F.col("before")).otherwise(0.0)
    compared = F.concat(
        F.lit(" in the past week (average "), fixed(recent, 1), F.lit(" alerts/day vs "), fixed(before, 1), F.lit(" previously).")
    )
    text = (
        F.when(F.col("n") == 0, NO_DATA)
        .when((recent > before * 1.5) & (before > 0), F.concat(F.lit("Alert activity has increased significantly"), compared))
        .when((recent < before * 0.7) & (before > 0), F.concat(F.lit("Alert activity has decreased"), compared))
        .otherwise(F.concat(F.lit("Alert activity remains stable at around "), fixed(recent, 1), F.lit(" alerts per day.")))
    )
    return _sentence(means, 1, "activity", text)


def recent_anomalies(anomalies: DataFrame, days: int = 30, day: str = "issued_date") -> DataFrame:
    """Anomalous days of the last month, and how many of them are severe."""
    severity = "anomaly_severity" if "anomaly_severity" in anomalies.columns else None
    ranked = anomalies.withColumn("_rank", rank_from_end((), day)).filter(F.col("_rank") <= days)
    hit = F.coalesce("is_anomaly", F.lit(False))
    counts = ranked.agg(
        F.count_if(hit).alias("n"),
        F.max(F.when(hit, F.col(day))).alias("latest"),
        (F.count_if(hit & F.col(severity).isin("high", "critical")) if severity else F.lit(0)).alias("severe"),
    )
    n, severe = F.col("n"), F.col("severe")
    found = F.format_string("Detected %d anomalous days in the past month, most recently on %s.", n, F.date_format("latest", "MMMM dd"))
    strong = F.format_string("Found %d high-severity anomalies requiring attention.", severe)
    return _sentence(counts, 2, "anomalies", F.when(n > 0, found)).unionByName(
        _sentence(counts, 3, "severe_anomalies", F.when(severe > 0, strong))
    )


def outlook(daily: DataFrame, forecasts: DataFrame, day: str = "issued_date") -> DataFrame:
    """The forecast mean against the current mean."""
    ahead = (
        forecasts.filter(F.col("target") == "total_alerts")
        .withColumn("_rank", rank_from_end((), "date"))
        .filter(F.col("_rank") <= 7)
        .agg(F.avg("forecast"))
        .scalar()
    )
    current = (
        daily.select("total_alerts", rank_from_end((), day).alias("_rank"))
        .filter(F.col("_rank") <= 7)
        .agg(F.avg("total_alerts").alias("current"))
        .withColumn("ahead", ahead)
    )
    x, now = F.col("ahead"), F.col("current")
    note = F.concat(F.lit(" alert activity in the coming week (average "), fixed(x, 1), F.lit(" alerts/day expected)."))
    text = F.when(x > now * 1.2, F.concat(F.lit("Forecast predicts increased"), note)).when(
        x < now * 0.8, F.concat(F.lit("Forecast predicts decreased"), note)
    )
    return _sentence(current, 4, "outlook", text)


def frequent_type(daily: DataFrame, types: Sequence[str] = DOMINANT_TYPES, day: str = "issued_date") -> DataFrame:
    """The dominant type of the last week."""
    text = F.concat(F.lit("Most frequent alert type recently: "), F.initcap("type"), F.lit(" alerts."))
    return _sentence(dominant_type(daily, types, day=day), 5, "frequent_type", text)


def season(daily: DataFrame, as_of: Column, day: str = "issued_date") -> DataFrame:
    """Whether the month of ``as_of`` usually has more alerts; needs over a year of days."""
    months = daily.groupBy(F.month(day).alias("month")).agg(
        F.avg("total_alerts").alias("avg"), F.count(F.lit(1)).alias("n")
    )
    means = months.agg(
        F.max(F.when(F.col("month") == F.month(as_of), F.col("avg"))).alias("month_avg"),
        F.avg("avg").alias("yearly_avg"),
        F.sum("n").alias("n"),
    )
    high = (F.col("n") > 365) & (F.col("month_avg") > F.col("yearly_avg") * 1.3)
    text = F.concat(
        F.lit("Current month typically sees higher than average alert activity ("),
        fixed(F.col("month_avg"), 1),
        F.lit(" vs yearly average "),
        fixed(F.col("yearly_avg"), 1),
        F.lit(")."),
    )
    return _sentence(means, 6, "season", F.when(high, text))


def insights(
    daily: DataFrame,
    anomalies: DataFrame | None = None,
    forecasts: DataFrame | None = None,
    as_of: Column | None = None,
    types: Sequence[str] = DOMINANT_TYPES,
    day: str = "issued_date",
) -> DataFrame:
    """All findings in order; rules without their input are left out."""
    if "total_alerts" not in daily.columns:
        return _sentence(daily.sparkSession.range(1), 1, "operational", F.lit(OPERATIONAL))
    rules = [activity(daily, day)]
    if anomalies is not None and "is_anomaly" in anomalies.columns:
        rules.append(recent_anomalies(anomalies, day=day))
    if forecasts is not None:
        rules.append(outlook(daily, forecasts, day))
    if existing_columns(daily, types):
        rules.append(frequent_type(daily, types, day))
    if as_of is not None:
        rules.append(season(daily, as_of, day))
    found = rules[0]
    for rule in rules[1:]:
        found = found.unionByName(rule)
    return found.filter(F.col("text").isNotNull())


def first_insights(found: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` findings."""
    return found.orderBy("seq").limit(n)


def insights_document(found: DataFrame, generated_at: Column) -> DataFrame:
    """One row ``(generated_at, insights)``; the list is bounded by the number of rules."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return found.agg(F.transform(ordered, lambda e: e["text"]).alias("insights")).select(
        generated_at.cast("timestamp").alias("generated_at"), "insights"
    )
