"""Scores, labels and bins of single alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barograph.schemas import CATEGORY_OF_TYPE, SEVERITY_BASE

# Lower limits (exclusive) of the sentiment labels, highest first.
SENTIMENT_LABELS = [(0.3, "urgent_negative"), (0.1, "cautionary"), (-0.1, "neutral"), (-0.3, "concern")]
LOWEST_LABEL = "severe"

# Upper limits (inclusive) of the confidence bins.
CONFIDENCE_BINS = [(0.1, "low"), (0.3, "medium"), (0.5, "high")]
HIGHEST_BIN = "critical"

# Upper limits (exclusive) of the risk bands.
RISK_BANDS = [(30, "low"), (60, "guarded"), (80, "elevated")]
HIGHEST_BAND = "critical"
RISK_ALARM = 80
RISK_REFERENCE = 50


def sentiment_label(
    score: Column,
    limits: Sequence[tuple[float, str]] = SENTIMENT_LABELS,
    lowest: str = LOWEST_LABEL,
) -> Column:
    """Label of the first limit that the score exceeds."""
    (first, name), *rest = limits
    chain = F.when(score > first, name)
    for limit, label in rest:
        chain = chain.when(score > limit, label)
    return chain.otherwise(lowest)


def alert_category(alert_type: Column, categories: Mapping[str, str] = CATEGORY_OF_TYPE) -> Column:
    """Category of a type, ``other`` when unknown or null."""
    table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(alert_type)), F.lit("other"))


def severity_score(
    severity: Column | None,
    sentiment: Column | None = None,
    urgency: Column | None = None,
    exclamations: Column | None = None,
    base: Mapping[str, float] = SEVERITY_BASE,
) -> Column:
    """Severity of one alert in 0..1 from its fields and its wording.

    A missing column (``None``) differs from a null: without a severity field
    the base is 0.3, with an unknown one 0.1.
    """
    if severity is None:
        score = F.lit(0.3)
    else:
        table = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
        score = F.coalesce(F.element_at(table, F.lower(severity)), F.lit(0.1))
    if sentiment is not None:
        score = score + F.abs(F.least(F.coalesce(sentiment, F.lit(0.0)), F.lit(0.0))) * 0.5
    if urgency is not None:
        score = score + F.least(F.coalesce(urgency, F.lit(0)) * F.lit(0.1), F.lit(0.3))
    if exclamations is not None:
        score = score + F.least(F.coalesce(exclamations, F.lit(0)) * F.lit(0.05), F.lit(0.2))
    return F.least(score, F.lit(1.0))


def confidence_bin(confidence: Column) -> Column:
    """low, medium, high or critical; upper limits belong to the lower bin."""
    chain = F.when(confidence.isNull(), F.lit(None).cast("string"))
    for limit, label in CONFIDENCE_BINS:
        chain = chain.when(confidence <= limit, label)
    return chain.otherwise(HIGHEST_BIN)


def confidence_rank(label: Column) -> Column:
    """1..4 for the ordered severity labels, for sorting."""
    ordered = [label_ for _, label_ in CONFIDENCE_BINS] + [HIGHEST_BIN]
    return F.array_position(F.array(*[F.lit(x) for x in ordered]), label).cast("int")


def risk_band(risk: Column) -> Column:
    """Band of a 0..100 risk score."""
    chain = F.when(risk.isNull(), F.lit(None).cast("string"))
    for limit, label in RISK_BANDS:
        chain = chain.when(risk < limit, label)
    return chain.otherwise(HIGHEST_BAND)


def freshness(age_hours: Column) -> Column:
    """fresh (<24 h), stale (<72 h), outdated, or N/A without data."""
    return (
        F.when(age_hours.isNull(), "N/A")
        .when(age_hours < 24, "fresh")
        .when(age_hours < 72, "stale")
        .otherwise("outdated")
    )


def alert_key(title: Column, issued: Column, region: Column) -> Column:
    """Stable content key of an alert, equal in every process and run."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (title, issued, region)]
    return F.sha2(F.concat_ws("|", *parts), 256)
