"""Timestamp parsing and calendar features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(value: Column, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a string in ISO form or one of ``formats``; null when unreadable."""
    tries = [F.try_to_timestamp(value)] + [F.try_to_timestamp(value, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def time_parts(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Monday 0), day of year, ISO week, month and year."""
    return {"hour": F.hour(ts), **day_parts(ts), "year": F.year(ts)}


def day_parts(day: Column) -> dict[str, Column]:
    """The four calendar numbers the anomaly features use."""
    return {
        "day_of_week": F.weekday(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
        "month": F.month(day),
    }


def calendar_features(day: Column) -> dict[str, Column]:
    """Calendar numbers and their positions on the weekly and yearly circle."""
    dow, month = F.weekday(day), F.month(day)
    week_angle = dow * F.lit(2 * math.pi) / 7
    year_angle = month * F.lit(2 * math.pi) / 12
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "month": month,
        "quarter": F.quarter(day),
        "year": F.year(day),
        "day_of_week_sin": F.sin(week_angle),
        "day_of_week_cos": F.cos(week_angle),
        "month_sin": F.sin(year_angle),
        "month_cos": F.cos(year_angle),
    }
