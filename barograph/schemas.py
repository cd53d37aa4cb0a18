"""Record schemas and the fixed vocabularies of the alert domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values -----------------------------------------------------------------

ALERT_TYPES = ["flood", "storm", "wind", "winter", "fire", "heat", "cold", "coastal", "air", "other"]
CORRELATED_TYPES = ["flood", "storm", "wind", "winter", "fire", "heat", "cold", "coastal", "air"]
DOMINANT_TYPES = ["flood", "storm", "wind", "winter", "fire", "heat", "cold"]

# Ordered: the first type with a matching phrase wins.
TYPE_PHRASES = {
    "flood": ["flood", "flooding", "flash flood", "river flood"],
    "storm": ["storm", "thunderstorm", "severe storm", "hail", "tornado"],
    "wind": ["wind", "high wind", "wind advisory"],
    "winter": ["winter", "snow", "ice", "blizzard", "freez", "frost"],
    "fire": ["fire", "red flag", "fire weather"],
    "heat": ["heat", "excessive heat", "heat advisory"],
    "cold": ["cold", "wind chill", "extreme cold"],
    "coastal": ["coastal", "surf", "high surf", "rip current"],
    "air": ["air quality", "air stagnation"],
    "other": ["special weather", "advisory", "watch", "warning"],
}

CATEGORY_OF_TYPE = {
    "flood": "hydrological",
    "storm": "meteorological",
    "wind": "meteorological",
    "winter": "meteorological",
    "fire": "environmental",
    "heat": "environmental",
    "cold": "environmental",
    "coastal": "oceanic",
    "air": "environmental",
    "other": "other",
}

SEVERITY_BASE = {"extreme": 1.0, "severe": 0.8, "moderate": 0.5, "minor": 0.2, "unknown": 0.1}

SEVERITY_WORDS = {
    "severe": ["severe", "extreme", "dangerous", "emergency", "catastrophic"],
    "moderate": ["moderate", "significant", "considerable"],
    "minor": ["minor", "light", "scattered", "isolated"],
}

REGIONS_OF_INTEREST = ["National", "Regional", "State", "County"]

FORECAST_TARGETS = ["total_alerts", "flood", "storm", "wind"]

# Record schemas ---------------------------------------------------------------

ALERT_RAW = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("issued_date", T.StringType()),
        T.StructField("effective_date", T.StringType()),
        T.StructField("expires_date", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("certainty", T.StringType()),
        T.StructField("urgency", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
    ]
)

DAILY_MEANS = ["severity_score", "sentiment_score", "word_count"]

DAILY = T.StructType(
    [T.StructField("issued_date", T.DateType()), T.StructField("total_alerts", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in DAILY_MEANS]
    + [T.StructField(c, T.LongType()) for c in ALERT_TYPES]
    + [
        T.StructField(c, T.DoubleType())
        for c in ["alert_intensity", "7_day_avg", "30_day_avg", "day_over_day_change"]
    ]
)

ANOMALY_COLUMNS = [
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("anomaly_confidence", T.DoubleType()),
    T.StructField("anomaly_severity", T.StringType()),
]

ANOMALIES = T.StructType(DAILY.fields + ANOMALY_COLUMNS)

FORECASTS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("target", T.StringType()),
        T.StructField("forecast", T.DoubleType()),
        T.StructField("lower_bound", T.DoubleType()),
        T.StructField("upper_bound", T.DoubleType()),
    ]
)

INSIGHTS = T.StructType(
    [T.StructField("generated_at", T.TimestampType()), T.StructField("insights", T.ArrayType(T.StringType()))]
)
