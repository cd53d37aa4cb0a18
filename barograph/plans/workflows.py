"""The stages from raw alerts to insights, each reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from barograph.operators.anomaly import AnomalyModel, explain_anomalies, fit_anomaly_model
from barograph.operators.daily import daily_series
from barograph.operators.enrich import process_alerts
from barograph.operators.forecast import ForecastModel, choose_targets, default_forecast, evaluate_forecaster, fit_forecaster
from barograph.operators.insights import insights, insights_document
from barograph.schemas import ALERT_TYPES
from barograph.sources import tables as io


@dataclass
class Settings:
    """Choices of a full run; ``keys=[]`` gives one national series."""

    base: str
    types: Sequence[str] = tuple(ALERT_TYPES)
    contamination: float = 0.1
    horizon: int = 7
    fmt: str = "parquet"
    forecast_params: dict | None = None


def preprocess(spark: SparkSession, raw: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Enrich alerts, aggregate them by day, and store both.

    The series is computed from the stored alerts, so texts are parsed once.
    """
    io.write_table(process_alerts(raw), f"{settings.base}/alerts_processed", settings.fmt)
    alerts = _stored(spark, "alerts_processed", settings)
    io.write_table(daily_series(alerts, types=settings.types), f"{settings.base}/alerts_daily", settings.fmt)
    daily = _stored(spark, "alerts_daily", settings)
    io.write_table(daily, f"{settings.base}/dashboard_data", settings.fmt)
    return alerts, daily


def _stored(spark: SparkSession, name: str, settings: Settings) -> DataFrame:
    reader = spark.read.format(settings.fmt)
    if settings.fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", True)
    return reader.load(f"{settings.base}/{name}")


def detect(spark: SparkSession, daily: DataFrame, settings: Settings, model: AnomalyModel | None = None, save_to: str | None = None) -> DataFrame:
    """Flag anomalous days with a given or newly fitted model and store flags and reasons."""
    if model is None:
        model = fit_anomaly_model(daily, settings.types, contamination=settings.contamination)
        if save_to:
            model.save(save_to)
    result = model.predict(daily)
    io.write_table(result, f"{settings.base}/anomaly_results", settings.fmt)
    stored = _stored(spark, "anomaly_results", settings)
    explain_anomalies(stored).write.mode("overwrite").json(f"{settings.base}/anomaly_explanations")
    return stored


def predict(
    spark: SparkSession, daily: DataFrame, settings: Settings, model: ForecastModel | None = None, save_to: str | None = None, fallback_day: Column | None = None
) -> DataFrame:
    """Forecast the chosen targets and store forecasts and cross-validation errors.

    Without a usable model this is an error, unless ``fallback_day`` asks for
    the placeholder forecast from that day on.
    """
    targets = choose_targets([c for c in daily.columns if c != "issued_date"])
    if model is None:
        model = fit_forecaster(daily, targets, params=settings.forecast_params)
        if save_to and model.models:
            model.save(save_to)
    if model.models:
        forecasts = model.forecast(daily, settings.horizon)
        evaluation = evaluate_forecaster(daily, list(model.models), params=settings.forecast_params)
        evaluation.write.mode("overwrite").json(f"{settings.base}/forecast_evaluation")
    elif fallback_day is not None:
        forecasts = default_forecast(spark, fallback_day, settings.horizon)
    else:
        raise ValueError(f"no target can be forecast: {model.skipped}")
    io.write_table(forecasts, f"{settings.base}/forecast_results", settings.fmt)
    return _stored(spark, "forecast_results", settings)


def report(daily: DataFrame, anomalies: DataFrame, forecasts: DataFrame, as_of: Column, settings: Settings) -> DataFrame:
    """Put the findings into words and store them."""
    found = insights(daily, anomalies, forecasts, as_of)
    io.write_insights(insights_document(found, as_of), f"{settings.base}/insights")
    return found


def run_all(spark: SparkSession, raw: DataFrame, as_of: Column, settings: Settings) -> DataFrame:
    """All stages in order; returns the findings."""
    _, daily = preprocess(spark, raw, settings)
    anomalies = detect(spark, daily, settings)
    forecasts = predict(spark, daily, settings)
    return report(daily, anomalies, forecasts, as_of, settings)


def load_or_fit_anomaly(spark: SparkSession, path: str, daily: DataFrame, **options) -> AnomalyModel:
    """The stored model of ``path``, or a new one that is then stored there."""
    try:
        return AnomalyModel.load(spark, path)
    except AnalysisException:
        model = fit_anomaly_model(daily, **options)
        model.save(path)
        return model


def load_or_fit_forecaster(spark: SparkSession, path: str, daily: DataFrame, **options) -> ForecastModel:
    """The stored models of ``path``, or new ones that are then stored there."""
    try:
        return ForecastModel.load(spark, path)
    except AnalysisException:
        model = fit_forecaster(daily, **options)
        model.save(path)
        return model
