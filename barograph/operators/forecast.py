"""Short-horizon forecasts of daily series with gradient-boosted trees.

All targets and keys live in one long table ``(keys, target, day, value)``.
Models are rows of a table: boosted trees, one per target, or linear weights, one per
series. Forecasting joins each series with its own model and runs on a single row per
series that carries the recent history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions.timeparts import calendar_features
from barograph.operators.daily import series_window
from barograph.operators.series import (
    EMA_ALPHAS,
    ROLLING_WINDOWS,
    diff_columns,
    ema_features,
    ema_name,
    lag_columns,
    rank_from_end,
    rolling_columns,
)
from barograph.operators.trees import boosted_prediction, boosted_trees
from barograph.schemas import FORECAST_TARGETS

LAGS = tuple(range(1, 31))
HISTORY = len(LAGS) + 1
MIN_ROWS = 50
Z_95 = 1.96

# Settings that train in seconds; REFERENCE_PARAMS asks for many small steps.
FAST_PARAMS = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
REFERENCE_PARAMS = {**FAST_PARAMS, "maxIter": 500, "maxDepth": 6, "stepSize": 0.01}
REFERENCE_CV_PARAMS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.01, "seed": 42}

CALENDAR = [
    "day_of_week",
    "day_of_month",
    "week_of_year",
    "month",
    "quarter",
    "year",
    "day_of_week_sin",
    "day_of_week_cos",
    "month_sin",
    "month_cos",
]
FEATURES = (
    [f"lag_{k}" for k in LAGS]
    + [f"rolling_{s}_{n}" for n in ROLLING_WINDOWS for s in ("mean", "std", "min", "max")]
    + [ema_name(a) for a in EMA_ALPHAS]
    + CALENDAR
    + ["diff_1", "pct_change_1", "diff_7", "pct_change_7"]
)


def choose_targets(columns: Sequence[str], wanted: Sequence[str] = FORECAST_TARGETS) -> list[str]:
    """The wanted targets that exist, else the total, else the first column."""
    found = [c for c in wanted if c in columns]
    return found or (["total_alerts"] if "total_alerts" in columns else list(columns[:1]))


def long_series(daily: DataFrame, targets: Sequence[str], keys: Sequence[str] = (), day: str = "issued_date") -> DataFrame:
    """One row ``(keys, target, day, value)`` per target column."""
    narrow = daily.select(*keys, F.col(day).alias("day"), *[F.col(t).cast("double").alias(t) for t in targets])
    return narrow.unpivot([*keys, "day"], list(targets), "target", "value")


def forecast_features(series: DataFrame, keys: Sequence[str] = (), label_shift: int = 1) -> DataFrame:
    """Feature columns of a long series and its ``label``.

    The label is the value ``label_shift`` days ahead; 0 asks for the value of
    the same day, which the features contain. Rows without a full 30 days of
    history are dropped; other gaps become 0.
    """
    by = [*keys, "target"]
    with_ema = ema_features(series, EMA_ALPHAS, "value", by, "day")
    ahead = F.col("value") if label_shift == 0 else F.lead("value", label_shift).over(series_window(by, "day"))
    wide = with_ema.select(
        "*",
        *lag_columns("value", LAGS, by, "day"),
        *rolling_columns("value", ROLLING_WINDOWS, by, "day"),
        *diff_columns("value", (1, 7), by, "day"),
        *[c.alias(n) for n, c in calendar_features(F.col("day")).items()],
        ahead.alias("label"),
    ).filter(F.col(f"lag_{LAGS[-1]}").isNotNull())
    return wide.select(*by, "day", "value", "label", array_to_vector(_array([F.col(f) for f in FEATURES])).alias("features"))


def _array(columns: Sequence[Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def chronological_split(features: DataFrame, keys: Sequence[str] = (), test_size: float = 0.2) -> DataFrame:
    """Add ``is_test``: the last part of each series, at least its share of the labelled rows."""
    by = [*keys, "target"]
    row = F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return features.withColumn("is_test", row > F.floor(n * (1 - test_size)))


def _regressor(params: dict) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", **params)


def _error_columns(actual: Column, predicted: Column) -> list[Column]:
    miss = F.abs(actual - predicted)
    return [
        F.avg(miss).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.avg(F.when(actual != 0, F.try_divide(miss, F.abs(actual)))) * 100).alias("mape"),
    ]


@dataclass
class ForecastModel:
    """One boosted-tree model per target, with its errors on the held-out days."""

    models: dict[str, GBTRegressionModel]
    metrics: dict[str, tuple[float, float]]
    keys: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, float(mae), float(rmse)) for t, (mae, rmse) in self.metrics.items()]
        return spark.createDataFrame(rows, "target string, mae double, rmse double")

    def forecast(self, daily: DataFrame, horizon: int = 7, day: str = "issued_date", interval: str = "spread") -> DataFrame:
        """Recursive forecast ``(keys, date, target, forecast, lower_bound, upper_bound)``."""
        series = long_series(daily, list(self.models), self.keys, day)
        if not self.models:
            return with_intervals(series.select(*self.keys, F.col("day").alias("date"), "target", F.col("value").alias("forecast")).limit(0), self.keys)
        trees = boosted_trees(daily.sparkSession, [((t,), m) for t, m in self.models.items()], "target string")
        depth = max(m.getMaxDepth() for m in self.models.values())
        # Every row meets the model of its own target only.
        rows = latest_state(series, self.keys).join(trees, "target")
        out = recursive_forecast(rows, boosted_prediction(F.col("x"), F.col("trees"), depth), ["trees"], self.keys, horizon)
        residual = {t: rmse for t, (_, rmse) in self.metrics.items()} if interval == "residual" else None
        return with_intervals(out, self.keys, residual)

    def save(self, path: str) -> None:
        """Write all models below ``path``."""
        spark = SparkSession.active()
        for target, model in self.models.items():
            model.write().overwrite().save(f"{path}/target={target}")
        rows = [(t, *map(float, self.metrics[t])) for t in self.models]
        spark.createDataFrame(rows, "target string, mae double, rmse double").write.mode("overwrite").parquet(f"{path}/metrics")
        spark.createDataFrame([(self.keys,)], "keys array<string>").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForecastModel:
        rows = spark.read.parquet(f"{path}/metrics").collect()
        keys = list(spark.read.parquet(f"{path}/settings").first()["keys"])
        models = {r["target"]: GBTRegressionModel.load(f"{path}/target={r['target']}") for r in rows}
        return cls(models, {r["target"]: (r["mae"], r["rmse"]) for r in rows}, keys)


def latest_state(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: last day, last values (oldest first) and the exponential averages.

    The history is bounded by the longest lag.
    """
    by = [*keys, "target"]
    smoothed = ema_features(series, EMA_ALPHAS, "value", by, "day")
    row = F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    numbered = smoothed.select("*", row.alias("_row"), rank_from_end(by, "day").alias("_rank"))
    recent = numbered.filter(F.col("_rank") <= HISTORY)
    return recent.groupBy(*by).agg(
        F.max("day").alias("day"),
        F.max("_row").cast("double").alias("rows"),
        F.transform(F.sort_array(F.collect_list(F.struct("day", "value"))), lambda e: e["value"]).alias("history"),
        *[F.max_by(ema_name(a), "day").alias(ema_name(a)) for a in EMA_ALPHAS],
    ).filter(F.size("history") == HISTORY)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _state_means() -> list[Column]:
    return [(_sum(F.slice("history", -n, n)) / n).alias(f"_mean_{n}") for n in ROLLING_WINDOWS]


def _state_array() -> Column:
    """The features of ``forecast_features`` from a carried state and its means."""
    history, day = F.col("history"), F.col("day")

    def back(k: int) -> Column:
        return F.element_at(history, -1 - k)

    columns = [back(k) for k in LAGS]
    for n in ROLLING_WINDOWS:
        part, mean = F.slice(history, -n, n), F.col(f"_mean_{n}")
        std = F.sqrt(_sum(F.transform(part, lambda x: F.pow(x - mean, 2))) / (n - 1))
        columns += [mean, std, F.array_min(part), F.array_max(part)]
    columns += [F.col(ema_name(a)) for a in EMA_ALPHAS]
    calendar = calendar_features(day)
    columns += [calendar[c] for c in CALENDAR]
    for k in (1, 7):
        columns += [back(0) - back(k), F.try_divide(back(0) - back(k), back(k))]
    return _array(columns)


def state_features(state: DataFrame) -> DataFrame:
    """A carried state with its ``features``."""
    return state.select("*", *_state_means()).select("*", array_to_vector(_state_array()).alias("features"))


def _advance(value: Column) -> list[Column]:
    """The state one day later, with ``value`` as the new day."""
    smoothed = []
    for alpha in EMA_ALPHAS:
        decay = 1 - alpha
        weight = (1 - F.pow(F.lit(decay), F.col("rows"))) / alpha
        smoothed.append(((value + decay * weight * F.col(ema_name(alpha))) / (1 + decay * weight)).alias(ema_name(alpha)))
    return [
        F.date_add("day", 1).alias("day"),
        (F.col("rows") + 1).alias("rows"),
        F.concat(F.slice("history", 2, HISTORY - 1), F.array(value)).alias("history"),
        *smoothed,
    ]


def recursive_forecast(state: DataFrame, predict: Column, model: Sequence[str], keys: Sequence[str] = (), horizon: int = 7) -> DataFrame:
    """``horizon`` days ``(keys, date, target, forecast)`` after each carried state.

    ``predict`` is the next day's value from ``x array<double>``, the features in the
    order of ``FEATURES``, and the columns ``model`` of the state. Every step predicts
    one day and appends the result, clipped at zero, to the history, so all features
    move along. The columns ``model`` stay.
    """
    by, rows = [*keys, "target"], state
    following = _advance(F.col("_next"))
    for step in range(1, horizon + 1):
        rows = rows.select("*", *_state_means()).select("*", _state_array().alias("x"))
        done = [f"_step_{i}" for i in range(1, step)]
        carried = [*model, "day", "rows", "history", *[ema_name(a) for a in EMA_ALPHAS]]
        rows = rows.select(*by, *carried, *done, F.greatest(predict, F.lit(0.0)).alias("_next"))
        rows = rows.select(*by, *model, *done, F.col("_next").alias(f"_step_{step}"), *following)
    listed = F.posexplode(F.array(*[f"_step_{i}" for i in range(1, horizon + 1)])).alias("_pos", "forecast")
    out = rows.select(*by, *model, F.date_sub("day", horizon).alias("_last"), listed)
    return out.select(*keys, F.expr("date_add(_last, _pos + 1)").alias("date"), "target", "forecast", *model)


@dataclass
class LinearForecaster:
    """Weights of a linear model per series: ``(keys, target, intercept, weights, rmse)``.

    ``weights map<string,double>`` names features of ``FEATURES``; others weigh nothing.
    """

    table: DataFrame
    keys: list[str] = field(default_factory=list)

    def forecast(self, daily: DataFrame, horizon: int = 7, day: str = "issued_date", interval: str = "spread") -> DataFrame:
        """Recursive forecast like that of ``ForecastModel``; every series meets its own weights."""
        targets = [c for c in daily.columns if c not in (*self.keys, day) and dict(daily.dtypes)[c] in ("bigint", "int", "double")]
        by = [*self.keys, "target"]
        state = latest_state(long_series(daily, targets, self.keys, day), self.keys)
        rows = state.alias("s").join(self.table.alias("m"), F.expr(" AND ".join(f"s.`{k}` <=> m.`{k}`" for k in by))).select(
            "s.*", "m.intercept", "m.rmse", F.transform(F.array(*[F.lit(f) for f in FEATURES]), lambda f: F.coalesce(F.try_element_at("m.weights", f), F.lit(0.0))).alias("weights")
        )
        products = F.zip_with("x", "weights", lambda a, b: a * b)
        out = recursive_forecast(rows, F.col("intercept") + _sum(products), ["intercept", "weights", "rmse"], self.keys, horizon)
        return with_intervals(out, self.keys, F.col("rmse") if interval == "residual" else None)


def fit_linear(
    daily: DataFrame, targets: Sequence[str], keys: Sequence[str] = (), feature: str = "rolling_mean_7", day: str = "issued_date", label_shift: int = 1
) -> LinearForecaster:
    """The least-squares line of the label over one feature, for all series in one aggregation.

    A series whose feature is constant gets the mean of its labels. Series without 30
    days of history have no model.
    """
    by = [*keys, "target"]
    rows = forecast_features(long_series(daily, targets, keys, day), keys, label_shift).filter("label IS NOT NULL")
    x, y = F.get(vector_to_array("features"), F.lit(FEATURES.index(feature))), F.col("label")
    pairs = rows.select(*by, x.alias("x"), y.alias("y"))
    sums = pairs.groupBy(*by).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy")
    )
    slope = F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0))
    table = sums.select(
        *by,
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.create_map(F.lit(feature), slope).alias("weights"),
        F.sqrt(F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0))).alias("rmse"),
    )
    return LinearForecaster(table, list(keys))


def with_intervals(forecasts: DataFrame, keys: Sequence[str] = (), residual: dict[str, float] | Column | None = None) -> DataFrame:
    """95% bounds from the spread of the forecasts, or from each target's ``residual`` error.

    ``residual`` is a column, or errors by target. A single forecast has no spread and
    gets 10% of itself; the lower bound is never negative.
    """
    value = F.col("forecast")
    if residual is None:
        series = Window.partitionBy(*keys, "target")
        spread = F.when(F.count(F.lit(1)).over(series) > 1, F.stddev_pop(value).over(series)).otherwise(value * 0.1)
    elif isinstance(residual, Column):
        spread = residual
    else:
        table = F.create_map(*[F.lit(x) for pair in residual.items() for x in pair])
        spread = F.element_at(table, F.col("target"))
    return forecasts.select(
        *keys,
        "date",
        "target",
        "forecast",
        F.greatest(value - Z_95 * spread, F.lit(0.0)).alias("lower_bound"),
        (value + Z_95 * spread).alias("upper_bound"),
    )


def fit_forecaster(
    daily: DataFrame,
    targets: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    day: str = "issued_date",
    label_shift: int = 1,
    params: dict | None = None,
    parallelism: int = 4,
) -> ForecastModel:
    """Train one model per target on the first 80% of the days, measured on the rest.

    Targets with fewer than 50 usable rows are left out and named in
    ``skipped``. ``parallelism`` trains that many targets side by side.
    """
    targets = choose_targets([c for c in daily.columns if c not in (*keys, day)]) if targets is None else list(targets)
    rows = forecast_features(long_series(daily, targets, keys, day), keys, label_shift).filter("label IS NOT NULL")
    # Sorted by target, so that a fit reads the cached batches of its own rows only.
    split = chronological_split(rows, keys).select("target", "label", "features", "is_test").sort("target").persist()
    try:
        counts = {r["target"]: r["n"] for r in split.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
        usable = [t for t in targets if counts.get(t, 0) >= MIN_ROWS]
        skipped = {t: f"{counts.get(t, 0)} rows, {MIN_ROWS} needed" for t in targets if t not in usable}

        def train(target: str):
            own = split.filter(F.col("target") == target)
            model = _regressor(params or FAST_PARAMS).fit(own.filter("NOT is_test"))
            errors = model.transform(own.filter("is_test")).agg(*_error_columns(F.col("label"), F.col("prediction"))).first()
            return target, model, (errors["mae"], errors["rmse"])

        with ThreadPoolExecutor(parallelism) as pool:
            trained = list(pool.map(train, usable))
    finally:
        split.unpersist()
    return ForecastModel({t: m for t, m, _ in trained}, {t: e for t, _, e in trained}, list(keys), skipped)


def with_folds(rows: DataFrame, keys: Sequence[str] = (), n_splits: int = 5, day: str = "day") -> DataFrame:
    """Adds ``row`` (from 0), ``n``, ``fold`` and ``start`` to the rows of each series.

    The last k blocks of n // (k+1) rows are the test blocks of folds 1 to k, and all
    rows before a block its training rows; k is at most n // 20. Fold 0 is only ever
    trained on. ``start`` is the first row of a row's own block.
    """
    by = [*keys, "target"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    row = F.row_number().over(Window.partitionBy(*by).orderBy(day)) - 1
    numbered = rows.select("*", row.cast("long").alias("row"), n.alias("n"))
    splits = F.least(F.lit(n_splits), F.floor(F.col("n") / 20))
    block = F.floor(F.col("n") / (splits + 1))
    first = F.col("n") - splits * block
    fold = F.greatest(F.floor(F.try_divide(F.col("row") - first, block)) + 1, F.lit(0))
    return numbered.withColumn("fold", fold).withColumn("start", F.when(F.col("fold") > 0, first + (F.col("fold") - 1) * block))


def cross_validate(
    rows: DataFrame, predict: Callable[[DataFrame], DataFrame], keys: Sequence[str] = (), n_splits: int = 5, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Expanding-window cross-validation of any predictor, one row of mean errors per target.

    ``rows`` has ``(keys, target, day, label, …)``. ``predict`` gets them with their
    folds (``with_folds``) and returns the rows of all test blocks with a ``prediction``
    made from the rows before the block; null predictions count nowhere. All folds of
    all series are measured in one pass. Series under ``min_rows`` are left out.
    """
    folded = with_folds(rows, keys, n_splits).filter(F.col("n") >= min_rows)
    errors = _error_columns(F.col("label"), F.col("prediction"))
    measured = predict(folded).filter("fold > 0 AND prediction IS NOT NULL").groupBy("target", "fold").agg(*errors)
    return measured.groupBy("target").agg(
        F.avg("mae").alias("mean_mae"),
        F.stddev_pop("mae").alias("std_mae"),
        F.avg("rmse").alias("mean_rmse"),
        F.stddev_pop("rmse").alias("std_rmse"),
        F.avg("mape").alias("mean_mape"),
        F.count(F.lit(1)).cast("int").alias("n_folds"),
    )


def seasonal_naive(keys: Sequence[str] = (), season: int = 7) -> Callable[[DataFrame], DataFrame]:
    """A predictor that repeats the last ``season`` labels before each test block."""

    def predict(folded: DataFrame) -> DataFrame:
        by = [*keys, "target"]
        source = F.col("start") - season + (F.col("row") - F.col("start")) % season
        tests = folded.filter("fold > 0").withColumn("source", source)
        known = folded.select(*by, F.col("row").alias("source"), F.col("label").alias("prediction"))
        same = " AND ".join(f"t.`{c}` <=> k.`{c}`" for c in [*by, "source"])
        return tests.alias("t").join(known.alias("k"), F.expr(same), "left").select("t.*", "k.prediction")

    return predict


def boosted(params: dict | None = None, parallelism: int = 4) -> Callable[[DataFrame], DataFrame]:
    """A predictor of boosted trees, one model per target and fold; each row meets its own."""

    def predict(folded: DataFrame) -> DataFrame:
        kept = folded.select("target", "label", "features", "fold").sort("target").persist()
        try:
            work = sorted((r["target"], r["fold"]) for r in kept.filter("fold > 0").select("target", "fold").distinct().collect())

            def train(job):
                target, k = job
                return job, _regressor(params or {**FAST_PARAMS, "subsamplingRate": 1.0}).fit(kept.filter((F.col("target") == target) & (F.col("fold") < k)))

            with ThreadPoolExecutor(parallelism) as pool:
                models = list(pool.map(train, work))
        finally:
            kept.unpersist()
        if not models:
            return folded.limit(0).withColumn("prediction", F.lit(None).cast("double"))
        trees = boosted_trees(folded.sparkSession, models, "target string, fold long")
        depth = max(m.getMaxDepth() for _, m in models)
        scored = folded.join(trees, ["target", "fold"]).withColumn("x", vector_to_array("features"))
        return scored.withColumn("prediction", boosted_prediction(F.col("x"), F.col("trees"), depth)).drop("x", "trees")

    return predict


def evaluate_forecaster(
    daily: DataFrame,
    targets: Sequence[str],
    keys: Sequence[str] = (),
    day: str = "issued_date",
    n_splits: int = 5,
    label_shift: int = 1,
    params: dict | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """``cross_validate`` of boosted trees on the features of ``forecast_features``."""
    rows = forecast_features(long_series(daily, targets, keys, day), keys, label_shift).filter("label IS NOT NULL")
    return cross_validate(rows, boosted(params, parallelism), keys, n_splits)


def forecast_vs_actual(forecasts: DataFrame, daily: DataFrame, keys: Sequence[str] = (), day: str = "issued_date") -> DataFrame:
    """Forecasts beside the values that came true and the mean absolute error per target."""
    targets = [c for c in daily.columns if c not in (*keys, day) and dict(daily.dtypes)[c] in ("bigint", "int", "double")]
    actual = long_series(daily, targets, keys, day).withColumnsRenamed({"day": "date", "value": "actual"})
    joined = forecasts.join(actual, [*keys, "date", "target"])
    error = F.abs(F.col("forecast") - F.col("actual"))
    return joined.select("*", error.alias("abs_error"), F.avg(error).over(Window.partitionBy(*keys, "target")).alias("mae"))


def default_forecast(spark: SparkSession, first_day: Column, horizon: int = 7) -> DataFrame:
    """The placeholder forecast of 20 alerts a day within [15, 25], only for explicit use."""
    return spark.range(horizon).select(
        F.date_add(first_day, F.col("id").cast("int")).alias("date"),
        F.lit("total_alerts").alias("target"),
        F.lit(20.0).alias("forecast"),
        F.lit(15.0).alias("lower_bound"),
        F.lit(25.0).alias("upper_bound"),
    )
