"""Isolation forest, forecasts and insights."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barograph.operators import anomaly, forecast, insights
from barograph.operators.daily import with_trends
from barograph.operators.trees import boosted_prediction, boosted_trees

START = dt.date(2023, 1, 1)


def make_daily(spark, totals, **columns):
    rows = pd.DataFrame({"issued_date": [START + dt.timedelta(i) for i in range(len(totals))], "total_alerts": totals, **columns})
    kinds = ", ".join(f"{c} {'double' if c == 'severity_score' else 'long'}" for c in columns)
    return spark.createDataFrame(rows, "issued_date date, total_alerts long" + (", " + kinds if kinds else ""))


@pytest.fixture(scope="module")
def year(spark):
    rng = np.random.default_rng(3)
    totals = [int(v) for v in 20 + 5 * np.sin(np.arange(400) * 2 * np.pi / 7) + rng.poisson(4, 400)]
    totals[350] = 400
    flood = [t // 2 for t in totals]
    return with_trends(make_daily(spark, totals, severity_score=[0.5] * 400, flood=flood)).cache()


@pytest.fixture(scope="module")
def model(year):
    return anomaly.fit_anomaly_model(year)


def test_a_tenth_is_flagged_and_the_outlier_is_found(year, model):
    got = model.predict(year).toPandas()
    assert len(got) == 400 and got["is_anomaly"].sum() == 40
    assert (got["is_anomaly"] == (got["anomaly_score"] < 0)).all()
    # The days after carry the outlier in their lags and averages.
    flagged = set(got.loc[got["is_anomaly"], "issued_date"])
    assert {START + dt.timedelta(350 + i) for i in range(4)} <= flagged
    assert np.allclose(got["anomaly_confidence"], got["anomaly_score"].abs())
    assert set(got["anomaly_severity"]) <= {"low", "medium", "high", "critical"}


def test_scores_do_not_depend_on_partitioning(spark, year, model):
    again = anomaly.fit_anomaly_model(year.repartition(7))
    a = model.predict(year).orderBy("issued_date").select("anomaly_score").toPandas()
    b = again.predict(year.repartition(3)).orderBy("issued_date").select("anomaly_score").toPandas()
    assert np.allclose(a, b)


def test_model_round_trip(spark, year, model, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = anomaly.AnomalyModel.load(spark, str(tmp_path / "m"))
    a = model.predict(year).orderBy("issued_date").select("anomaly_score").toPandas()
    b = loaded.predict(year).orderBy("issued_date").select("anomaly_score").toPandas()
    assert np.allclose(a, b)


def test_too_few_rows_are_an_error(spark, year):
    with pytest.raises(ValueError, match="too few"):
        anomaly.fit_anomaly_model(year.limit(9))
    with pytest.raises(ValueError):
        anomaly.anomaly_features(spark.createDataFrame([(START,)], "issued_date date"))


def test_forest_samples_are_bounded(spark):
    points = spark.range(5000).select("id", F.array(F.col("id").cast("double"), F.sin("id")).alias("x"))
    trees = anomaly.build_forest(points, ["id"], 5000, n_trees=20).collect()
    assert len(trees) == 20 and all(t["sample_size"] == 256 for t in trees)
    assert all(len(t["nodes"]) <= 511 for t in trees)
    for tree in trees:
        sizes = [n["size"] for n in tree["nodes"]]
        assert sizes[0] == 256
        for n in tree["nodes"]:
            if n["feature"] >= 0:
                assert n["size"] == sizes[n["left"]] + sizes[n["right"]]


def test_path_length_of_a_tree_by_hand(spark):
    node = {"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "size": 1}
    nodes = [{**node, "feature": 0, "threshold": 0.5, "left": 1, "right": 2, "size": 4}, {**node, "size": 3}, node]
    points = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    got = {r["id"]: r["raw"] for r in anomaly.score_rows(points, [{"sample_size": 4, "nodes": nodes}]).collect()}
    def c(n):
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    assert got[1] == pytest.approx(-(2 ** (-(1 + c(3)) / c(4))))
    assert got[2] == pytest.approx(-(2 ** (-1 / c(4))))


def test_explanations(spark):
    rows = [
        (START, True, "high", 0.4, 16, 10.0, 3, 3, 0.5),
        (START + dt.timedelta(1), True, "low", 0.1, 15, 10.0, 0, 0, 0.71),
        (START + dt.timedelta(2), True, None, None, 10, 10.0, 0, 0, 0.7),
        (START + dt.timedelta(3), False, "low", 0.0, 100, 10.0, 9, 0, 1.0),
        (START + dt.timedelta(4), True, "low", 0.1, 4, 10.0, 0, 1, 0.0),
    ]
    schema = "issued_date date, is_anomaly boolean, anomaly_severity string, anomaly_confidence double, total_alerts long, `7_day_avg` double, flood long, storm long, severity_score double"
    got = {r["date"]: r for r in anomaly.explain_anomalies(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 4
    assert got["2023-01-01"]["reasons"] == ["Above 7-day average by 60.0%", "High number of flood alerts"]
    assert got["2023-01-02"]["reasons"] == ["High average alert severity"]
    assert got["2023-01-03"]["reasons"] == ["Statistical anomaly detected"]
    assert (got["2023-01-03"]["severity"], got["2023-01-03"]["confidence"]) == ("unknown", 0.0)
    assert got["2023-01-05"]["reasons"] == ["Below 7-day average by 60.0%", "High number of storm alerts"]


def test_unscored(spark, year):
    row = anomaly.unscored(year).first()
    assert (row["anomaly_score"], row["is_anomaly"], row["anomaly_severity"]) == (0.0, False, "low")


# Forecasts --------------------------------------------------------------------

SMALL = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3, "seed": 42}


@pytest.fixture(scope="module")
def forecaster(year):
    return forecast.fit_forecaster(year, ["total_alerts", "flood"], params=SMALL)


def test_forecast_shape(year, forecaster):
    got = forecaster.forecast(year).orderBy("target", "date").toPandas()
    assert len(got) == 14 and set(got["target"]) == {"total_alerts", "flood"}
    last = START + dt.timedelta(399)
    assert list(got["date"][:7]) == [last + dt.timedelta(i) for i in range(1, 8)]
    assert (got["forecast"] >= 0).all() and (got["lower_bound"] >= 0).all()
    assert ((got["lower_bound"] <= got["forecast"]) & (got["forecast"] <= got["upper_bound"])).all()


def test_forecast_horizon_is_prefix_stable(year, forecaster):
    short = forecaster.forecast(year, 2).filter("target = 'flood'").orderBy("date").toPandas()["forecast"]
    long = forecaster.forecast(year, 5).filter("target = 'flood'").orderBy("date").toPandas()["forecast"]
    assert np.allclose(short, long[:2])


def test_residual_interval(year, forecaster):
    got = forecaster.forecast(year, 1, interval="residual").filter("target = 'flood'").first()
    assert got["upper_bound"] - got["forecast"] == pytest.approx(1.96 * forecaster.metrics["flood"][1])


def test_forecaster_round_trip(spark, year, forecaster, tmp_path):
    forecaster.save(str(tmp_path / "f"))
    loaded = forecast.ForecastModel.load(spark, str(tmp_path / "f"))
    a = forecaster.forecast(year, 2).orderBy("target", "date").toPandas()
    b = loaded.forecast(year, 2).orderBy("target", "date").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert loaded.metrics_table(spark).count() == 2


def test_state_features_equal_window_features(year):
    """The carried state gives the vector that the windows give for the same day."""
    long = forecast.long_series(year, ["total_alerts"])
    windows = forecast.forecast_features(long).orderBy(F.desc("day")).first()
    state = forecast.state_features(forecast.latest_state(long)).first()
    assert windows["day"] == state["day"]
    assert len(windows["features"]) == len(forecast.FEATURES)
    np.testing.assert_allclose(windows["features"].toArray(), state["features"].toArray(), rtol=1e-9, atol=1e-9)


def test_advanced_state_equals_the_state_of_a_longer_series(spark, year):
    long = forecast.long_series(year, ["total_alerts"])
    shorter = long.filter(F.col("day") < F.lit(START + dt.timedelta(399)))
    last = long.orderBy(F.desc("day")).first()["value"]
    step = forecast.latest_state(shorter).select("target", *forecast._advance(F.lit(last)))
    a = forecast.state_features(step).first()["features"].toArray()
    b = forecast.state_features(forecast.latest_state(long)).first()["features"].toArray()
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_boosted_trees_by_columns_equal_the_model(spark, year, forecaster):
    features = forecast.forecast_features(forecast.long_series(year, ["flood"])).withColumn("x", vector_to_array("features"))
    model = forecaster.models["flood"]
    trees = boosted_trees(spark, [(("flood",), model)], "target string")
    both = model.transform(features.join(trees, "target")).withColumn("own", boosted_prediction(F.col("x"), F.col("trees"), model.getMaxDepth()))
    assert both.filter("abs(own - prediction) > 1e-9").count() == 0 and both.select("own").distinct().count() > 3


def test_every_series_meets_one_model(spark, year, forecaster):
    """However many targets there are, a step applies one model to a row."""
    many = forecast.ForecastModel({f"t{i}": forecaster.models["flood"] for i in range(50)}, {f"t{i}": (1.0, 2.0) for i in range(50)})
    days = year.select("issued_date", *[(F.col("flood") + i).alias(f"t{i}") for i in range(50)])
    out = many.forecast(days, horizon=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan
    got = out.toPandas()
    assert len(got) == 150 and set(got["target"]) == {f"t{i}" for i in range(50)}
    alone = forecast.ForecastModel({"flood": forecaster.models["flood"]}, {"flood": (1.0, 2.0)}).forecast(year, horizon=3).toPandas()
    assert sorted(got[got["target"] == "t0"]["forecast"]) == pytest.approx(sorted(alone["forecast"]))


def test_linear_forecasts_by_key(spark, year):
    """Series by key equal the series alone; one without a model is left out; constant features give the mean."""
    two = year.select(F.lit("a").alias("region"), "issued_date", "total_alerts").union(year.select(F.lit(None).alias("region"), "issued_date", F.lit(4)))
    model = forecast.fit_linear(two, ["total_alerts"], ["region"])
    got = {r: g.sort_values("date")["forecast"].tolist() for r, g in model.forecast(two).toPandas().groupby("region", dropna=False)}
    alone = forecast.fit_linear(year, ["total_alerts"]).forecast(year.select("issued_date", "total_alerts")).orderBy("date").toPandas()
    assert got.pop("a") == pytest.approx(alone["forecast"].tolist()) and list(got.values()) == [[4.0] * 7]
    short = year.limit(20).select("issued_date", "total_alerts")
    assert forecast.fit_linear(short, ["total_alerts"]).forecast(short).count() == 0


def test_folds_by_hand(spark):
    rows = [("t", dt.date(2024, 1, 1) + dt.timedelta(i), float(i % 7)) for i in range(62)] + [("s", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0) for i in range(49)]
    long = spark.createDataFrame(rows, "target string, day date, label double")
    folds = {r["row"]: (r["fold"], r["start"]) for r in forecast.with_folds(long).filter("target = 't'").collect()}
    # 62 rows: three blocks of 15 at the end, the first 17 are only trained on.
    assert [sum(f == k for f, _ in folds.values()) for k in range(4)] == [17, 15, 15, 15]
    assert folds[16] == (0, None) and folds[17] == (1, 17) and folds[61] == (3, 47)
    (row,) = forecast.cross_validate(long, forecast.seasonal_naive()).collect()
    assert (row["target"], row["n_folds"], row["mean_mae"], row["std_rmse"]) == ("t", 3, 0.0, 0.0)
    off = forecast.cross_validate(long, forecast.seasonal_naive(season=6)).first()
    assert off["mean_mae"] > 0


def test_label_shift(year):
    long = forecast.long_series(year, ["total_alerts"])
    same_day = forecast.forecast_features(long, label_shift=0).toPandas()
    assert (same_day["label"] == same_day["value"]).all() and len(same_day) == 370


def test_short_series_are_skipped_by_name(spark):
    short = make_daily(spark, list(range(60)))
    fitted = forecast.fit_forecaster(short, ["total_alerts"], params=SMALL)
    assert fitted.models == {} and "total_alerts" in fitted.skipped


@pytest.mark.parametrize(
    ("values", "bounds"),
    [([10.0, 20.0], [(0.2, 19.8), (10.2, 29.8)]), ([10.0], [(8.04, 11.96)])],
)
def test_intervals(spark, values, bounds):
    rows = [(START + dt.timedelta(i), "t", v) for i, v in enumerate(values)]
    got = forecast.with_intervals(spark.createDataFrame(rows, "date date, target string, forecast double")).orderBy("date").collect()
    assert [(r["lower_bound"], r["upper_bound"]) for r in got] == [pytest.approx(b) for b in bounds]


def test_targets():
    assert forecast.choose_targets(["total_alerts", "wind", "x"]) == ["total_alerts", "wind"]
    assert forecast.choose_targets(["x", "y"]) == ["x"]


def test_cross_validation_folds(year):
    row = forecast.evaluate_forecaster(year, ["total_alerts"], params={"maxIter": 1, "maxDepth": 2, "seed": 1}, n_splits=3).first()
    assert row["n_folds"] == 3 and row["mean_mae"] > 0 and row["mean_rmse"] >= row["mean_mae"] and row["mean_mape"] > 0


def test_default_forecast(spark):
    got = forecast.default_forecast(spark, F.lit("2024-01-01").cast("date")).orderBy("date").collect()
    assert len(got) == 7 and got[0]["date"] == dt.date(2024, 1, 1)
    assert {(r["forecast"], r["lower_bound"], r["upper_bound"]) for r in got} == {(20.0, 15.0, 25.0)}


def test_forecast_vs_actual(spark, year):
    rows = [(START + dt.timedelta(398), "flood", 1.0), (START + dt.timedelta(399), "flood", 2.0)]
    made = spark.createDataFrame(rows, "date date, target string, forecast double")
    got = forecast.forecast_vs_actual(made, year).orderBy("date").toPandas()
    actual = year.orderBy("issued_date").toPandas()["flood"][-2:].to_numpy()
    assert np.allclose(got["abs_error"], np.abs(actual - [1, 2])) and np.allclose(got["mae"], np.abs(actual - [1, 2]).mean())


# Insights ---------------------------------------------------------------------


def sentences(found):
    return {r["rule"]: r["text"] for r in found.collect()}


@pytest.mark.parametrize(
    ("before", "now", "start"),
    [
        (10, 16, "Alert activity has increased significantly in the past week (average 16.0 alerts/day vs 10.0 previously)."),
        (10, 15, "Alert activity remains stable at around 15.0 alerts per day."),
        (10, 7, "Alert activity remains stable at around 7.0 alerts per day."),
        (10, 6, "Alert activity has decreased in the past week (average 6.0 alerts/day vs 10.0 previously)."),
        (0, 6, "Alert activity remains stable at around 6.0 alerts per day."),
    ],
)
def test_activity(spark, before, now, start):
    assert sentences(insights.insights(make_daily(spark, [before] * 7 + [now] * 7)))["activity"] == start


def test_no_data_and_no_totals(spark):
    assert sentences(insights.insights(make_daily(spark, [1]).limit(0))) == {"activity": insights.NO_DATA}
    assert sentences(insights.insights(spark.createDataFrame([(1,)], "x long"))) == {"operational": insights.OPERATIONAL}


def test_anomaly_outlook_and_type_rules(spark):
    days = make_daily(spark, [10] * 40, flood=[1] * 40, storm=[2] * 40)
    last = START + dt.timedelta(39)
    flags = days.select(
        "issued_date",
        F.col("issued_date").isin(last, START + dt.timedelta(30), START).alias("is_anomaly"),
        F.when(F.col("issued_date") == last, "critical").otherwise("low").alias("anomaly_severity"),
    )
    ahead = spark.createDataFrame([(last, "total_alerts", 13.0), (last, "flood", 99.0)], "date date, target string, forecast double")
    found = insights.insights(days, flags, ahead)
    assert sentences(found) == {
        "activity": "Alert activity remains stable at around 10.0 alerts per day.",
        "anomalies": "Detected 2 anomalous days in the past month, most recently on February 09.",
        "severe_anomalies": "Found 1 high-severity anomalies requiring attention.",
        "outlook": "Forecast predicts increased alert activity in the coming week (average 13.0 alerts/day expected).",
        "frequent_type": "Most frequent alert type recently: Storm alerts.",
    }
    assert [r["seq"] for r in insights.first_insights(found).orderBy("seq").collect()] == [1, 2, 3, 4]
    document = insights.insights_document(found, F.lit("2024-01-01 00:00:00")).first()
    assert len(document["insights"]) == 5 and document["insights"][0].startswith("Alert activity")


@pytest.mark.parametrize(("value", "said"), [(12.0, False), (12.1, True), (8.0, False), (7.9, True)])
def test_outlook_limits(spark, value, said):
    ahead = spark.createDataFrame([(START, "total_alerts", value)], "date date, target string, forecast double")
    assert ("outlook" in sentences(insights.insights(make_daily(spark, [10] * 20), forecasts=ahead))) == said


def test_season_needs_more_than_a_year(spark):
    totals = [30 if (START + dt.timedelta(i)).month == 3 else 10 for i in range(366)]
    march = F.lit("2025-03-09").cast("date")
    text = sentences(insights.insights(make_daily(spark, totals), as_of=march))["season"]
    assert text.startswith("Current month typically sees higher than average alert activity (30.0 vs yearly average 11.7)")
    assert "season" not in sentences(insights.insights(make_daily(spark, totals[:365]), as_of=march))
    assert "season" not in sentences(insights.insights(make_daily(spark, totals), as_of=F.lit("2025-04-09").cast("date")))
