"""Series operators against pandas and against their own properties."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.operators import daily, series, stats
from barograph.schemas import ALERT_TYPES

# The first values are those of the fixture document.
TOTALS = [10, 15, 8, 20, 12, 25, 18, 0, 0, 7, 31, 4, 9, 16, 22, 3, 11, 5, 19, 27, 14, 6, 13, 2, 21, 17, 10, 28, 1, 8]


def frame(totals=TOTALS, start="2024-01-01"):
    return pd.DataFrame({"issued_date": pd.date_range(start, periods=len(totals)).date, "total_alerts": totals})


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame(frame(), "issued_date date, total_alerts long").cache()


def table(df, day="issued_date"):
    return df.orderBy(day).toPandas().reset_index(drop=True)


def same(found, expected):
    np.testing.assert_allclose(np.array(found, dtype=float), np.array(expected, dtype=float), rtol=1e-9, atol=1e-9)


def test_daily_series_counts_means_and_gaps(spark):
    rows = [
        ("1", "2024-01-01 05:00:00", "flood", 0.5),
        ("2", "2024-01-01 23:59:59", "storm", 0.7),
        ("3", "2024-01-04 00:00:00", "flood", 1.0),
        ("4", None, "flood", 1.0),
    ]
    raw = spark.createDataFrame(rows, "alert_id string, issued_date string, type string, severity_score double")
    got = table(daily.daily_series(raw.withColumn("issued_date", F.to_timestamp("issued_date"))))
    assert list(got["total_alerts"]) == [2, 0, 0, 1]
    same(got["severity_score"], [0.6, 0, 0, 1])
    assert list(got["flood"]) == [1, 0, 0, 1] and list(got["storm"]) == [1, 0, 0, 0]
    same(got["alert_intensity"], [1.2, 0, 0, 1])
    same(got["7_day_avg"], [2, 1, 2 / 3, 0.75])
    assert got["day_over_day_change"].isna().tolist() == [True, False, True, True]
    assert set(ALERT_TYPES) <= set(got.columns)


def test_trends_of_the_fixture(days):
    got = table(daily.with_trends(days))
    assert got["7_day_avg"][6] == pytest.approx(108 / 7)
    assert got["day_over_day_change"][1] == pytest.approx(50)


def test_keyed_series_equal_filtered_ones(spark, sf):
    from barograph.sources.adapters import EVENT_TYPES, event_alerts

    alerts = event_alerts(spark, sf)
    keyed = daily.daily_series(alerts, ["region"], EVENT_TYPES).filter("region = 'region_3'").drop("region")
    alone = daily.daily_series(alerts.filter("region = 'region_3'"), [], EVENT_TYPES)
    pd.testing.assert_frame_equal(table(keyed), table(alone))


def test_partitioning_does_not_matter(spark, sf):
    from barograph.sources.adapters import EVENT_TYPES, event_alerts

    alerts = event_alerts(spark, sf)
    one = daily.daily_series(alerts.coalesce(1), ["type"], EVENT_TYPES).orderBy("type", "issued_date").toPandas()
    many = daily.daily_series(alerts.repartition(13), ["type"], EVENT_TYPES).orderBy("type", "issued_date").toPandas()
    pd.testing.assert_frame_equal(one, many, rtol=1e-12)


def test_rolling_lags_and_changes_against_pandas(days):
    x = pd.Series(TOTALS, dtype=float)
    got = table(series.rolling_features(series.diff_pct(series.lag_features(days))))
    for n in (3, 7, 14, 30):
        roll = x.rolling(n, min_periods=1)
        same(got[f"rolling_mean_{n}"], roll.mean())
        same(got[f"rolling_std_{n}"], roll.std())
        same(got[f"rolling_min_{n}"], roll.min())
        same(got[f"rolling_max_{n}"], roll.max())
    for k in (1, 2, 3, 7):
        same(got[f"lag_{k}"], x.shift(k).fillna(0))
    for k in (1, 7):
        same(got[f"diff_{k}"], x.diff(k))
        same(got[f"pct_change_{k}"], x.pct_change(k, fill_method=None).replace([np.inf, -np.inf], np.nan))


def test_zscores_against_pandas(days):
    x = pd.Series(TOTALS, dtype=float)
    got = table(series.zscores(days))
    for n in (7, 30):
        roll = x.rolling(n, min_periods=1)
        same(got[f"z_score_{n}"], ((x - roll.mean()) / roll.std().replace(0, 1)).fillna(0))


def test_zscore_of_a_constant_series_is_zero(spark):
    flat = spark.createDataFrame(frame([5] * 10), "issued_date date, total_alerts long")
    assert table(series.zscores(flat))["z_score_7"].abs().max() == 0


@pytest.mark.parametrize("n", [1, 30, 2500])
def test_ema_against_pandas(spark, n):
    x = np.random.default_rng(n).poisson(6, n)
    got = table(series.ema_features(spark.createDataFrame(frame(list(map(int, x)), "1990-01-01"), "issued_date date, total_alerts long")))
    for alpha in (0.1, 0.3, 0.5):
        expected = pd.Series(x, dtype=float).ewm(alpha=alpha, min_periods=1).mean()
        np.testing.assert_allclose(got[series.ema_name(alpha)], expected, rtol=1e-12, atol=1e-12)


def test_velocity(days):
    x = pd.Series(TOTALS, dtype=float)
    got = table(series.velocity(days))
    same(got["velocity"], x.diff())
    same(got["acceleration"], x.diff().diff())


def test_risk_score_range_and_missing_severity(days):
    got = table(series.risk_score(days))
    assert got["risk_score"].between(0, 100).all()
    assert (got["severity_norm"] == 0.5).all()
    x = pd.Series(TOTALS, dtype=float)
    v = x.diff().fillna(0).abs()
    same(got["risk_score"], 100 * (0.4 * x / x.max() + 0.4 * 0.5 + 0.2 * v / v.max()))


def test_risk_of_an_empty_series_is_its_severity(spark):
    flat = spark.createDataFrame(frame([0] * 4), "issued_date date, total_alerts long")
    assert set(table(series.risk_score(flat))["risk_score"]) == {20.0}


def test_bursts_against_pandas(spark):
    totals = [5] * 12 + [60] + [5] * 5
    got = table(series.burst_flags(spark.createDataFrame(frame(totals), "issued_date date, total_alerts long")))
    roll = pd.Series(totals, dtype=float).rolling(7, min_periods=1)
    expected = pd.Series(totals) > roll.mean() + 2 * roll.std() + 1e-9
    assert got["burst"].tolist() == expected.tolist() and got["burst"].sum() == 1


def test_burst_without_the_current_day(spark):
    totals = [5, 6, 5, 40]
    got = table(series.burst_flags(spark.createDataFrame(frame(totals), "issued_date date, total_alerts long"), exclude_current=True))
    assert got["burst"].tolist() == [False, False, False, True]


def test_decomposition_properties(days):
    got = table(series.seasonal_decomposition(days))
    same(got["trend"] + got["seasonal"] + got["resid"], TOTALS)
    same([got["seasonal"][:7].sum()], [0])
    same(got["seasonal"][7:14], got["seasonal"][:7])
    same(got["trend"][3:27], pd.Series(TOTALS, dtype=float).rolling(7, center=True).mean()[3:27])
    line = np.polyfit(range(3, 10), got["trend"][3:10], 1)
    same(got["trend"][:3], np.polyval(line, range(3)))
    line = np.polyfit(range(19, 26), got["trend"][19:26], 1)
    same(got["trend"][27:], np.polyval(line, range(27, 30)))


def test_decomposition_of_a_pure_pattern(spark):
    totals = [10 + 2 * i + [0, 3, -1, 4, -2, 1, -5][i % 7] for i in range(70)]
    got = table(series.seasonal_decomposition(spark.createDataFrame(frame(totals), "issued_date date, total_alerts long")))
    same(got["resid"], np.zeros(70))
    same(got["seasonal"][:7], [0, 3, -1, 4, -2, 1, -5])


def test_short_series_are_not_decomposed(spark):
    short = spark.createDataFrame(frame(TOTALS[:13]), "issued_date date, total_alerts long")
    assert table(series.seasonal_decomposition(short))["trend"].isna().all()


def test_yoy_needs_a_year(spark):
    assert series.yoy_comparison(spark.createDataFrame(frame(TOTALS), "issued_date date, total_alerts long")).count() == 0


def test_fill_forward_backward(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(i), v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])]
    got = table(series.fill_forward_backward(spark.createDataFrame(rows, "issued_date date, x double"), ["x"]))
    assert got["x"].tolist() == [2, 2, 2, 2, 5, 5]


def test_tail_rows(days):
    assert table(series.tail_rows(days, 7))["total_alerts"].tolist() == TOTALS[-7:]
    assert table(series.tail_rows(days, 7, 7))["total_alerts"].tolist() == TOTALS[-14:-7]


def test_kpis(days):
    row = stats.kpis(days).first()
    recent, before = np.mean(TOTALS[-7:]), np.mean(TOTALS[-14:-7])
    assert row["total_alerts"] == sum(TOTALS) and row["peak_daily"] == max(TOTALS)
    assert row["change_pct"] == pytest.approx((recent - before) / before * 100)


def test_kpis_without_a_previous_week(spark):
    row = stats.kpis(spark.createDataFrame(frame(TOTALS[:5]), "issued_date date, total_alerts long")).first()
    assert row["previous_avg"] == 0 and row["change_pct"] == 0


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 4, 3), (3, 7, 3)], "flood long, storm long, wind long")
    got = {(r["type_a"], r["type_b"]): r["correlation"] for r in stats.correlation_matrix(df).collect()}
    assert got[("flood", "storm")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert got[("storm", "flood")] == got[("flood", "storm")]
    assert got[("flood", "wind")] is None
    with pytest.raises(ValueError):
        stats.correlation_matrix(df.select("flood"))


def test_dominant_type_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 2, 2, 1)], "issued_date date, flood long, storm long, wind long")
    assert stats.dominant_type(df).first()["type"] == "flood"


def test_modes_take_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "type string")
    assert stats.most_common(df, "type").first()["value"] == "a"


def test_validation(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a long, b string")
    got = {r["column_name"]: r["status"] for r in stats.validation_report(df, ["a", "b", "c"]).collect()}
    assert got == {"a": "ok", "b": "mostly_null", "c": "missing"}
    empty = {r["status"] for r in stats.validation_report(df.limit(0), ["a", "b"]).collect()}
    assert empty == {"empty"}
    assert stats.is_valid(df, ["a"]) and not stats.is_valid(df, ["c"]) and not stats.is_valid(df.limit(0), ["a"])


def test_discover_types_refuses_too_many(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "type string")
    assert daily.discover_types(df) == ["a", "b"]
    with pytest.raises(ValueError):
        daily.discover_types(df, limit=1)


def test_keyword_spike_is_found(spark):
    from barograph.functions import text
    from barograph.operators.keywords import keyword_spikes

    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=d), "hail rain") for d in range(20)] + [(start + dt.timedelta(days=15), "hail " * 30)]
    df = spark.createDataFrame(rows, "issued_date timestamp, text string")
    got = [(r["token"], r["issued_date"].day) for r in keyword_spikes(df, text.tokens(F.col("text"))).collect()]
    assert got == [("hail", 16)]
