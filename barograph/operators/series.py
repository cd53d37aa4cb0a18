"""Window operators on gap-free daily series.

Frames are row-based, which on a gap-free series means days. ``keys`` name the
series; without keys there is one series of one row per calendar day. Columns
that share a window are built in one ``select`` so they share one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.severity import RISK_ALARM, RISK_REFERENCE, risk_band
from barograph.operators.daily import series_window

DAY = "issued_date"
VALUE = "total_alerts"
ROUNDING = 1e-9
EMA_ALPHAS = (0.1, 0.3, 0.5)
ROLLING_WINDOWS = (3, 7, 14, 30)
ALL_ROWS = (Window.unboundedPreceding, Window.unboundedFollowing)


def ema_name(alpha: float) -> str:
    """Column name of an exponential average, ``ema_0_1`` for 0.1."""
    return f"ema_{alpha}".replace(".", "_")


def lag_columns(value: str, lags: Sequence[int], keys: Sequence[str], day: str, default: float | None = None) -> list[Column]:
    w = series_window(keys, day)
    shifted = (F.lag(value, k).over(w) for k in lags)
    if default is not None:
        shifted = (F.coalesce(c, F.lit(default)) for c in shifted)
    return [c.alias(f"lag_{k}") for k, c in zip(lags, shifted)]


def lag_features(
    df: DataFrame,
    lags: Sequence[int] = (1, 2, 3, 7),
    value: str = VALUE,
    keys: Sequence[str] = (),
    day: str = DAY,
    default: float | None = 0,
) -> DataFrame:
    """Values of earlier days; missing ones become ``default``."""
    return df.select("*", *lag_columns(value, lags, keys, day, default))


def rolling_columns(value: str, windows: Sequence[int], keys: Sequence[str], day: str) -> list[Column]:
    w = series_window(keys, day)
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return [
        f(value).over(w.rowsBetween(1 - n, 0)).alias(f"rolling_{name}_{n}")
        for n in windows
        for name, f in stats.items()
    ]


def rolling_features(
    df: DataFrame,
    windows: Sequence[int] = ROLLING_WINDOWS,
    value: str = VALUE,
    keys: Sequence[str] = (),
    day: str = DAY,
) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the last n days, today included."""
    return df.select("*", *rolling_columns(value, windows, keys, day))


def zscores(
    df: DataFrame,
    windows: Sequence[int] = (7, 30),
    value: str = VALUE,
    keys: Sequence[str] = (),
    day: str = DAY,
) -> DataFrame:
    """Rolling deviations and z-scores; deviation 0 divides by 1, a lone row scores 0."""
    w = series_window(keys, day)
    columns = []
    for n in windows:
        frame = w.rowsBetween(1 - n, 0)
        mean, std = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
        score = (F.col(value) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)
        columns += [
            F.coalesce(std, F.lit(0.0)).alias(f"rolling_std_{n}"),
            F.coalesce(score, F.lit(0.0)).alias(f"z_score_{n}"),
        ]
    return df.select("*", *columns)


def diff_columns(value: str, periods: Sequence[int], keys: Sequence[str], day: str) -> list[Column]:
    w = series_window(keys, day)
    out = []
    for k in periods:
        before = F.lag(value, k).over(w)
        change = F.col(value) - before
        out.append(change.alias(f"diff_{k}"))
        out.append(F.try_divide(change.cast("double"), before).alias(f"pct_change_{k}"))
    return out


def diff_pct(
    df: DataFrame, periods: Sequence[int] = (1, 7), value: str = VALUE, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Absolute and relative changes; relative ones are null after a zero."""
    return df.select("*", *diff_columns(value, periods, keys, day))


def ema_features(
    df: DataFrame, alphas: Sequence[float] = EMA_ALPHAS, value: str = VALUE, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Bias-adjusted exponential averages, sum((1-a)^i x) / sum((1-a)^i).

    A series is cut into blocks so short that the weights inside one stay in
    range. Within a block the weighted sum is a running sum of values scaled
    up by their age; the sums at the end of the two blocks before carry in the
    rest, whose weight beyond them is below 1e-24. This is linear in the
    number of rows.
    """
    order = series_window(keys, day)
    out = df.withColumn("_row", F.row_number().over(order) - 1)
    row, x = F.col("_row"), F.col(value).cast("double")
    names = {alpha: ema_name(alpha) for alpha in alphas}
    decays = {alpha: 1 - alpha for alpha in alphas}
    blocks = {alpha: max(2, math.ceil(-28 / math.log(decays[alpha]))) for alpha in alphas}
    out = out.select("*", *[F.floor(row / blocks[a]).alias(f"_block_{n}") for a, n in names.items()])
    local = []
    for a, n in names.items():
        inside = Window.partitionBy(*keys, f"_block_{n}").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
        age = row % blocks[a]
        running = F.sum(x * F.pow(F.lit(1 / decays[a]), age)).over(inside)
        local.append((running * F.pow(F.lit(decays[a]), age)).alias(f"_local_{n}"))
    out = out.select("*", *local)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = {n: F.when(row % blocks[a] == blocks[a] - 1, F.col(f"_local_{n}")) for a, n in names.items()}
    out = out.select("*", *[F.coalesce(F.last(e, True).over(before), F.lit(0.0)).alias(f"_carry_{n}") for n, e in ended.items()])
    smoothed = []
    for a, n in names.items():
        earlier = F.coalesce(F.lag(f"_carry_{n}", blocks[a]).over(order), F.lit(0.0))
        carried = F.col(f"_carry_{n}") + F.lit(decays[a] ** blocks[a]) * earlier
        numerator = F.col(f"_local_{n}") + F.pow(F.lit(decays[a]), row % blocks[a] + 1) * carried
        smoothed.append((numerator * a / (1 - F.pow(F.lit(decays[a]), row + 1))).alias(n))
    return out.select(*df.columns, *smoothed)


def velocity(df: DataFrame, value: str = VALUE, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """First and second difference of the series."""
    w = series_window(keys, day)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    x = F.col(value)
    return df.select("*", (x - one).alias("velocity"), (x - 2 * one + two).alias("acceleration"))


def risk_score(
    df: DataFrame, value: str = VALUE, severity: str = "severity_score", keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Risk 0..100 from volume (40%), severity (40%) and velocity (20%)."""
    w = series_window(keys, day)
    everything = Window.partitionBy(*keys)
    x = F.col(value)
    with_velocity = df.withColumn("velocity", F.coalesce(x - F.lag(x).over(w), F.lit(0)))
    speed = F.abs("velocity")
    scored = with_velocity.withColumns(
        {
            "volume_score": F.coalesce(F.try_divide(x, F.max(x).over(everything)), F.lit(0.0)),
            "severity_norm": F.col(severity) if severity in df.columns else F.lit(0.5),
            "velocity_score": F.coalesce(F.try_divide(speed, F.max(speed).over(everything)), F.lit(0.0)),
        }
    )
    weighted = F.col("volume_score") * 0.4 + F.col("severity_norm") * 0.4 + F.col("velocity_score") * 0.2
    return scored.withColumn("risk_score", weighted * 100)


def current_risk(scored: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Latest risk of each series with its band, alarm and distance to the reference."""
    latest = scored.groupBy(*keys).agg(
        F.max(day).alias(day), F.max_by("risk_score", day).alias("risk_score")
    )
    risk = F.col("risk_score")
    return latest.select(
        "*",
        risk_band(risk).alias("band"),
        (risk >= RISK_ALARM).alias("alarm"),
        (risk - RISK_REFERENCE).alias("above_reference"),
    )


def burst_flags(
    df: DataFrame,
    window: int = 7,
    k: float = 2.0,
    value: str = VALUE,
    keys: Sequence[str] = (),
    day: str = DAY,
    exclude_current: bool = False,
) -> DataFrame:
    """Flag days above mean + k deviations of the last ``window`` days.

    A day that equals its threshold up to rounding error is no burst. The
    frame includes the day itself, which bounds the z-score by
    (n-1)/sqrt(n); ``exclude_current`` compares with the days before only.
    """
    w = series_window(keys, day)
    frame = w.rowsBetween(-window, -1) if exclude_current else w.rowsBetween(1 - window, 0)
    with_stats = df.select(
        "*",
        F.avg(value).over(frame).alias("rolling_mean"),
        F.stddev_samp(value).over(frame).alias("rolling_std"),
    )
    threshold = F.col("rolling_mean") + k * F.col("rolling_std")
    return with_stats.select(
        "*",
        threshold.alias("burst_threshold"),
        F.coalesce(F.col(value) - threshold > ROUNDING, F.lit(False)).alias("burst"),
    )


def seasonal_decomposition(
    df: DataFrame, period: int = 7, value: str = VALUE, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Additive decomposition into trend, seasonal and residual part.

    The trend is the centred mean over one (odd) period. At both ends it
    follows the least-squares line through ``period`` trend points: the first
    ones at the start; at the end those before the last one. Series shorter
    than two periods get nulls.
    """
    if period % 2 == 0:
        raise ValueError("period must be odd")
    half = period // 2
    w = series_window(keys, day)
    everything = Window.partitionBy(*keys)
    centred = w.rowsBetween(-half, half)
    numbered = df.select(
        "*",
        F.row_number().over(w).alias("_row"),
        F.count(F.lit(1)).over(everything).alias("_n"),
        F.when(F.count(value).over(centred) == period, F.avg(value).over(centred)).alias("_centred"),
    )
    row, n, known = F.col("_row"), F.col("_n"), F.col("_centred")
    head = F.when(row <= half + period, known)
    tail = F.when((row >= n - half - period) & (row < n - half), known)
    fitted = numbered.select(
        "*",
        *[
            f(part, row).over(everything).alias(f"_{f.__name__}_{side}")
            for side, part in (("head", head), ("tail", tail))
            for f in (F.regr_slope, F.regr_intercept)
        ],
    )
    line = {s: F.col(f"_regr_slope_{s}") * row + F.col(f"_regr_intercept_{s}") for s in ("head", "tail")}
    trend = F.coalesce(known, F.when(row <= half, line["head"]).otherwise(line["tail"]))
    x = F.col(value).cast("double")
    with_trend = fitted.select(
        *df.columns,
        x.alias("observed"),
        F.when(n >= 2 * period, trend).alias("trend"),
        ((row - 1) % period).alias("_phase"),
    )
    detrended = F.col("observed") - F.col("trend")
    with_phase = with_trend.withColumn(
        "_phase_mean", F.avg(detrended).over(Window.partitionBy(*keys, "_phase"))
    )
    # Every phase has the same weight in the mean of the phase means.
    first_of_phase = F.when(F.row_number().over(Window.partitionBy(*keys, "_phase").orderBy(day)) == 1, F.col("_phase_mean"))
    centred_phase = with_phase.withColumn("_once", first_of_phase).withColumn(
        "seasonal", F.col("_phase_mean") - F.avg("_once").over(everything)
    )
    return centred_phase.withColumn("resid", detrended - F.col("seasonal")).drop("_phase", "_phase_mean", "_once")


def yoy_comparison(
    df: DataFrame, years: int = 3, min_rows: int = 365, value: str = VALUE, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """The last years of each series side by side, aligned on month and day.

    ``year_1`` is the latest year. Series with fewer than ``min_rows`` days
    give no rows.
    """
    everything = Window.partitionBy(*keys)
    ranked = df.select(
        *keys,
        F.date_format(day, "MM-dd").alias("month_day"),
        F.col(value),
        F.count(F.lit(1)).over(everything).alias("_n"),
        F.dense_rank().over(everything.orderBy(F.year(day).desc())).alias("_rank"),
    ).filter((F.col("_n") >= min_rows) & (F.col("_rank") <= years))
    return ranked.groupBy(*keys, "month_day").agg(
        *[F.max(F.when(F.col("_rank") == i, F.col(value))).alias(f"year_{i}") for i in range(1, years + 1)]
    )


def rank_from_end(keys: Sequence[str] = (), day: str = DAY) -> Column:
    """1 for the latest day of a series, 2 for the day before it, …"""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(day).desc()))


def tail_rows(df: DataFrame, n: int, skip: int = 0, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """The last ``n`` days of each series, after leaving out the ``skip`` latest."""
    ranked = df.withColumn("_rank", rank_from_end(keys, day))
    return ranked.filter(F.col("_rank").between(skip + 1, skip + n)).drop("_rank")


def fill_forward_backward(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Replace nulls by the last value before, else by the first one after."""
    w = series_window(keys, day)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) for c in columns}
    )
