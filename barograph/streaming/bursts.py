"""Burst flags on a stream, from keyed state.

Windowed counting closes a day once the watermark has passed it, so late and
out-of-order alerts are settled before a count gets here. A series keeps its last
counts as state; each closed day is flagged from them and never looked at again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barograph.operators.series import ROUNDING
from barograph.streaming.jobs import windowed_counts

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = dt.timedelta(days=1)


class RecentDays(StatefulProcessor):
    """Emits the closed days of a series in turn, gaps as zeros, each with the counts up to it.

    The state of a series is its last day and at most ``window`` counts, so all state
    grows with the number of series alone. Days of a gap are emitted with the day that
    ends it: until then they may as well lie behind the end of the series.
    """

    def __init__(self, window: int, columns: Sequence[str]):
        self.window = window
        self.row = Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "last date, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, counts = self.recent.get() if self.recent.exists() else (None, [])
        for row in sorted(rows, key=lambda r: r["issued_date"]):
            day = row["issued_date"] if last is None else last + DAY
            while day <= row["issued_date"]:
                n = row["total_alerts"] if day == row["issued_date"] else 0
                counts = [*counts, n][-self.window :]
                yield self.row(*key, day, n, counts)
                last, day = day, day + DAY
        self.recent.update((last, counts))

    def close(self) -> None:
        pass


def flagged(days: DataFrame, k: float) -> DataFrame:
    """Adds mean, sample deviation, threshold and flag of the last of the counts ``recent``."""
    recent, mean = F.col("recent"), F.col("rolling_mean")
    n = F.size(recent)
    squares = F.aggregate(recent, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    with_mean = days.withColumn("rolling_mean", F.aggregate(recent, F.lit(0).cast("long"), lambda a, x: a + x) / n)
    with_std = with_mean.withColumn("rolling_std", F.when(n > 1, F.sqrt(squares / (n - 1))))
    with_threshold = with_std.withColumn("burst_threshold", mean + k * F.col("rolling_std"))
    above = F.element_at(recent, -1) - F.col("burst_threshold") > ROUNDING
    return with_threshold.withColumn("burst", F.coalesce(above, F.lit(False)))


def burst_stream(
    alerts: DataFrame, keys: Sequence[str] = ("type", "region"), ts: str = "issued_date", window: int = 7, k: float = 2.0, lateness: str | None = "2 days"
) -> DataFrame:
    """Every closed day of each series with its burst flag, as ``series.burst_flags`` gives it.

    ``alerts`` is a stream. A day is closed, and emitted once, when the watermark has
    passed its end; alerts that come later are dropped. Days without alerts follow as
    zeros when the next day with alerts is closed. One series (``keys=()``) is one task
    of one row a day. The session must keep state in RocksDB (``use_rocksdb``).
    """
    by = list(keys) or ["_series"]
    counted = alerts if keys else alerts.withColumn("_series", F.lit(0))
    closed = windowed_counts(counted, by, ts, "1 day", lateness=lateness).withColumn("issued_date", F.to_date("window_start"))
    kinds = dict(closed.dtypes)
    kinds |= {"issued_date": "date", "total_alerts": "bigint", "recent": "array<bigint>"}
    columns = [*by, "issued_date", "total_alerts", "recent"]
    days = closed.groupBy(*by).transformWithState(
        statefulProcessor=RecentDays(window, columns),
        outputStructType=", ".join(f"`{c}` {kinds[c]}" for c in columns),
        outputMode="append",
        timeMode="none",
    )
    return flagged(days, k).select(*keys, "issued_date", "total_alerts", "rolling_mean", "rolling_std", "burst_threshold", "burst")


def use_rocksdb(spark: SparkSession) -> None:
    """Let the session keep the state of streams started from now on in RocksDB."""
    spark.conf.set(STATE_STORE, ROCKSDB)
