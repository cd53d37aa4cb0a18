"""A table of the latest alerts, partitioned by day, for upserts from a stream.

A batch adds one small segment: its alerts under their days, and a tombstone under the
old day of each alert that has moved. An index from key to day, in buckets, finds those
old days, so a batch reads only the buckets and days that it touches. Once a day (or a
bucket) consists of ``fan_in`` segments, the batch folds them into a single one, which
holds alerts from then on once. A commit names the segments of every day and bucket; it
is one small file, written last, so a failed batch leaves nothing behind that counts, and
a batch that comes again is recognised by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.operators.daily import daily_counts
from barograph.operators.dedupe import keep_last
from barograph.schemas import ALERT_TYPES

NO_DAY = "none"


@dataclass
class Commit:
    """What a batch has made of the store: live segments by day and by bucket, and the days it touched."""

    batch: int = -1
    days: dict[str, list[str]] = field(default_factory=dict)
    buckets: dict[str, list[str]] = field(default_factory=dict)
    touched: list[str] = field(default_factory=list)


class DayStore:
    """The latest version of every alert, by day.

    ``schema`` is that of the alerts, ``keys`` tells them apart, and of equal keys in one
    batch the last in ``order`` (then the largest row) wins; a later batch wins over an
    earlier one. Alerts without a time are kept, under a day of their own. Null keys equal
    each other. ``_day``, ``_bucket``, ``_segment``, ``_batch`` and ``_gone`` are reserved.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str] = ("alert_id",),
        ts: str = "issued_date",
        order: Sequence[str] = (),
        buckets: int = 16,
        fan_in: int = 4,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.ts, self.order = list(keys), ts, list(order) or [ts]
        self.buckets, self.fan_in = buckets, fan_in
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    # Commits ------------------------------------------------------------------

    def _log(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> Commit:
        """The last commit; an empty store has none and gives an empty one."""
        log = self._log()
        if not log:
            return Commit()
        text = self.spark.read.text(f"{self.path}/commits/{log[-1]}", wholetext=True).first()[0]
        return Commit(**json.loads(text))

    def _commit(self, commit: Commit) -> None:
        target = self._path(f"{self.path}/commits/{commit.batch}")
        draft = self._path(f"{self.path}/commits/.{commit.batch}.draft")
        out = self._files.create(draft, True)
        out.write(json.dumps(commit.__dict__).encode())
        out.close()
        # Renaming is what makes the batch count.
        if not self._files.rename(draft, target):
            raise OSError(f"batch {commit.batch} is committed already")

    # Reading ------------------------------------------------------------------

    def _segments(self, kind: str, part: str, live: dict[str, list[str]], wanted: Iterable[str], schema: T.StructType) -> DataFrame:
        """Rows of the live segments of ``wanted`` days or buckets; other folders are not even listed."""
        paths = [f"{self.path}/{kind}/_segment={s}/{part}={w}" for w in wanted for s in live.get(w, ())]
        full = T.StructType([*schema.fields, T.StructField("_segment", T.StringType()), T.StructField(part, T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _versions(self, commit: Commit, days: Iterable[str]) -> DataFrame:
        marks = [T.StructField("_batch", T.LongType()), T.StructField("_gone", T.BooleanType())]
        return self._segments("rows", "_day", commit.days, days, T.StructType([*self.schema.fields, *marks])).drop("_segment")

    def _alive(self, versions: DataFrame) -> DataFrame:
        return keep_last(versions, [*self.keys, "_day"], ["_batch"]).filter("not _gone")

    def read(self, days: Iterable[str] | None = None) -> DataFrame:
        """The latest version of every alert, or of those on ``days`` (as ``yyyy-MM-dd``) only."""
        commit = self.latest()
        return self._alive(self._versions(commit, commit.days if days is None else days)).select(*self.schema.names)

    # Writing ------------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def _index(self, commit: Commit, buckets: Iterable[str]) -> DataFrame:
        schema = T.StructType([*(self.schema[k] for k in self.keys), T.StructField("_at", T.StringType()), T.StructField("_batch", T.LongType())])
        entries = self._segments("index", "_bucket", commit.buckets, buckets, schema).drop("_segment")
        return keep_last(entries, [*self.keys, "_bucket"], ["_batch"])

    def _write(self, rows: DataFrame, kind: str, part: str, segment: str) -> None:
        # Adaptive execution splits a day that holds most rows.
        rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{self.path}/{kind}/_segment={segment}")

    def upsert(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Add a batch; returns the days it has touched.

        A batch that is committed already changes nothing and touches nothing, but for
        the last one: its days are returned again, as its caller may not have used them.
        """
        last = self.latest()
        if batch_id <= last.batch:
            return last.touched if batch_id == last.batch else []
        day = F.coalesce(F.date_format(self.ts, "yyyy-MM-dd"), F.lit(NO_DAY))
        rows = batch.select(*self.schema.names)
        newest = keep_last(rows, self.keys, [*self.order, *(c for c in rows.columns if c not in self.keys and c not in self.order)])
        newest = newest.withColumns({"_day": day, "_bucket": self._bucket()}).persist()
        try:
            days = [r[0] for r in newest.select("_day").distinct().collect()]
            buckets = [r[0] for r in newest.select("_bucket").distinct().collect()]
            known = self._index(last, buckets)
            found = newest.alias("n").join(
                known.alias("k"),
                F.expr(" AND ".join([*(f"n.`{k}` <=> k.`{k}`" for k in self.keys), "n._bucket = k._bucket"])),
            )
            moved = found.filter("k._at <> n._day").select("n.*", F.col("k._at").alias("_old")).persist()
            old = [r[0] for r in moved.select("_old").distinct().collect()]
            segment = f"{batch_id:010d}"
            live = [F.lit(batch_id).cast("long").alias("_batch")]
            added = newest.select(*self.schema.names, *live, F.lit(False).alias("_gone"), "_day")
            gone = moved.select(*self.schema.names, *live, F.lit(True).alias("_gone"), F.col("_old").alias("_day"))
            self._write(added.union(gone), "rows", "_day", segment)
            self._write(newest.select(*self.keys, F.col("_day").alias("_at"), *live, "_bucket"), "index", "_bucket", segment)
            moved.unpersist()
        finally:
            newest.unpersist()
        touched = sorted({*days, *old})
        commit = Commit(
            batch_id,
            {**last.days, **{d: [*last.days.get(d, []), segment] for d in touched}},
            {**last.buckets, **{b: [*last.buckets.get(b, []), segment] for b in buckets}},
            touched,
        )
        self._fold(commit)
        self._commit(commit)
        return touched

    def _fold(self, commit: Commit) -> None:
        """Fold the days and buckets that consist of too many segments into one each."""
        segment = f"{commit.batch:010d}-folded"
        days = [d for d, s in commit.days.items() if len(s) >= self.fan_in]
        if days:
            self._write(self._alive(self._versions(commit, days)), "rows", "_day", segment)
            # A day whose alerts have all moved has no folder.
            left = [d for d in days if self._files.exists(self._path(f"{self.path}/rows/_segment={segment}/_day={d}"))]
            commit.days |= {d: [segment] if d in left else [] for d in days}
        buckets = [b for b, s in commit.buckets.items() if len(s) >= self.fan_in]
        if buckets:
            self._write(self._index(commit, buckets), "index", "_bucket", segment)
            commit.buckets |= {b: [segment] for b in buckets}

    def vacuum(self, keep: int = 2) -> None:
        """Delete segments that none of the last ``keep`` commits names, and older commits."""
        log = self._log()
        named: set[tuple[str, str]] = set()
        for batch in log[-keep:]:
            commit = Commit(**json.loads(self.spark.read.text(f"{self.path}/commits/{batch}", wholetext=True).first()[0]))
            named |= {("rows", s) for some in commit.days.values() for s in some} | {("index", s) for some in commit.buckets.values() for s in some}
        for kind in ("rows", "index"):
            folder = self._path(f"{self.path}/{kind}")
            for status in self._files.listStatus(folder) if self._files.exists(folder) else ():
                if (kind, status.getPath().getName().removeprefix("_segment=")) not in named:
                    self._files.delete(status.getPath(), True)
        for batch in log[:-keep]:
            self._files.delete(self._path(f"{self.path}/commits/{batch}"), False)


def recount_days(store: DayStore, daily: str, keys: Sequence[str] = (), types: Sequence[str] = ALERT_TYPES) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that upserts a batch and recounts the days it touches.

    Only touched days are read, and only their partitions of ``daily`` are written; a day
    left without alerts keeps one row of zeros, whose keys are null. A batch that comes
    again recounts its days once more, with the same result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = [d for d in store.upsert(batch, batch_id) if d != NO_DAY]
        if not touched:
            return
        counted = daily_counts(store.read(touched), keys, types, store.ts, store.keys[0])
        days = spark.createDataFrame([(d,) for d in touched], "d string").select(F.to_date("d").alias("issued_date"))
        recounted = days.join(counted, "issued_date", "left")
        numeric = [c for c in counted.columns if c != "issued_date" and c not in keys]
        recounted.na.fill(0, numeric).withColumn("day", F.col("issued_date")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day").parquet(daily)

    return write
