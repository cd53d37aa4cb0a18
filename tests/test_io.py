"""Sources, sinks, pages, streams and the whole run."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from barograph.operators.daily import daily_series
from barograph.operators.series import burst_flags
from barograph.plans import workflows
from barograph.session import scratch_dir
from barograph.sources import pages, tables
from barograph.sources.adapters import EVENT_TYPES, event_alerts
from barograph.streaming import bursts, jobs, replay
from barograph.streaming.store import DayStore, recount_days

LISTED = """<html><body><div class="alert-item extra"><a class="alert-title" href="/a/1"> Flood &amp; Storm Warning </a>
<div class="row"><div>Area:</div><div>Cook County</div></div><div class="row"><div>Severity:</div><div>Severe</div></div>
<div class="row"><div>lonely</div></div><div class="alert-text">Water is <b>rising</b>.<script>no()</script></div></div>
<div class="alert-item"><div class="alert-text">no title</div></div></body></html>"""
LONG = "x" * 60
LOOSE = f'<p>a<br>b<section class="my-ALERT-box"> {LONG} <i>tail</i> </section><div class="alert">short</div>'
PLAIN = "<div class='other'>" + LONG + "</div>"
ROWS = [(1, "http://h/p", LISTED), (2, "http://h/q", LOOSE), (3, "http://h/r", PLAIN), (4, "http://h/s", None)]


def page_alerts(spark, **options):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return pages.pages_to_alerts(df, F.lit("2024-05-06 07:08:09"), **options).orderBy("title").collect()


def test_pages_to_alerts(spark):
    listed, loose = page_alerts(spark, base_url="http://base.org")
    assert listed["title"] == "Flood & Storm Warning" and listed["type"] == "flood"
    assert listed["text"] == "Water is rising." and listed["link"] == "http://base.org/a/1"
    assert (listed["region"], listed["severity"], listed["certainty"], listed["urgency"]) == ("Cook County", "Severe", "Unknown", "Unknown")
    assert listed["issued_date"] == dt.datetime(2024, 5, 6, 7, 8, 9) and listed["effective_date"] == ""
    assert loose["title"] == "Weather Alert" and loose["type"] == "other" and loose["text"] == LONG + " tail"
    assert loose["alert_id"].startswith("fallback_")


def test_fallback_text_is_cut_and_links_follow_the_page(spark):
    listed, loose = page_alerts(spark, max_chars=10)
    assert loose["text"] == "x" * 10 and listed["link"] == "http://h/a/1"


def test_csv_round_trip_with_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi",\nthere', ["a", "b"])], "alert_id string, text string, keywords array<string>")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    row = tables.read_alerts(spark, str(tmp_path / "t")).first()
    assert row["text"] == 'say "hi",\nthere' and json.loads(row["keywords"]) == ["a", "b"]


def test_daily_csv_with_bad_values(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text("issued_date,total_alerts,severity_score\n2024-01-01,3.0,0.5\nsoon,x,y\n")
    rows = tables.read_daily(spark, str(tmp_path / "d"), "csv").collect()
    assert tuple(rows[0]) == (dt.date(2024, 1, 1), 3, 0.5) and tuple(rows[1]) == (None, None, None)


def test_missing_tables_are_empty(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("not parquet")
    got = tables.load_tables(spark, {"daily_stats": str(tmp_path / "none"), "forecasts": str(tmp_path / "none")})
    assert got["daily_stats"].count() == 0 and "date" in got["daily_stats"].columns
    assert got["forecasts"].columns == ["date", "target", "forecast", "lower_bound", "upper_bound"]


def test_insights_file_or_default(spark, tmp_path):
    assert tables.read_insights(spark, str(tmp_path / "none")).count() == 4
    (tmp_path / "broken.json").write_text("{not json")
    assert tables.read_insights(spark, str(tmp_path / "broken.json")).count() == 4
    document = spark.createDataFrame([(["one", "two"],)], "insights array<string>").select(F.lit("2024-01-01").cast("timestamp").alias("generated_at"), "insights")
    tables.write_insights(document, str(tmp_path / "ok"))
    assert [r["text"] for r in tables.read_insights(spark, str(tmp_path / "ok")).orderBy("seq").collect()] == ["one", "two"]


def test_append_compact(spark, tmp_path):
    base = str(tmp_path / "raw")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "alert_id string, x long")
    second = spark.createDataFrame([("b", 2)], "alert_id string, x long")
    tables.append_batch(first, base, F.lit("2024-01-01"), 1)
    assert tables.append_batch(second, base, F.lit("2024-01-02"), 2)
    assert os.path.isdir(f"{base}/batch_seq=2/ingest_date=2024-01-02")
    # A batch that comes again adds nothing; one that was not finished does not count and is replaced.
    assert not tables.append_batch(first.union(second), base, F.lit("2024-01-03"), 2)
    first.withColumn("ingest_date", F.lit("2024-01-09")).write.partitionBy("ingest_date").parquet(f"{base}/batch_seq=3")
    assert tables.read_batches(spark, base).count() == 3
    assert tables.append_batch(second.limit(0), base, F.lit("2024-01-04"), 3) and tables.read_batches(spark, base).count() == 3
    tables.compact_alerts(spark, base, str(tmp_path / "snapshot"))
    assert sorted((r["alert_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "snapshot")).collect()) == [("a", 1), ("b", 2)]


def test_scratch_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_dir(spark, "t"), scratch_dir(spark, "t")
    assert first != second and (base is None or first.startswith(base))


# Streams ----------------------------------------------------------------------


def as_files(spark, sf, folder, parts):
    """The events in several files, written in order of time."""
    alerts = event_alerts(spark, sf)
    for i in range(parts):
        low, high = i * 30 // parts + 1, (i + 1) * 30 // parts
        alerts.filter(F.dayofmonth("issued_date").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
    return alerts


def test_stream_equals_batch_over_many_files(spark, sf, tmp_path):
    alerts = as_files(spark, sf, str(tmp_path / "in"), 5)
    stream = jobs.read_alert_stream(spark, str(tmp_path / "in"), alerts.schema, files_per_trigger=1)
    counts = jobs.windowed_counts(jobs.dedupe_stream(stream), ["type"], width="1 day", lateness=None)
    jobs.start(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["window_start"].date(), r["type"]): r["total_alerts"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = alerts.agg(F.max("issued_date")).first()[0] - dt.timedelta(days=1)
    batch = alerts.groupBy(F.to_date("issued_date").alias("d"), "type").count().collect()
    expected = {(r["d"], r["type"]): r["count"] for r in batch if dt.datetime.combine(r["d"], dt.time()) + dt.timedelta(days=1) <= last}
    assert got == expected and len(got) > 100


def test_repeated_alerts_count_once(spark, sf, tmp_path):
    alerts = event_alerts(spark, sf)
    alerts.union(alerts.filter("type = 'click'")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.dedupe_stream(jobs.read_alert_stream(spark, str(tmp_path / "in"), alerts.schema))
    jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == alerts.count()


def test_enriched_stream_equals_batch(spark, sf, tmp_path):
    from barograph.operators.enrich import process_alerts
    from barograph.sources.adapters import document_alerts

    alerts = document_alerts(spark, sf).limit(40).withColumn("issued_date", F.col("issued_date").cast("timestamp"))
    alerts.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = jobs.enrich_stream(jobs.read_alert_stream(spark, str(tmp_path / "in"), stored.schema))
    jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["alert_id", "keywords", "sentiment_score", "severity_score", "word_count", "entities", "week_of_year"]
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    assert got == sorted(map(str, process_alerts(stored).select(columns).collect()))


ALERT = "alert_id string, issued_date timestamp, type string"
DAYS = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def day_store(spark, folder, **options):
    return DayStore(spark, str(folder), spark.createDataFrame([], ALERT).schema, **options)


def stored_rows(store, days=None):
    return sorted((r["alert_id"] or "", str(r["issued_date"])[:10], r["type"]) for r in store.read(days).collect())


def test_upserts_recount_the_touched_days(spark, tmp_path):
    daily = str(tmp_path / "daily")
    store = day_store(spark, tmp_path / "table")
    sink = recount_days(store, daily, types=["flood"])

    def counts():
        return {str(r["issued_date"]): (r["total_alerts"], r["flood"]) for r in spark.read.parquet(daily).collect()}

    sink(spark.createDataFrame([("a", DAYS[0], "flood"), ("b", DAYS[0], "storm"), ("c", DAYS[1], "flood")], ALERT), 0)
    sink(spark.createDataFrame([("a", DAYS[2], "flood")], ALERT), 1)
    assert counts() == {"2024-01-01": (1, 0), "2024-01-02": (1, 1), "2024-01-03": (1, 1)}
    assert store.read().count() == 3
    for again in (1, 0):
        sink(spark.createDataFrame([("a", DAYS[2], "flood")], ALERT), again)
        assert counts() == {"2024-01-01": (1, 0), "2024-01-02": (1, 1), "2024-01-03": (1, 1)}
    sink(spark.createDataFrame([("b", DAYS[1], "flood")], ALERT), 2)
    assert counts() == {"2024-01-01": (0, 0), "2024-01-02": (2, 2), "2024-01-03": (1, 1)}


def test_store_keeps_the_last_version(spark, tmp_path):
    """Random batches with moves to and fro, null keys and times; folded and vacuumed on the way."""
    rng = random.Random(1)
    store, expected = day_store(spark, tmp_path / "table", buckets=3, fan_in=3), {}
    for batch in range(7):
        rows = [(rng.choice([*"abcdefghij", None]), rng.choice([*DAYS, None]), f"{batch}-{i}") for i in range(rng.randrange(1, 8))]
        last = {}
        for key, time, kind in rows:
            # Of equal keys the latest time wins, null before all, then the largest row.
            if key not in last or (time or dt.datetime.min, kind) > (last[key][0] or dt.datetime.min, last[key][1]):
                last[key] = (time, kind)
        expected |= last
        store.upsert(spark.createDataFrame(rows, ALERT), batch)
        store.vacuum()
        assert stored_rows(store) == sorted((k or "", str(t)[:10], kind) for k, (t, kind) in expected.items())
    commit = store.latest()
    assert max(map(len, commit.days.values())) < 3 and max(map(len, commit.buckets.values())) < 3
    on = stored_rows(store, ["2024-01-03"])
    assert on == sorted((k or "", str(t)[:10], kind) for k, (t, kind) in expected.items() if t == DAYS[2])


def test_store_reads_only_touched_days(spark, tmp_path):
    store = day_store(spark, tmp_path / "table")
    store.upsert(spark.createDataFrame([(str(i), d, "flood") for i, d in enumerate(DAYS)], ALERT), 0)
    assert store.upsert(spark.createDataFrame([("0", DAYS[5], "storm")], ALERT), 1) == ["2024-01-01", "2024-01-06"]
    read = {part for f in store.read(["2024-01-06"]).inputFiles() for part in f.split("/") if part.startswith("_day=")}
    assert read == {"_day=2024-01-06"}
    assert stored_rows(store, ["2024-01-01"]) == [] and len(stored_rows(store, ["2024-01-06"])) == 2


def test_failed_batch_leaves_nothing_that_counts(spark, tmp_path, monkeypatch):
    store = day_store(spark, tmp_path / "table")
    store.upsert(spark.createDataFrame([("a", DAYS[0], "flood")], ALERT), 0)
    with monkeypatch.context() as broken:
        broken.setattr(DayStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([("a", DAYS[1], "storm"), ("b", DAYS[1], "storm")], ALERT), 1)
    assert stored_rows(store) == [("a", "2024-01-01", "flood")]
    store.upsert(spark.createDataFrame([("a", DAYS[2], "fire")], ALERT), 1)
    assert stored_rows(store) == [("a", "2024-01-03", "fire")]
    assert stored_rows(day_store(spark, tmp_path / "new")) == []


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(bursts.STATE_STORE)
    bursts.use_rocksdb(spark)
    yield
    spark.conf.set(bursts.STATE_STORE, before)


def test_stream_of_bursts(spark, tmp_path, rocksdb):
    """Gaps, a silent key, late and out-of-order alerts; one series without keys too."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        key, day = rng.choice("aab"), rng.choice([1, 2, 3, 4, 5, 9, 10, 11, 24, 25, 26])
        rows.append((str(i), dt.datetime(2024, 1, day, rng.randrange(24)), key if day != 24 else "c", (day + rng.randrange(2)) // 8))
    alerts = spark.createDataFrame(rows, "alert_id string, issued_date timestamp, type string, slice int")
    for keys in (["type"], []):
        base = str(tmp_path / ("keyed" if keys else "one"))

        def start(stream, keys=keys, base=base):
            return jobs.start(bursts.burst_stream(stream, keys, lateness="1 day"), f"{base}/out", f"{base}/cp")

        replay.replay(alerts, F.col("slice"), f"{base}/in", start)
        got = spark.read.parquet(f"{base}/out")
        marks = {s: max((r[1] for r in rows if r[3] < s), default=dt.datetime.min) for s in {r[3] for r in rows}}
        end = max(r[1] for r in rows) - dt.timedelta(days=1)
        closes = [r[1].replace(hour=0) + dt.timedelta(days=1) for r in rows]
        kept = [r for r, c in zip(rows, closes) if (marks[r[3]] == dt.datetime.min or c > marks[r[3]] - dt.timedelta(days=1)) and c <= end]
        assert 0 < len(kept) < len(rows)
        batch = daily_series(spark.createDataFrame(kept, alerts.schema), keys, (), type_col="none")
        expected = burst_flags(batch, keys=keys)
        columns = [*keys, "issued_date", "total_alerts", F.round("burst_threshold", 9), "burst"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


# The whole run ----------------------------------------------------------------


def test_all_stages(spark, sf, tmp_path):
    from barograph.sources.adapters import document_alerts

    alerts = document_alerts(spark, sf)
    spread = alerts.withColumn("issued_date", F.expr("date_add(DATE'2024-01-01', CAST(alert_id * 37 % 200 AS INT))").cast("string"))
    settings = workflows.Settings(str(tmp_path), forecast_params={"maxIter": 1, "maxDepth": 2, "seed": 1})
    found = workflows.run_all(spark, spread.withColumn("type", F.lit("flood")), F.lit("2024-07-20 00:00:00"), settings)
    assert found.count() >= 2
    written = {p for p in os.listdir(tmp_path)}
    assert written == {
        "alerts_processed", "alerts_daily", "dashboard_data", "anomaly_results", "anomaly_explanations",
        "forecast_results", "forecast_evaluation", "insights",
    }
    assert tables.read_insights(spark, f"{tmp_path}/insights").count() == found.count()
    # Four targets: total, flood, storm and wind.
    assert spark.read.parquet(f"{tmp_path}/forecast_results").count() == 4 * 7


def test_models_are_loaded_or_fitted(spark, sf, tmp_path):
    days = daily_series(event_alerts(spark, sf), types=EVENT_TYPES)
    first = workflows.load_or_fit_anomaly(spark, str(tmp_path / "m"), days, types=EVENT_TYPES)
    second = workflows.load_or_fit_anomaly(spark, str(tmp_path / "m"), days)
    assert first.offset == second.offset and second.types == EVENT_TYPES


def test_no_forecast_is_an_error_unless_asked(spark, sf, tmp_path):
    days = daily_series(event_alerts(spark, sf), types=EVENT_TYPES)
    settings = workflows.Settings(str(tmp_path))
    with pytest.raises(ValueError, match="no target"):
        workflows.predict(spark, days, settings)
    assert workflows.predict(spark, days, settings, fallback_day=F.lit("2024-02-01").cast("date")).count() == 7
