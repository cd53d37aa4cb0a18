"""Registered queries: every operator on the shared test tables.

Each one reads whole tables. Results are shaped for comparison with SQL: days
and times as text, lists joined, doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.functions import display, severity, text, timeparts
from barograph.operators import anomaly, daily, dedupe, enrich, filters, forecast, insights, keywords, series, stats
from barograph.session import scratch_dir
from barograph.sources import adapters, pages, tables
from barograph.sources.adapters import EVENT_TYPES, ORDER_TYPES, read, read_texts
from barograph.streaming import bursts, jobs, replay, store

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
AS_OF = "2024-01-31 12:00:00"


def present(df: DataFrame) -> DataFrame:
    """Days and times as text, lists joined by ``|``, doubles rounded."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = lambda spark, sf_dir: present(function(spark, sf_dir))
    return function


# Daily series -----------------------------------------------------------------


@query
def daily_series(spark, sf):
    return adapters.event_daily(spark, sf)


@query
def daily_type_pivot(spark, sf):
    counts = daily.daily_counts(adapters.event_alerts(spark, sf), ["region"], EVENT_TYPES, means=())
    return daily.fill_days(counts, ["region"])


@query
def daily_by_type_region(spark, sf):
    return daily.daily_series(adapters.event_alerts(spark, sf), ["type", "region"], (), type_col="none")


@query
def type_region_subtotals(spark, sf):
    return daily.subtotals(adapters.event_alerts(spark, sf), ["type", "region"], "cube")


@query
def gap_filled_orders(spark, sf):
    return adapters.order_daily(spark, sf)


@query
def shipping_daily(spark, sf):
    lines = read(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("issued_date"),
        F.col("l_returnflag").alias("type"),
        (F.col("l_discount") / 0.11).alias("severity_score"),
    )
    return daily.daily_series(lines, (), ["A", "N", "R"], id_col=None)


# Windows over series ----------------------------------------------------------


@query
def rolling_features(spark, sf):
    return series.rolling_features(adapters.order_daily(spark, sf))


@query
def lag_features(spark, sf):
    return series.lag_features(adapters.order_daily(spark, sf))


@query
def lag30_features(spark, sf):
    return filters.complete_rows(
        series.lag_features(adapters.order_daily(spark, sf), forecast.LAGS, default=None), ["lag_30"]
    )


@query
def diff_pct(spark, sf):
    return series.diff_pct(adapters.order_daily(spark, sf))


@query
def zscores(spark, sf):
    return series.zscores(adapters.order_daily(spark, sf))


@query
def ema_features(spark, sf):
    return series.ema_features(adapters.order_daily(spark, sf))


@query
def velocity(spark, sf):
    return series.velocity(adapters.event_daily(spark, sf).select("issued_date", "total_alerts"))


@query
def risk_score(spark, sf):
    scored = series.risk_score(adapters.event_daily(spark, sf))
    return scored.select("issued_date", "volume_score", "severity_norm", "velocity_score", "risk_score")


@query
def risk_band(spark, sf):
    return series.current_risk(series.risk_score(adapters.event_daily(spark, sf, ("region",)), keys=["region"]), ["region"])


@query
def burst_days(spark, sf):
    return series.burst_flags(adapters.event_daily(spark, sf).select("issued_date", "total_alerts"))


@query
def burst_by_type(spark, sf):
    keys = ["region", "type"]
    by_key = daily.fill_days(daily.daily_counts(adapters.event_alerts(spark, sf), keys, (), type_col="none", means=()), keys)
    return series.burst_flags(by_key, keys=keys).filter("burst").select(*keys, "issued_date", "total_alerts", "burst_threshold")


@query
def seasonal_decomposition(spark, sf):
    return series.seasonal_decomposition(adapters.order_daily(spark, sf)).drop("total_alerts")


@query
def yoy_comparison(spark, sf):
    return series.yoy_comparison(adapters.order_daily(spark, sf))


@query
def previous_week(spark, sf):
    return series.tail_rows(adapters.event_daily(spark, sf, ("region",)), 7, 7, ["region"]).select("region", "issued_date", "total_alerts")


@query
def filled_prices(spark, sf):
    """Mean urgent order price per day, null days filled from their neighbours."""
    orders = read(spark, sf, "orders")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    by_day = orders.groupBy(F.to_date("o_orderdate").alias("issued_date")).agg(F.avg(urgent).alias("urgent_price"))
    return series.fill_forward_backward(by_day, ["urgent_price"])


# Summary tables ---------------------------------------------------------------


@query
def type_correlation(spark, sf):
    return stats.correlation_matrix(adapters.event_daily(spark, sf), EVENT_TYPES)


@query
def type_share(spark, sf):
    return stats.type_share(adapters.event_daily(spark, sf), EVENT_TYPES)


@query
def top_regions(spark, sf):
    return stats.top_values(adapters.order_alerts(spark, sf), "region", 15)


@query
def kpis(spark, sf):
    return stats.kpis(adapters.event_daily(spark, sf))


@query
def dominant_type(spark, sf):
    return stats.dominant_type(adapters.event_daily(spark, sf, ("region",)), EVENT_TYPES, keys=["region"])


@query
def week_over_week(spark, sf):
    return stats.week_over_week(adapters.event_alerts(spark, sf), ["type", "region"])


@query
def null_report(spark, sf):
    joined = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return stats.null_report(joined)


@query
def date_range(spark, sf):
    return stats.record_summary(adapters.event_alerts(spark, sf))


@query
def type_counts(spark, sf):
    return stats.value_counts(adapters.event_alerts(spark, sf), "type")


@query
def validation(spark, sf):
    joined = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return stats.validation_report(joined, ["doc_id", "text", "quality", "issued_date"])


@query
def monthly_avg(spark, sf):
    return stats.monthly_averages(adapters.order_daily(spark, sf))


@query
def modes(spark, sf):
    return stats.repository_summary(adapters.event_alerts(spark, sf))


@query
def metric_correlation(spark, sf):
    """Order counts against mean order prices per nation and day."""
    alerts = adapters.order_alerts(spark, sf)
    by = ["region", "issued_date"]
    by_day = alerts.groupBy("region", F.to_date("issued_date").alias("issued_date")).agg(
        F.count(F.lit(1)).alias("total_alerts"), F.avg("severity_score").alias("metric")
    )
    return stats.metric_correlation(by_day.select(*by, "total_alerts"), by_day.select(*by, "metric"), by, "metric", by=["region"])


# Text -------------------------------------------------------------------------


def _cleaned(spark, sf) -> DataFrame:
    return read_texts(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("cleaned_text"))


def _tokens() -> Column:
    return text.tokens(F.col("cleaned_text"))


@query
def clean_text(spark, sf):
    return _cleaned(spark, sf)


@query
def clean_turns(spark, sf):
    turns = read(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.clean_text(F.col("text")).alias("cleaned_text"))


@query
def text_metrics(spark, sf):
    metrics = text.text_metrics(F.col("text"))
    return read_texts(spark, sf).select("doc_id", *[c.alias(n) for n, c in metrics.items()])


@query
def keywords_topn(spark, sf):
    return _cleaned(spark, sf).select("doc_id", text.keywords(_tokens(), 5).alias("keywords"))


@query
def keyword_counts(spark, sf):
    return stats.keyword_counts(_cleaned(spark, sf), _tokens())


@query
def keyword_counts_by_source(spark, sf):
    documents = read_texts(spark, sf).select("source", text.clean_text(F.col("text")).alias("cleaned_text"))
    return stats.keyword_counts(documents, _tokens(), ["source"])


@query
def tfidf_top(spark, sf):
    return keywords.tfidf_top(_cleaned(spark, sf), _tokens(), "doc_id", 3)


@query
def keyword_spikes(spark, sf):
    alerts = adapters.document_alerts(spark, sf).select("issued_date", text.clean_text(F.col("text")).alias("cleaned_text"))
    return keywords.keyword_spikes(alerts, _tokens())


@query
def topics(spark, sf):
    return keywords.topic_terms(_cleaned(spark, sf), _tokens(), k=3, terms=5, max_iter=3)


@query
def entities(spark, sf):
    found = read_texts(spark, sf).select("doc_id", text.entities(F.col("text")).alias("e"))
    pairs = F.transform("e.measurements", lambda m: F.concat_ws(" ", m["value"], m["unit"]))
    return found.select(
        "doc_id", F.col("e.locations").alias("locations"), pairs.alias("measurements"), F.col("e.time_references").alias("time_references")
    )


@query
def classify(spark, sf):
    return read_texts(spark, sf).select("doc_id", text.classify(F.col("text")).alias("type"))


@query
def category(spark, sf):
    typed = read_texts(spark, sf).select(text.classify(F.col("text")).alias("type"))
    return stats.value_counts(typed.select(severity.alert_category(F.col("type")).alias("alert_category")), "alert_category")


@query
def lexicon_sentiment(spark, sf):
    scored = _cleaned(spark, sf).select("doc_id", text.sentiment(F.col("cleaned_text")).alias("s"))
    score = F.col("s.sentiment_score")
    return scored.select(
        "doc_id", score.alias("sentiment_score"), F.col("s.subjectivity").alias("subjectivity"), severity.sentiment_label(score).alias("sentiment_label")
    )


@query
def lexicon_sentiment_join(spark, sf):
    rows = [(w, p, s) for w, (p, s) in text.DEFAULT_LEXICON.items()]
    lexicon = spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    return enrich.sentiment_by_join(_cleaned(spark, sf), lexicon, "doc_id")


def _processed(spark, sf) -> DataFrame:
    alerts = adapters.document_alerts(spark, sf)
    return enrich.process_alerts(alerts.withColumn("type", text.classify(F.col("text"))))


@query
def processed_alerts(spark, sf):
    return _processed(spark, sf).select(
        "alert_id", "type", "alert_category", "keywords", "sentiment_score", "sentiment_label", "word_count",
        "urgency_keywords", "exclamation_count", "severity_score", "day_of_week", "week_of_year",
    )


@query
def severity_score(spark, sf):
    return _processed(spark, sf).select("alert_id", "severity_score")


@query
def document_daily(spark, sf):
    return daily.daily_series(_processed(spark, sf))


@query
def time_parts(spark, sf):
    events = read(spark, sf, "events")
    return events.select("event_id", *[c.alias(n) for n, c in timeparts.time_parts(F.col("ts")).items()])


@query
def calendar_features(spark, sf):
    days = adapters.order_daily(spark, sf)
    return days.select("issued_date", *[c.alias(n) for n, c in timeparts.calendar_features(F.col("issued_date")).items()])


@query
def parsed_dates(spark, sf):
    """Dates written as text in two styles, some unreadable, with a fallback."""
    written = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    style = F.pmod("o_orderkey", F.lit(3))
    raw = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(style == 0, written).when(style == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon").alias("issued_date"),
        written.alias("effective_date"),
    )
    return enrich.primary_date(enrich.parse_dates(raw, ["MM/dd/yyyy"]))


@query
def number_formats(spark, sf):
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return parts.select(
        "p_partkey",
        display.format_number(F.col("price")).alias("price"),
        display.format_number(F.col("price") / 7000).alias("small"),
        display.format_number(F.col("price") * 7000).alias("large"),
    )


@query
def week_change(spark, sf):
    weeks = stats.week_over_week(adapters.event_alerts(spark, sf), ["type", "region"])
    change = display.change_metrics(F.col("this_week"), F.col("last_week"))
    return weeks.select("type", "region", change.alias("c")).select("type", "region", "c.*")


# Filters, duplicates, freshness -----------------------------------------------


@query
def dedupe_keep_last(spark, sf):
    """The last event of each user, type and day."""
    events = read(spark, sf, "events").select(
        "user_id", "event_type", F.to_date("ts").alias("day"), "ts", "event_id", "value"
    )
    return dedupe.keep_last(events, ["user_id", "event_type", "day"], ["ts", "event_id"])


@query
def upsert_batches(spark, sf):
    """January's events, then a second batch that corrects the values of the errors."""
    old = adapters.event_alerts(spark, sf)
    new = old.filter("type = 'error'").withColumn("severity_score", F.lit(1.0))
    return dedupe.upsert(old, new).drop("issued_date")


@query
def recent_25(spark, sf):
    return stats.recent_alerts(adapters.event_alerts(spark, sf))


@query
def retention(spark, sf):
    kept = filters.retain_recent(adapters.event_alerts(spark, sf), "issued_date", 7, F.lit(AS_OF).cast("timestamp_ntz"))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("issued_date").alias("oldest"))


@query
def freshness(spark, sf):
    tables = {
        "events": (read(spark, sf, "events"), "ts"),
        "orders": (read(spark, sf, "orders"), "o_orderdate"),
        "nothing": (read(spark, sf, "events").filter("event_type = 'none'"), "ts"),
    }
    return stats.freshness_report(tables, F.lit(AS_OF))


@query
def range_region_filter(spark, sf):
    inside = filters.date_range(adapters.event_alerts(spark, sf), "2024-01-05", "2024-01-20")
    chosen = filters.by_values(filters.valid_dates(inside), type=["click", "error"], region=["region_1", "region_2"])
    return chosen.select("alert_id", "type", "region", "severity_score")


# Pages ------------------------------------------------------------------------


@query
def page_sections(spark, sf):
    found = pages.parse_pages(read_texts(spark, sf, "pages", "page_id"), class_pattern="ad", min_chars=20)
    return found.select("page_id", "seq", "text", "link")


@query
def page_alerts(spark, sf):
    """The entries of the pages' own lists as alerts, by selectors that fit them."""
    markup = pages.Markup(item=("li", None), title=("a", None))
    found = pages.pages_to_alerts(read_texts(spark, sf, "pages", "page_id"), F.lit(AS_OF), markup=markup)
    return found.select("alert_id", "title", "type", "region", "issued_date", "effective_date", "severity", "link")


# Models -----------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    days = adapters.order_full_daily(spark, sf)
    return anomaly.fit_anomaly_model(days, ORDER_TYPES).predict(days)


@query
def anomaly_scores(spark, sf):
    return _scored(spark, sf).select("issued_date", "total_alerts", *anomaly.RESULT_COLUMNS)


@query
def anomaly_by_region(spark, sf):
    """One pooled model over the series of all regions and types."""
    keys = ["region", "type"]
    days = daily.daily_series(adapters.event_alerts(spark, sf), keys, (), type_col="none")
    scored = anomaly.fit_anomaly_model(days, (), keys).predict(days)
    return filters.anomalies_only(scored).select(*keys, "issued_date", "anomaly_score", "anomaly_severity")


@query
def anomaly_explanations(spark, sf):
    return anomaly.explain_anomalies(_scored(spark, sf), ORDER_TYPES)


@query
def anomaly_summary(spark, sf):
    return stats.anomaly_summary(_scored(spark, sf))


@query
def anomaly_timeline(spark, sf):
    days = adapters.order_full_daily(spark, sf)
    return stats.timeline(days, anomaly.fit_anomaly_model(days, ORDER_TYPES).predict(days))


@query
def forecast_features(spark, sf):
    long = forecast.long_series(adapters.order_daily(spark, sf), ["total_alerts"])
    split = forecast.chronological_split(forecast.forecast_features(long).filter("label IS NOT NULL"))
    return split.groupBy("target", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.avg("label").alias("mean_label")
    )


@query
def forecast_7d(spark, sf):
    days = adapters.order_full_daily(spark, sf)
    return forecast.fit_forecaster(days, ["total_alerts", "urgent"]).forecast(days)


@query
def forecast_eval(spark, sf):
    return forecast.evaluate_forecaster(
        adapters.order_daily(spark, sf), ["total_alerts"], params={"maxIter": 5, "maxDepth": 4, "stepSize": 0.3, "seed": 42}
    )


@query
def forecast_accuracy(spark, sf):
    """A forecast made a week before the end, beside what came true."""
    days = adapters.order_daily(spark, sf)
    ranked = days.withColumn("_rank", series.rank_from_end())
    past = ranked.filter("_rank > 7").drop("_rank")
    return forecast.forecast_vs_actual(forecast.fit_forecaster(past, ["total_alerts"]).forecast(past), days)


@query
def insight_rules(spark, sf):
    return insights.insights(adapters.order_full_daily(spark, sf), as_of=F.lit("2001-08-01").cast("date"), types=ORDER_TYPES)


@query
def insight_report(spark, sf):
    days = adapters.order_full_daily(spark, sf)
    scored = anomaly.fit_anomaly_model(days, ORDER_TYPES).predict(days)
    ahead = forecast.fit_forecaster(days, ["total_alerts"]).forecast(days)
    found = insights.insights(days, scored, ahead, F.lit("2001-08-01").cast("date"), ORDER_TYPES)
    return insights.first_insights(found)


# Streams ----------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = read(spark, sf, "events").schema
    raw = jobs.read_alert_stream(spark, sf, schema, ts="ts", pathGlobFilter="events.parquet")
    return adapters.as_event_alerts(raw)


def _run(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and read what it wrote."""
    base = scratch_dir(spark, name)
    jobs.start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query
def stream_hourly(spark, sf):
    return _run(spark, jobs.windowed_counts(jobs.dedupe_stream(_event_stream(spark, sf)), lateness=None), "hourly")


@query
def stream_weekly(spark, sf):
    sliding = jobs.windowed_counts(_event_stream(spark, sf), ["type"], width="7 days", slide="1 day")
    return _run(spark, sliding, "weekly")


#: Slices of replays: days of each, counted from here.
REPLAY_START = "2024-01-01"
SLICE_DAYS = 14


def _arrivals(spark, sf) -> DataFrame:
    """Events with the time at which they come in: most at once, some after hours, a few after twelve days."""
    hours = F.when(F.pmod("alert_id", F.lit(100)) == 99, 288).when(F.pmod("alert_id", F.lit(10)) == 9, 44).when(F.pmod("alert_id", F.lit(10)) > 6, 20)
    alerts = adapters.event_alerts(spark, sf)
    return alerts.withColumn("arrived", F.col("issued_date") + F.make_dt_interval(hours=F.coalesce(hours, F.lit(0))))


def _slice() -> Column:
    return F.floor(F.datediff(F.to_date("arrived"), F.lit(REPLAY_START).cast("date")) / SLICE_DAYS)


def _replayed(spark, rows: DataFrame, purpose: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of the slices of ``rows`` has written after the last one."""
    base = scratch_dir(spark, purpose)
    made = []

    def start(stream):
        made.append(change(stream))
        return jobs.start(made[-1], f"{base}/out", f"{base}/checkpoint")

    replay.replay(rows, _slice(), f"{base}/in", start)
    return spark.read.schema(made[-1].schema).parquet(f"{base}/out")


@query
def stream_bursts(spark, sf):
    bursts.use_rocksdb(spark)
    return _replayed(spark, _arrivals(spark, sf), "bursts", bursts.burst_stream)


@query
def stream_late_alerts(spark, sf):
    """Alerts sent twice, some unchanged and some with a later time, deduplicated while the watermark moves on."""
    once = _arrivals(spark, sf).withColumn("sent", F.lit(1))
    again = once.filter(F.pmod("alert_id", F.lit(5)) < 2).withColumns(
        {
            "sent": F.lit(2),
            "arrived": F.col("arrived") + F.make_dt_interval(days=F.lit(15)),
            "issued_date": F.when(F.pmod("alert_id", F.lit(5)) == 0, F.col("issued_date")).otherwise(F.col("issued_date") + F.make_dt_interval(days=F.lit(10))),
        }
    )
    kept = _replayed(spark, once.union(again), "late", lambda stream: jobs.dedupe_stream(stream, lateness="2 days"))
    return kept.select("alert_id", "issued_date", "type", "sent")


@query
def stream_upserts(spark, sf):
    """Daily counts by region after slices of alerts, corrected ones that change day and type, and a batch that comes twice."""
    base = scratch_dir(spark, "upserts")
    first = _arrivals(spark, sf)
    corrected = first.filter(F.pmod("alert_id", F.lit(6)) == 0).withColumns(
        {
            "arrived": F.col("arrived") + F.make_dt_interval(days=F.lit(15)),
            "issued_date": F.col("issued_date") + F.make_dt_interval(days=F.lit(3)),
            "type": F.lit("corrected"),
        }
    )
    rows = first.union(corrected).withColumn("issued_date", F.col("issued_date").cast("timestamp"))
    table = store.DayStore(spark, f"{base}/alerts", rows.schema, order=["arrived"], fan_in=3)
    recount = store.recount_days(table, f"{base}/daily", ["region"], [*EVENT_TYPES, "corrected"])

    def twice(batch, batch_id):
        recount(batch, batch_id)
        recount(batch, batch_id)

    def start(stream):
        return stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    replay.replay(rows, _slice(), f"{base}/in", start)
    table.vacuum()
    return spark.read.parquet(f"{base}/daily").filter("total_alerts > 0").drop("day")


# Models with fixed or closed-form parameters -----------------------------------

FOREST_TREES = 12
FOREST_FEATURES = ["total_alerts", "urgent", "high"]


def fixed_forest(low: list[float], high: list[float]) -> list[dict]:
    """Full trees of three levels whose features, thresholds and leaf sizes follow from their numbers."""
    trees = []
    for t in range(FOREST_TREES):
        inner = []
        for i in range(7):
            f = (t + i) % len(low)
            threshold = low[f] + (high[f] - low[f]) * ((t * 7 + i * 13) % 17 + 1) / 18
            inner.append({"feature": f, "threshold": threshold, "left": 2 * i + 1, "right": 2 * i + 2, "size": 8})
        leaves = [{"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "size": (t + i) % 5 + 1} for i in range(7, 15)]
        trees.append({"sample_size": 8, "nodes": inner + leaves})
    return trees


@query
def forest_scores(spark, sf):
    days = adapters.order_full_daily(spark, sf)
    values = [F.col(c).cast("double") for c in FOREST_FEATURES]
    bounds = days.agg(F.array(*map(F.min, values)).alias("low"), F.array(*map(F.max, values)).alias("high")).first()
    points = days.select("issued_date", F.array(*values).alias("x"))
    return anomaly.score_rows(points, fixed_forest(bounds["low"], bounds["high"])).select("issued_date", "raw")


@query
def cv_naive(spark, sf):
    long = forecast.long_series(adapters.order_full_daily(spark, sf), ["total_alerts", *ORDER_TYPES]).withColumnRenamed("value", "label")
    return forecast.cross_validate(long, forecast.seasonal_naive())


LINEAR_TARGETS = ["total_alerts", "urgent", "high"]


def _linear(spark, sf, **options) -> DataFrame:
    days = adapters.order_full_daily(spark, sf).select("issued_date", *LINEAR_TARGETS)
    return forecast.fit_linear(days, LINEAR_TARGETS).forecast(days, **options)


@query
def forecast_linear(spark, sf):
    """Least squares over the last week's mean; bounds by the spread of the forecasts."""
    return _linear(spark, sf)


@query
def forecast_linear_residual(spark, sf):
    """The same with bounds by the error of each line, for every region and type."""
    days = daily.daily_series(adapters.order_alerts(spark, sf), ["region"], (), type_col="none").select("region", "issued_date", "total_alerts")
    return forecast.fit_linear(days, ["total_alerts"], ["region"]).forecast(days, interval="residual").drop("rmse", "intercept", "weights")


@query
def forecast_weighted(spark, sf):
    """Fixed weights that run into zero, so that clipped days are fed back."""
    days = adapters.order_daily(spark, sf)
    table = spark.createDataFrame(
        [("total_alerts", -4.0, {"lag_6": 0.5, "rolling_mean_3": 0.25, "diff_1": 0.5}, 1.0)], "target string, intercept double, weights map<string,double>, rmse double"
    )
    return forecast.LinearForecaster(table).forecast(days)


@query
def forecast_values(spark, sf):
    """Every value of the feature vectors."""
    rows = forecast.forecast_features(forecast.long_series(adapters.order_daily(spark, sf), ["total_alerts"]))
    x = vector_to_array("features")
    return rows.select(F.col("day").alias("issued_date"), "label", *[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(forecast.FEATURES)])


@query
def anomaly_values(spark, sf):
    """Every value that anomaly detection reads."""
    values = anomaly.anomaly_features(adapters.order_full_daily(spark, sf), ORDER_TYPES)[0]
    return _coarser(values, "alert_intensity", "severity_score")


def _coarser(df: DataFrame, *columns: str) -> DataFrame:
    """Means of prices on three places: they end there too seldom for the order of a sum to matter."""
    return df.withColumns({c: F.round(c, 3) for c in columns})


# Deterministic flags: what follows from a model, with z-scores in its place -----


def _flagged(spark, sf) -> DataFrame:
    """The order series, flagged where it is over two deviations from its 30-day mean."""
    days = adapters.order_full_daily(spark, sf)
    score = (2 - F.abs("z_score_30")) / 4
    scored = series.zscores(days).select(*days.columns, score.alias("anomaly_score"))
    flags = scored.select("*", (F.col("anomaly_score") < 0).alias("is_anomaly"), F.abs("anomaly_score").alias("anomaly_confidence"))
    return flags.withColumn("anomaly_severity", severity.confidence_bin(F.col("anomaly_confidence")))


@query
def flagged_table(spark, sf):
    found = filters.anomalies_only(_flagged(spark, sf))
    columns = [F.col(c) for c in ("issued_date", "total_alerts", "anomaly_severity", "anomaly_confidence")]
    return found.select(*display.anomaly_display(*columns), severity.confidence_rank(columns[2]).alias("rank"))


@query
def flagged_severe(spark, sf):
    return filters.severe_anomalies(_flagged(spark, sf), ["medium", "high", "critical"]).select("issued_date", "total_alerts", "anomaly_severity")


@query
def flagged_breakdown(spark, sf):
    return stats.severity_breakdown(_flagged(spark, sf))


@query
def flagged_summary(spark, sf):
    return stats.anomaly_summary(_flagged(spark, sf))


@query
def flagged_timeline(spark, sf):
    days = adapters.order_full_daily(spark, sf)
    return _coarser(stats.timeline(days, filters.anomalies_only(_flagged(spark, sf))), "severity_index")


@query
def flagged_reasons(spark, sf):
    return anomaly.explain_anomalies(_flagged(spark, sf), ORDER_TYPES)


@query
def unscored_days(spark, sf):
    return anomaly.unscored(adapters.order_daily(spark, sf))


@query
def flagged_insights(spark, sf):
    """The first findings on flags and forecasts that SQL can follow; the series ends where it has flags."""
    days = adapters.order_full_daily(spark, sf)
    found = insights.insights(days, _flagged(spark, sf), _linear(spark, sf).withColumn("forecast", F.col("forecast") * 1.5), F.lit("2001-08-01").cast("date"), ORDER_TYPES)
    return insights.first_insights(found)


@query
def forecast_summary(spark, sf):
    return stats.forecast_summary(_linear(spark, sf).filter("target = 'total_alerts'"))


@query
def forecast_errors(spark, sf):
    """A linear forecast made a week before the end, beside what came true."""
    days = adapters.order_full_daily(spark, sf).select("issued_date", *LINEAR_TARGETS)
    past = days.withColumn("_rank", series.rank_from_end()).filter("_rank > 7").drop("_rank")
    return forecast.forecast_vs_actual(forecast.fit_linear(past, LINEAR_TARGETS).forecast(past), days).drop("lower_bound", "upper_bound")


@query
def placeholder_forecast(spark, sf):
    """The default forecast after the last day of the orders."""
    last = read(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0]
    return forecast.default_forecast(spark, F.lit(last).cast("date") + 1)


@query
def alert_keys(spark, sf):
    orders = read(spark, sf, "orders")
    return orders.select("o_orderkey", severity.alert_key(F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_custkey")).alias("key"))


@query
def built_texts(spark, sf):
    parts = [F.col("o_orderpriority"), F.when(F.pmod("o_custkey", F.lit(3)) > 0, F.col("o_orderstatus")), F.col("o_custkey")]
    orders = read(spark, sf, "orders")
    return orders.select("o_orderkey", text.build_text(parts).alias("text"), text.build_text(parts[:1]).alias("title"))


# Written and read back ------------------------------------------------------------


@query
def stored_batches(spark, sf):
    """Events in three batches, of which one comes twice and one corrects errors of the first."""
    base = scratch_dir(spark, "raw")
    alerts = adapters.event_alerts(spark, sf)
    part = F.pmod("alert_id", F.lit(2))
    corrected = alerts.filter("type = 'error'").withColumn("type", F.lit("corrected"))
    for seq, batch in ((0, alerts.filter(part == 0)), (1, alerts.filter(part == 1)), (1, alerts.filter(part == 1)), (2, corrected)):
        tables.append_batch(batch, base, F.lit("2024-02-01").cast("date") + seq, seq)
    raw = tables.read_batches(spark, base)
    twice = raw.groupBy("alert_id").agg(F.count(F.lit(1)).alias("versions"))
    return tables.current_alerts(raw).join(twice, "alert_id").select("alert_id", "type", "region", "ingest_date", "batch_seq", "versions")


@query
def stored_series(spark, sf):
    """The daily series through CSV, its types declared, and its dashboard copy."""
    base = scratch_dir(spark, "series")
    alerts = adapters.event_alerts(spark, sf)
    days = daily.daily_series(alerts, (), EVENT_TYPES)
    tables.write_processed(alerts, days, base, "csv")
    back = [tables.read_table(spark, f"{base}/{name}", days.schema, "csv").withColumn("copy", F.lit(name)) for name in ("alerts_daily", "dashboard_data")]
    return back[0].union(back[1])


@query
def stored_findings(spark, sf):
    """Anomalies with their reasons from JSON, beside the forecasts' table."""
    base = scratch_dir(spark, "findings")
    flags, ahead = _flagged(spark, sf), _linear(spark, sf)
    tables.write_anomalies(flags, anomaly.explain_anomalies(flags, ORDER_TYPES), base)
    tables.write_forecasts(ahead, stats.forecast_summary(ahead), base)
    reasons = spark.read.json(f"{base}/anomaly_explanations").select(F.col("date").alias("day"), F.array_join("reasons", "; ").alias("what"))
    kept = spark.read.parquet(f"{base}/anomaly_results").select(F.date_format("issued_date", "yyyy-MM-dd").alias("day"), "total_alerts")
    rows = spark.read.parquet(f"{base}/forecast_results").select(F.date_format("date", "yyyy-MM-dd").alias("day"), F.col("target").alias("what"))
    return kept.join(reasons, "day").select("day", "what", "total_alerts").union(rows.select("day", "what", F.lit(None).cast("long")))


@query
def stored_insights(spark, sf):
    base = scratch_dir(spark, "insights")
    found = insights.insights(adapters.order_full_daily(spark, sf), as_of=F.lit("2001-08-01").cast("date"), types=ORDER_TYPES)
    tables.write_insights(insights.insights_document(found, F.lit(AS_OF)), f"{base}/insights")
    return tables.read_insights(spark, f"{base}/insights").unionByName(tables.read_insights(spark, f"{base}/missing").withColumn("seq", -F.col("seq")))


@query
def stream_enriched(spark, sf):
    """The enrichment of ``processed_alerts`` on a stream of documents."""
    base = scratch_dir(spark, "enriched")
    alerts = adapters.document_alerts(spark, sf).withColumns({"issued_date": F.col("issued_date").cast("timestamp"), "type": text.classify(F.col("text"))})
    alerts.write.parquet(f"{base}/in")
    stream = jobs.enrich_stream(spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in"))
    wanted = stream.select(
        "alert_id", "type", "alert_category", "keywords", "sentiment_score", "sentiment_label", "word_count",
        "urgency_keywords", "exclamation_count", "severity_score", "day_of_week", "week_of_year",
    )
    jobs.start(wanted, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(wanted.schema).parquet(f"{base}/out")
