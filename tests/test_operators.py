"""Duplicates, filters, topics and enrichment."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barograph.operators import dedupe, enrich, filters, keywords


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_lets_the_new_batch_win(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "alert_id string, x long")
    new = spark.createDataFrame([("b", 3, "r"), ("c", 4, "r")], "alert_id string, x long, region string")
    merged = dedupe.upsert(old, new)
    assert rows(merged.select("alert_id", "x")) == [("a", 1), ("b", 3), ("c", 4)]
    again = dedupe.upsert(merged, new)
    assert rows(again.select("alert_id", "x")) == rows(merged.select("alert_id", "x"))
    assert again.filter("alert_id = 'b'").first()["batch_seq"] == 2


def test_upsert_into_an_empty_table(spark):
    empty = spark.createDataFrame([], "alert_id string, x long")
    new = spark.createDataFrame([("a", 1)], "alert_id string, x long")
    assert rows(dedupe.upsert(empty, new).select("alert_id", "x")) == [("a", 1)]


def test_keep_last_with_one_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("n")
    )
    kept = dedupe.keep_last(df, ["k"], ["seq"])
    assert kept.count() == 20_000 - 6667 + 1
    assert kept.filter("k = 'hot'").first()["seq"] == 19_998


def test_date_range_includes_the_last_day(spark):
    stamps = ["2024-01-01 00:00:00", "2024-01-02 23:59:59", "2024-01-03 00:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.to_timestamp("s").alias("issued_date"))
    assert filters.date_range(df, "2024-01-01", "2024-01-02").count() == 2


def test_filters_reach_the_scan(spark, sf):
    from barograph.sources.adapters import event_alerts

    kept = filters.by_values(filters.date_range(event_alerts(spark, sf), "2024-01-05", "2024-01-06"), type=["click"])
    plan = kept.select("alert_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "props" not in plan and "value" not in plan


def test_retention_by_event_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 10, 20)], "issued_date timestamp")
    assert filters.retain_recent(df, "issued_date", 10, F.lit("2024-01-20").cast("timestamp")).count() == 2


def test_value_filters_and_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "region string, type string")
    assert filters.by_values(df, region=["a"], type=None).count() == 1
    assert filters.existing_columns(df, ["none", "type"]) == ["type"]
    assert filters.complete_rows(spark.createDataFrame([(1,), (None,)], "x long"), ["x"]).count() == 1


def test_planted_topics_are_found(spark):
    """Texts of three vocabularies: every topic's leading terms are of one, however the texts are partitioned."""
    rng = random.Random(3)
    vocabulary = [[f"{c}{i}" for i in range(12)] for c in ("river", "wind", "snow")]
    texts = [[rng.choice(vocabulary[i % 3]) for _ in range(40)] for i in range(150)]
    df = spark.createDataFrame([(t,) for t in texts[:120]], "tokens array<string>")
    held_out = spark.createDataFrame([(t,) for t in texts[120:]] + [(["unknown"],), ([],)], "tokens array<string>")
    model = keywords.fit_topics(df, F.col("tokens"), k=3, max_iter=15, partitions=4)
    found = {}
    for r in model.terms(6).collect():
        found.setdefault(r["topic"], set()).add(r["term"].rstrip("0123456789"))
    assert sorted(map(sorted, found.values())) == [["river"], ["snow"], ["wind"]]
    fewer = keywords.fit_topics(df, F.col("tokens"), k=2, max_iter=15, partitions=4)
    assert model.log_perplexity(held_out, F.col("tokens")) < fewer.log_perplexity(held_out, F.col("tokens")) - 0.1

    def rounded(m):
        return sorted((r["topic"], r["rank"], r["term"], round(r["weight"], 6)) for r in m.terms(6).collect())

    assert rounded(keywords.fit_topics(df.repartition(7), F.col("tokens"), k=3, max_iter=15, partitions=4)) == rounded(model)
    with pytest.raises(ValueError):
        keywords.fit_topics(df.limit(0), F.col("tokens"))


def test_topics_make_tokens_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(text):
        made.add(1)
        return text.split()

    df = spark.createDataFrame([(f"river w{i % 7} w{i % 3}",) for i in range(40)], "text string")
    keywords.fit_topics(df, tokens("text"), k=2, max_iter=3, partitions=2)
    assert made.value == 40


def test_tfidf_of_frequent_and_other_terms(spark, monkeypatch):
    """Frequent terms are met by broadcast, others by a shuffle; ids and tokens repeat or are null."""
    rng = random.Random(4)
    texts = [[f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(30))] for _ in range(200)] + [None, [], [None, "w1", "w1"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>")
    count = Counter(w for t in texts for w in {*(t or ())} - {None})
    want = set()
    for i, t in enumerate(texts):
        scores = {w: n * (math.log((1 + len(texts)) / (1 + count[w])) + 1) for w, n in Counter(t or ()).items() if w is not None}
        want |= {(i, k, w) for k, w in enumerate(sorted(scores, key=lambda w: (-round(scores[w], 9), w))[:3], 1)}
    for share in (0.02, 1e-9, 1.0):
        monkeypatch.setattr(keywords, "FREQUENT", share)
        got = keywords.tfidf_top(df, F.col("tokens"), "id")
        assert {(r["id"], r["rank"], r["term"]) for r in got.collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keywords.tfidf_top(df, F.col("tokens"), "id")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_process_alerts_with_minimal_columns(spark):
    raw = spark.createDataFrame(
        [("1", "Flood WARNING", "River at 5 feet!", "soon", "2024-03-04 05:06:07"), ("2", None, None, "2024-03-05", "x")],
        "alert_id string, title string, description string, issued_date string, scraped_at string",
    )
    got = {r["alert_id"]: r.asDict(True) for r in enrich.process_alerts(raw).collect()}
    assert got["1"]["text"] == "Flood WARNING River at 5 feet!"
    assert got["1"]["issued_date"] == dt.datetime(2024, 3, 4, 5, 6, 7) and got["1"]["hour"] == 5
    assert got["1"]["entities"]["measurements"] == [{"value": "5", "unit": "feet"}]
    # No severity column: 0.3, one urgency word: 0.1, one exclamation mark: 0.05.
    assert got["1"]["severity_score"] == pytest.approx(0.45)
    assert got["2"]["text"] == " " and got["2"]["keywords"] == [] and got["2"]["type"] == "other"
    assert got["2"]["sentiment_label"] == "neutral"


def test_primary_date_by_column(spark):
    df = spark.createDataFrame([("2024-01-01", None), ("2024-01-02", None)], "scraped_at string, issued_date string")
    parsed = enrich.parse_dates(df)
    assert enrich.primary_date(parsed, "column").filter("issued_date IS NULL").count() == 0
    some = enrich.parse_dates(spark.createDataFrame([("2024-01-01", None), ("2024-01-02", "2024-01-05")], "scraped_at string, issued_date string"))
    assert enrich.primary_date(some, "column").filter("issued_date IS NULL").count() == 1
    assert enrich.primary_date(some, "row").filter("issued_date IS NULL").count() == 0
    nothing = spark.createDataFrame([(1,)], "x long")
    assert enrich.primary_date(nothing).first()["issued_date"] is None
    with pytest.raises(ValueError):
        enrich.primary_date(some, "other")


def test_sentiment_forms_agree(spark):
    from barograph.functions import text
    from barograph.functions.wordlists import DEFAULT_LEXICON

    texts = spark.createDataFrame([(1, "severe severe calm storm"), (2, ""), (3, "plain")], "id long, cleaned_text string")
    lexicon = spark.createDataFrame([(w, p, s) for w, (p, s) in DEFAULT_LEXICON.items()], "word string, polarity double, subjectivity double")
    joined = {r["id"]: r["sentiment_score"] for r in enrich.sentiment_by_join(texts, lexicon, "id").collect()}
    local = {r["id"]: r["s"]["sentiment_score"] for r in texts.select("id", text.sentiment(F.col("cleaned_text")).alias("s")).collect()}
    assert joined == pytest.approx(local) and joined[1] == pytest.approx((-0.5 - 0.5 + 0.3) / 3)
