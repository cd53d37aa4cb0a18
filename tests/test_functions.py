"""Hand-written expectations for the column functions."""

from __future__ import annotations

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barograph.functions import display, severity, text, timeparts
from barograph.schemas import ALERT_TYPES


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(True) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def one(spark, value, column, schema="x string"):
    return values(spark, [(value,)], schema, y=column)[0]["y"]


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("Flash Flood Warning", "flood"),
        ("Winter Storm Watch", "storm"),
        ("Wind Chill Advisory", "wind"),
        ("Rip Current Statement", "coastal"),
        ("Special Notice", "winter"),
        ("Test", "other"),
        ("Freezing Rain", "winter"),
        ("Red Flag", "fire"),
        ("Air Quality Alert", "air"),
        (None, "other"),
    ],
)
def test_classify(spark, title, expected):
    assert one(spark, title, text.classify(F.col("x"))) == expected


def test_classify_word_boundary(spark):
    assert one(spark, "Special Notice", text.classify(F.col("x"), word_boundary=True)) == "other"
    assert one(spark, "Ice storm", text.classify(F.col("x"), word_boundary=True)) == "storm"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Go to https://x.y/z NOW! 45mph; stay-in.", "go to now! mph stay in."),
        (None, ""),
        ("  A\u00a0b\tc  ", "a b c"),
        ("www.site.org Hail", "hail"),
        ("ÉTÉ été", "t t"),
    ],
)
def test_clean_text(spark, raw, expected):
    assert one(spark, raw, text.clean_text(F.col("x"))) == expected


def reference_clean(raw: str) -> str:
    lowered = re.sub(r"https?://\S+|www\.\S+", "", raw.lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z\s.,!?]", " ", lowered)).strip()


ALPHABET = st.text(alphabet="aZ é\u00a0\n\t.,!?;-1w:/", max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(ALPHABET, st.just("see http://a.b/c\u00a0d www.x y")), min_size=20, max_size=20))
def test_clean_text_agrees_with_stepwise_cleaning(spark, raws):
    found = values(spark, [(r,) for r in raws], "x string", y=text.clean_text(F.col("x")))
    assert [f["y"] for f in found] == [reference_clean(r) for r in raws]


def test_keywords_by_frequency_then_first_use(spark):
    raw = "rain hail rain wind hail rain gust wind the of ab"
    assert one(spark, raw, text.keywords(text.tokens(F.col("x")), 3)) == ["rain", "hail", "wind"]
    assert one(spark, "", text.keywords(text.tokens(F.col("x")), 3)) == []
    assert one(spark, "weather alert of", text.keywords(text.tokens(F.col("x")), 3)) == []


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["rain", "hail", "gust", "snow", "the"]), max_size=30), min_size=10, max_size=10))
def test_token_counts_agree_with_a_counter(spark, texts):
    from collections import Counter

    found = values(spark, [(" ".join(t),) for t in texts], "x string", y=text.token_counts(text.tokens(F.col("x"))))
    for words, row in zip(texts, found):
        kept = [w for w in words if w != "the"]
        assert [(r["token"], -r["neg"]) for r in row["y"]] == Counter(kept).most_common()


def test_keywords_of_a_long_text(spark):
    raw = " ".join(f"word{chr(97 + i % 26)}" + "x" * (i % 7) for i in range(50_000))
    counts = one(spark, raw, text.token_counts(text.tokens(F.col("x"))))
    assert sum(-c["neg"] for c in counts) == 50_000


@pytest.mark.parametrize(
    ("score", "label"),
    [(0.31, "urgent_negative"), (0.3, "cautionary"), (0.1, "neutral"), (-0.1, "concern"), (-0.3, "severe")],
)
def test_sentiment_label(spark, score, label):
    assert one(spark, score, severity.sentiment_label(F.col("x")), "x double") == label


def test_sentiment(spark):
    lexicon = {"good": (0.5, 0.4), "bad": (-1.0, 0.8)}
    assert one(spark, "good bad bad day", text.sentiment(F.col("x"), lexicon)) == pytest.approx(
        {"sentiment_score": -0.5, "subjectivity": 2.0 / 3}
    )
    assert one(spark, "", text.sentiment(F.col("x"), lexicon)) == {"sentiment_score": 0.0, "subjectivity": 0.0}


def test_entities(spark):
    raw = "In Cook County winds 45 mph and 3.5\u00a0Inches, 5 inland until 10:30 PM, from 8:00 to 9:15 on 1/2/2024 at 1200 UTC."
    found = one(spark, raw, text.entities(F.col("x")))
    assert found["locations"] == ["Cook County", "In Cook County"]
    assert [(m["value"], m["unit"]) for m in found["measurements"]] == [("3.5", "Inches"), ("45", "mph"), ("5", "in")]
    assert found["time_references"] == ["1/2/2024", "10:30 PM", "1200 UTC", "8:00-9:15"]
    assert one(spark, None, text.entities(F.col("x"))) == {"locations": [], "measurements": [], "time_references": []}


PLACES = [
    r"in\s+([A-Z][a-z]+\s*(?:County|Parish|Borough))",
    r"for\s+([A-Z][a-z]+\s*(?:County|Parish|Borough))",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:County|Parish|Borough))",
]
PIECES = st.sampled_from(
    ["Cook", "a", "in", "for", "County", "county", "Countyside", "Parish", "Borough", ".", "x9", "9", "cookcounty", "  ", "\n", "é", ","]
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=14), min_size=25, max_size=25))
def test_locations_agree_with_the_backtracking_patterns(spark, texts):
    raws = [" ".join(t) for t in texts] + ["".join(t) for t in texts]
    found = values(spark, [(r,) for r in raws], "x string", y=text.locations(F.col("x")))
    expected = [sorted({m for p in PLACES for m in re.findall(p, r, re.IGNORECASE)}) for r in raws]
    assert [f["y"] for f in found] == expected


def test_locations_of_a_long_text_without_punctuation(spark):
    raw = "word " * 30_000 + "Cook County"
    assert len(one(spark, raw, text.locations(F.col("x")))[0]) == len(raw)


def test_text_metrics(spark):
    raw = "URGENT: Flood WARNING! Stay. . 12 inches, A1 B22 NOW!"
    row = values(spark, [(raw,)], "x string", **text.text_metrics(F.col("x")))[0]
    words = raw.split()
    assert row == {
        "word_count": len(words),
        "sentence_count": 2,
        "avg_word_length": pytest.approx(sum(map(len, words)) / len(words)),
        "exclamation_count": 2,
        "all_caps_count": 3,
        "urgency_keywords": 2,
        "numeric_count": 1,
    }
    empty = values(spark, [(None,)], "x string", **text.text_metrics(F.col("x")))[0]
    assert set(empty.values()) == {0}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAB É1_\u00a0\x1c\n.!", max_size=30), min_size=20, max_size=20))
def test_text_metrics_agree_with_python(spark, raws):
    found = values(spark, [(r,) for r in raws], "x string", **text.text_metrics(F.col("x")))
    for raw, row in zip(raws, found):
        assert row["word_count"] == len(raw.split())
        assert row["sentence_count"] == len([s for s in raw.split(".") if s.strip()])
        assert row["all_caps_count"] == len(re.findall(r"\b[A-Z]{2,}\b", raw))
        assert row["numeric_count"] == len(re.findall(r"\b\d+\b", raw))


def test_build_text(spark):
    row = values(spark, [("a", None)], "t string, d string", y=text.build_text([F.col("t"), F.col("d")]))[0]
    assert row["y"] == "a "


def test_severity_score(spark):
    def score(s, mood, urgent, marks):
        c = severity.severity_score(F.col("s"), F.col("m"), F.col("u"), F.col("e"))
        return values(spark, [(s, mood, urgent, marks)], "s string, m double, u long, e long", y=c)[0]["y"]

    assert score("Severe", -0.4, 2, 1) == 1.0
    assert score("Minor", 0.5, 1, 0) == pytest.approx(0.3)
    assert score(None, None, None, None) == pytest.approx(0.1)
    assert score("unheard of", 0.0, 9, 9) == pytest.approx(0.6)
    assert one(spark, "", severity.severity_score(None)) == 0.3


@pytest.mark.parametrize(
    ("x", "label"),
    [(0.1, "low"), (0.1001, "medium"), (0.3, "medium"), (0.5, "high"), (0.51, "critical"), (None, None)],
)
def test_confidence_bin(spark, x, label):
    assert one(spark, x, severity.confidence_bin(F.col("x")), "x double") == label


def test_confidence_rank_orders_labels(spark):
    ranks = [one(spark, x, severity.confidence_rank(F.col("x"))) for x in ("low", "medium", "high", "critical")]
    assert ranks == [1, 2, 3, 4]


@pytest.mark.parametrize(("x", "band"), [(29.9, "low"), (30.0, "guarded"), (60.0, "elevated"), (80.0, "critical")])
def test_risk_band(spark, x, band):
    assert one(spark, x, severity.risk_band(F.col("x")), "x double") == band


@pytest.mark.parametrize(("x", "status"), [(23.9, "fresh"), (24.0, "stale"), (72.0, "outdated"), (None, "N/A")])
def test_freshness(spark, x, status):
    assert one(spark, x, severity.freshness(F.col("x")), "x double") == status


def test_category(spark):
    found = values(spark, [(t,) for t in [*ALERT_TYPES, "FLOOD", "quake", None]], "x string", y=severity.alert_category(F.col("x")))
    assert [f["y"] for f in found] == [
        "hydrological", "meteorological", "meteorological", "meteorological", "environmental", "environmental",
        "environmental", "oceanic", "environmental", "other", "hydrological", "other", "other",
    ]


def test_alert_key_is_stable(spark):
    keys = values(
        spark, [("a", "2024-01-01", "r"), ("a", "2024-01-01", "r"), ("b", "2024-01-01", "r")], "t string, d string, r string",
        y=severity.alert_key(F.col("t"), F.col("d"), F.col("r")),
    )
    assert keys[0] == keys[1] != keys[2]


@pytest.mark.parametrize(
    ("x", "shown"),
    [
        (None, "N/A"), (1_500_000.0, "1.5M"), (2000.0, "2.0K"), (0.0, "0"), (0.001, "1.00e-03"), (0.25, "0.250"),
        (2.25, "2.2"), (12.34, "12.3"), (250.0, "250"), (-5.0, "-5.0"), (float("nan"), "N/A"), (999.5, "1000"), (-0.5, "-0.500"),
    ],
)
def test_format_number(spark, x, shown):
    assert one(spark, x, display.format_number(F.col("x")), "x double") == shown


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=30, max_size=30))
def test_fixed_agrees_with_python_formatting(spark, numbers):
    found = values(spark, [(n,) for n in numbers], "x double", y=display.fixed(F.col("x"), 1))
    assert [f["y"].replace("-0.0", "0.0") if f["y"] == "-0.0" else f["y"] for f in found] == [
        "0.0" if f"{n:.1f}" == "-0.0" else f"{n:.1f}" for n in numbers
    ]


@pytest.mark.parametrize(
    ("cur", "prev", "expected"),
    [
        (120.0, 100.0, (20.0, 20.0, "increase", True)),
        (5.0, 0.0, (0.0, 0.0, "neutral", False)),
        (95.0, 100.0, (-5.0, 5.0, "decrease", False)),
        (100.0, 100.0, (0.0, 0.0, "neutral", False)),
        (110.0, 100.0, (10.0, 10.0, "increase", False)),
    ],
)
def test_change_metrics(spark, cur, prev, expected):
    row = values(spark, [(cur, prev)], "c double, p double", y=display.change_metrics(F.col("c"), F.col("p")))[0]["y"]
    assert tuple(row.values()) == pytest.approx(expected)


def test_parse_timestamp(spark):
    col = timeparts.parse_timestamp(F.col("x"), ["MM/dd/yyyy HH:mm"])
    shown = F.date_format(col, "yyyy-MM-dd HH:mm")
    assert one(spark, "2024-01-02T03:04:05Z", shown) == "2024-01-02 03:04"
    assert one(spark, "01/02/2024 05:06", shown) == "2024-01-02 05:06"
    assert one(spark, "soon", shown) is None
    assert one(spark, "", shown) is None


def test_time_parts(spark):
    row = values(spark, [("2024-12-30 05:00:00",)], "x string", **timeparts.time_parts(F.col("x").cast("timestamp")))[0]
    assert row == {"hour": 5, "day_of_week": 0, "day_of_year": 365, "week_of_year": 1, "month": 12, "year": 2024}


def test_calendar_circle(spark):
    row = values(spark, [("2024-12-30",)], "x string", **timeparts.calendar_features(F.col("x").cast("date")))[0]
    assert row["day_of_week_cos"] == pytest.approx(1.0)
    assert row["month_sin"] == pytest.approx(math.sin(2 * math.pi), abs=1e-12)
    assert row["quarter"] == 4
