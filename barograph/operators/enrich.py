"""From raw alerts to processed alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions import severity as sev
from barograph.functions import text as txt
from barograph.functions.timeparts import parse_timestamp, time_parts
from barograph.functions.wordlists import DEFAULT_LEXICON

TEXT_PARTS = ["title", "description", "headline"]
# Both naming styles of the validity columns are understood.
DATE_COLUMNS = ["issued_date", "scraped_at", "effective", "expires", "effective_date", "expires_date"]
FALLBACK_DATES = ["scraped_at", "effective", "effective_date"]


def with_text(df: DataFrame) -> DataFrame:
    """Add ``text`` from the title-like columns when absent; null texts become empty."""
    if "text" in df.columns:
        return df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return df.withColumn("text", txt.build_text([F.col(c) for c in TEXT_PARTS if c in df.columns]))


def parse_dates(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Parse the string date columns that exist; unreadable values become null."""
    types = dict(df.dtypes)
    parsed = {
        c: parse_timestamp(F.col(c), formats) if types[c] == "string" else F.col(c).cast("timestamp")
        for c in DATE_COLUMNS
        if c in types
    }
    return df.withColumns(parsed) if parsed else df


def primary_date(df: DataFrame, mode: str = "row", default: Column | None = None) -> DataFrame:
    """Fill ``issued_date`` from the other dates.

    ``row`` fills each null. ``column`` replaces the column only when it is
    absent or entirely null, which takes one count over the data. Nothing is
    filled with the current time; pass ``default`` to fill what remains.
    """
    available = [F.col(c) for c in FALLBACK_DATES if c in df.columns]
    issued = [F.col("issued_date")] if "issued_date" in df.columns else []
    last = [default] if default is not None else []
    if mode == "column":
        usable = bool(issued) and df.select("issued_date").na.drop().limit(1).count() > 0
        candidates = issued if usable else available[:1] + last
    elif mode == "row":
        candidates = issued + available + last
    else:
        raise ValueError(f"mode must be 'row' or 'column', not {mode!r}")
    value = F.coalesce(*candidates) if candidates else F.lit(None).cast("timestamp")
    return df.withColumn("issued_date", value)


def text_features(
    df: DataFrame,
    text: str = "text",
    top_n: int = 5,
    lexicon: Mapping[str, tuple[float, float]] = DEFAULT_LEXICON,
) -> DataFrame:
    """Add cleaned text, keywords, sentiment, entities and text metrics."""
    raw, cleaned = F.col(text), F.col("cleaned_text")
    cleaned_df = df.withColumn("cleaned_text", txt.clean_text(raw))
    scored = cleaned_df.withColumns(
        {
            "keywords": txt.keywords(txt.tokens(cleaned), top_n),
            "_sentiment": txt.sentiment(cleaned, lexicon),
            "entities": txt.entities(raw),
            **txt.text_metrics(raw),
        }
    )
    score = F.col("_sentiment.sentiment_score")
    return scored.withColumns(
        {
            "sentiment_score": score,
            "subjectivity": F.col("_sentiment.subjectivity"),
            # A text that is empty after cleaning is neutral, as is score 0.
            "sentiment_label": sev.sentiment_label(score),
        }
    ).drop("_sentiment")


def process_alerts(
    df: DataFrame,
    top_n: int = 5,
    lexicon: Mapping[str, tuple[float, float]] = DEFAULT_LEXICON,
    date_mode: str = "row",
    date_formats: Sequence[str] = (),
) -> DataFrame:
    """The full per-alert enrichment; one narrow stage without any shuffle.

    With ``date_mode='row'`` it works on streaming DataFrames as well.
    """
    df = text_features(with_text(df), top_n=top_n, lexicon=lexicon)
    df = primary_date(parse_dates(df, date_formats), date_mode)
    if "type" not in df.columns:
        df = df.withColumn("type", F.lit("other"))
    severity = F.col("severity") if "severity" in df.columns else None
    return df.withColumns(
        {
            **time_parts(F.col("issued_date")),
            "alert_category": sev.alert_category(F.col("type")),
            "severity_score": sev.severity_score(
                severity, F.col("sentiment_score"), F.col("urgency_keywords"), F.col("exclamation_count")
            ),
        }
    )


def sentiment_by_join(df: DataFrame, lexicon: DataFrame, id_col: str, cleaned: str = "cleaned_text") -> DataFrame:
    """Sentiment with a lexicon table ``(word, polarity, subjectivity)`` of any size.

    Each text is first reduced to ``(id, word, count)`` where it lies, and the
    join is left to the optimizer: a lexicon below the broadcast threshold is
    broadcast, a larger one is shuffled with adaptive skew handling.
    """
    counted = df.select(id_col, F.explode(txt.token_counts(txt.words(F.col(cleaned)))).alias("t"))
    hits = counted.select(id_col, F.col("t.token").alias("word"), (-F.col("t.neg")).alias("n")).join(
        lexicon.select("word", "polarity", "subjectivity"), "word"
    )
    n = F.sum("n")
    means = hits.groupBy(id_col).agg(
        F.try_divide(F.sum(F.col("polarity") * F.col("n")), n).alias("sentiment_score"),
        F.try_divide(F.sum(F.col("subjectivity") * F.col("n")), n).alias("subjectivity"),
    )
    # Ids only: the texts themselves are not shuffled.
    filled = df.select(id_col).join(means, id_col, "left").na.fill(0.0, ["sentiment_score", "subjectivity"])
    return filled.withColumn("sentiment_label", sev.sentiment_label(F.col("sentiment_score")))
