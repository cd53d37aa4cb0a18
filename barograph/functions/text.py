"""Text functions over whole texts: cleaning, tokens, keywords, sentiment, entities, metrics.

Everything is row-local, so a text never leaves the partition it was read in
and nothing shuffles, however long or repeated the texts are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from barograph.functions.wordlists import DEFAULT_LEXICON, STOP_WORDS, URGENCY_WORDS
from barograph.schemas import TYPE_PHRASES

# The patterns of the entity extraction.
_NAME = r"[A-Z][a-z]+"
_PLACE = r"(?:County|Parish|Borough)"
LOCATION_PATTERNS = [rf"in\s+({_NAME}\s*{_PLACE})", rf"for\s+({_NAME}\s*{_PLACE})"]
# The third pattern is a run of names before a place word; see ``locations``.
_NAME_RUN = r"(?U)(?<![a-zA-Z])[a-zA-Z]{2,}+(?:\s++[a-zA-Z]{2,}+)*+"
_UP_TO_PLACE = rf"(?isU)^(.*\s{_PLACE})"
MEASUREMENT_PATTERN = r"(\d+(?:\.\d+)?)\s*(mph|inches|in|feet|ft|°F|°C|degrees|percent|%)"
UNTIL_PATTERN = r"until\s+(\d{1,2}:\d{2}\s*(?:AM|PM|am|pm))"
FROM_TO_PATTERN = r"from\s+(\d{1,2}:\d{2})\s*to\s*(\d{1,2}:\d{2})"
DATE_PATTERN = r"(\d{1,2}/\d{1,2}/\d{4})"
UTC_PATTERN = r"(\d{4}\s*UTC)"

# Java reads \s, \d and \b as ASCII unless told otherwise; alert text from web
# pages is full of non-breaking spaces, which must count as white space.
_UNICODE = "(?U)"
_UNICODE_NOCASE = "(?iU)"
_WORD = _UNICODE + r"[^\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def build_text(parts: Sequence[Column]) -> Column:
    """Join the text-like fields of an alert, nulls counting as empty."""
    if not parts:
        return F.lit("")
    return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def clean_text(text: Column) -> Column:
    """Lower case, links removed, letters and ``. , ! ?`` kept, single spaces.

    Dropping other characters and collapsing white space are one replacement,
    and the search for links runs only over texts that can hold one.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    no_links = F.regexp_replace(lowered, _UNICODE + r"https?://\S+|www\.\S+", "")
    unlinked = F.when(lowered.contains("://") | lowered.contains("www."), no_links).otherwise(lowered)
    return F.trim(F.regexp_replace(unlinked, r"[^a-z.,!?]+", " "))


def words(cleaned: Column) -> Column:
    """All runs of letters of a cleaned text."""
    return F.filter(F.split(cleaned, "[^a-z]+"), lambda w: w != "")


def tokens(cleaned: Column, stop_words: Sequence[str] = STOP_WORDS, min_length: int = 3) -> Column:
    """Words that are neither stop words nor shorter than ``min_length``.

    Short words are passed over by the search, which costs a third of splitting.
    """
    return F.filter(
        F.regexp_extract_all(cleaned, F.lit(f"[a-z]{{{max(min_length, 1)},}}"), F.lit(0)),
        lambda w: ~w.isin(*stop_words),
    )


def token_counts(token_array: Column) -> Column:
    """``array<struct<neg:int, pos:int, token:string>>``, most frequent first.

    ``neg`` is minus the count and ``pos`` the first position, so the natural
    order of the struct is "frequency descending, then first occurrence". The
    tokens are sorted and cut into runs, O(n log n) in the length of the text.
    """
    placed = F.transform(token_array, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))

    def runs(ordered: Column) -> Column:
        starts = F.array_compact(
            F.transform(
                ordered,
                lambda e, i: F.when((i == 0) | (e["token"] != F.get(ordered, i - 1)["token"]), i),
            )
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, j: F.struct(
                    (start - F.coalesce(F.get(s, j + 1), F.size(ordered))).alias("neg"),
                    F.get(ordered, start)["pos"].alias("pos"),
                    F.get(ordered, start)["token"].alias("token"),
                ),
            ),
        )

    return F.sort_array(let(F.sort_array(placed), runs))


def term_counts(token_array: Column) -> Column:
    """``array<struct<term:string, tf:bigint>>`` in order of the terms; null tokens are left out."""

    def runs(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)))
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, j: F.struct(
                    F.get(ordered, start).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(ordered)) - start).cast("long").alias("tf")
                ),
            ),
        )

    return let(F.sort_array(F.array_compact(token_array)), runs)


def keywords(token_array: Column, top_n: int = 10) -> Column:
    """The ``top_n`` most frequent tokens of one text, ties by first occurrence."""
    return F.transform(F.slice(token_counts(token_array), 1, top_n), lambda r: r["token"])


def _literal_map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def sentiment(cleaned: Column, lexicon: Mapping[str, tuple[float, float]] = DEFAULT_LEXICON) -> Column:
    """``struct<sentiment_score, subjectivity>``: means over the lexicon words of a text.

    For a lexicon too large for a literal use
    ``operators.enrich.sentiment_by_join``.
    """
    polarity = _literal_map({w: float(p) for w, (p, _) in lexicon.items()})
    subjectivity = _literal_map({w: float(s) for w, (_, s) in lexicon.items()})
    hits = F.filter(F.split(cleaned, "[^a-z]+"), lambda w: w.isin(*lexicon))

    def mean(found: Column, table: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda acc, w: acc + F.element_at(table, w))
        return F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.0))

    return let(
        hits,
        lambda h: F.struct(
            mean(h, polarity).alias("sentiment_score"), mean(h, subjectivity).alias("subjectivity")
        ),
    )


def _find(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def locations(text: Column) -> Column:
    """Distinct county, parish and borough names, sorted.

    Case is ignored, so the pattern "names, then a place word" takes in all
    words before the place. As one backtracking pattern it would be quadratic
    and deeply recursive on long texts. It is evaluated in two linear steps
    with the same result: cut out the runs of words, then keep each run up to
    its last place word.
    """
    found = [_find(text, _UNICODE_NOCASE + p) for p in LOCATION_PATTERNS]
    runs = F.filter(_find(text, _NAME_RUN, 0), lambda run: run.rlike(_UP_TO_PLACE))
    found.append(F.transform(runs, lambda run: F.regexp_extract(run, _UP_TO_PLACE, 1)))
    names = F.sort_array(F.array_distinct(F.concat(*found)))
    return F.when(text.rlike("(?i)" + _PLACE), names).otherwise(F.array().cast("array<string>"))


def measurements(text: Column) -> Column:
    """Distinct ``struct<value, unit>`` pairs, sorted."""
    pattern = _UNICODE_NOCASE + MEASUREMENT_PATTERN
    pairs = F.transform(
        _find(text, pattern, 0),
        lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("value"), F.regexp_extract(m, pattern, 2).alias("unit")
        ),
    )
    return F.sort_array(F.array_distinct(pairs))


def time_references(text: Column) -> Column:
    """Distinct clock times, time spans (``from-to``), dates and UTC times, sorted."""
    span = _UNICODE + FROM_TO_PATTERN
    spans = F.transform(
        _find(text, span, 0),
        lambda m: F.concat(F.regexp_extract(m, span, 1), F.lit("-"), F.regexp_extract(m, span, 2)),
    )
    single = [_find(text, _UNICODE + p) for p in (UNTIL_PATTERN, DATE_PATTERN, UTC_PATTERN)]
    return F.sort_array(F.array_distinct(F.concat(single[0], spans, *single[1:])))


def entities(text: Column) -> Column:
    """``struct<locations, measurements, time_references>`` of a raw text."""
    present = F.coalesce(text, F.lit(""))
    return F.struct(
        locations(present).alias("locations"),
        measurements(present).alias("measurements"),
        time_references(present).alias("time_references"),
    )


def text_metrics(text: Column, urgency_words: Sequence[str] = URGENCY_WORDS) -> dict[str, Column]:
    """The seven size and style measures of a raw text, by column name."""
    present = F.coalesce(text, F.lit(""))
    n_words = F.regexp_count(present, F.lit(_WORD))
    n_letters = F.length(F.regexp_replace(present, _UNICODE + r"[\s\x1c-\x1f]+", ""))
    lowered = F.lower(present)
    urgency = sum((lowered.contains(w).cast("long") for w in urgency_words), F.lit(0).cast("long"))
    return {
        "word_count": n_words.cast("long"),
        # One match per '.'-separated segment that is not blank.
        "sentence_count": F.regexp_count(present, F.lit(_UNICODE + r"[^.\s\x1c-\x1f][^.]*")).cast("long"),
        "avg_word_length": F.coalesce(F.try_divide(n_letters.cast("double"), n_words), F.lit(0.0)),
        "exclamation_count": F.regexp_count(present, F.lit("!")).cast("long"),
        "all_caps_count": F.regexp_count(present, F.lit(_UNICODE + r"\b[A-Z]{2,}+\b")).cast("long"),
        "urgency_keywords": urgency,
        "numeric_count": F.regexp_count(present, F.lit(_UNICODE + r"\b\d+\b")).cast("long"),
    }


def classify(
    title: Column,
    phrases: Mapping[str, Sequence[str]] = TYPE_PHRASES,
    default: str = "other",
    word_boundary: bool = False,
) -> Column:
    """Type of the first list with a phrase in the title; order matters.

    Phrases match anywhere ("ice" matches "notice"); ``word_boundary=True``
    asks for whole words instead.
    """

    def first_match(lowered: Column) -> Column:
        chain = None
        for name, options in phrases.items():
            if word_boundary:
                hit = lowered.rlike(rf"\b(?:{'|'.join(options)})\b")
            else:
                hit = reduce(or_, [lowered.contains(o) for o in options])
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return F.lit(default) if chain is None else chain.otherwise(default)

    return let(F.lower(F.coalesce(title, F.lit(""))), first_match)
