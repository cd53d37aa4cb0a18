"""Personal data in text: fixed patterns, and terms that disclose a protected entity.

An entity is the text of a pattern match. A term is a word outside all of them,
anywhere in a text with an entity. How much a term tells about an entity is their
pointwise mutual information over the corpus, as a share of the information of the
entity itself: 1 when the term occurs only where the entity does. A term at or above
``DISCLOSURE`` that shares ``SUPPORT`` or more different texts with the entity is a
span, to be generalised or removed, wherever it occurs, also in texts without the
entity. Column functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import digest, stored
from barograph.llm.spans import SPANS, count_of, find, joined, of_kind

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
SUPPORT = 2
TERM = r"\p{L}{4,}"
#: Terms that one broadcast holds.
BLOCK = 200_000
#: Stand for a separator within a number and a dot within a name; no pattern names them.
WITHIN, DOT = "\x01", "\x02"
#: Matches start where a run of such characters starts, or where the last match ended.
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+\x02-]))[A-Za-z0-9._%+\x02-]++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\x02[0-9]++\x02[0-9]++\x02[0-9]++"
CARD = r"[0-9][0-9\x01]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5))),
        F.lit(0).cast("long"),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind.

    One replacement marks the separators that stand between two digits and the dots
    that stand between two name characters, so the patterns need no nested
    repetition, whose stack would grow with the match. Places stay as they are.
    """
    none = F.array().cast(SPANS)
    plain = F.translate(text, WITHIN + DOT, "\x03\x03")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    numbers = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", WITHIN)
    ip = F.filter(find(dotted, IP), lambda x: x["hit"].rlike(f"^{PART}(?:\\x02{PART}){{3}}$"))
    card = F.filter(find(numbers, CARD), lambda x: F.length(_digits(x["hit"])).between(14, 19) & _luhn(_digits(x["hit"])))
    phone = F.filter(find(plain, PHONE), lambda x: F.length(_digits(x["hit"])).between(10, 15))
    return {
        "email": F.when(text.contains("@"), of_kind(find(dotted, EMAIL), "email", 0)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), of_kind(ip, "ip", 1)).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][0-9\x20-]{12}"), of_kind(card, "card", 2)).otherwise(none),
        "phone": F.when(text.contains("+"), of_kind(phone, "phone", 3)).otherwise(none),
    }


def _outside(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of ``spans``, so that places stay as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    whole = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _words(outside: str) -> Column:
    """The terms of a text in their order."""
    return F.transform(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def _meeting(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` whose term is among ``terms``, in blocks of terms small enough to send to every task."""
    blocks = max(1, math.ceil(terms.count() / BLOCK))
    met = None
    for b in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).select("term")
        part = rows.join(F.broadcast(some), "term")
        met = part if met is None else met.union(part)
    return met


def _places(outside: Column, numbers: str) -> Column:
    """Spans of the terms of a text whose ``numbers``, sorted, are given; one walk over its words."""
    pieces = F.arrays_zip(F.split(outside, TERM).alias("gap"), F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("number"), F.lit(0).alias("next"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        mine = F.coalesce(F.get(F.col(numbers), acc["next"]) == acc["number"], F.lit(False))
        one = F.struct(begin.alias("s"), F.lit(4).alias("o"), end.alias("e"), F.lit("term").alias("kind"))
        found = F.when(mine, F.concat(acc["found"], F.array(one))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (acc["number"] + 1).alias("number"), (acc["next"] + mine.cast("int")).alias("next"), found.alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def _most(texts: int, of_entity: str) -> Column:
    """No term of more texts than this reaches ``DISCLOSURE`` for an entity of ``of_entity`` texts.

    From the definition of the score, as they share ``of_entity`` texts at most. Allows for rounding.
    """
    return F.pow(F.col(of_entity).cast("double"), F.lit(DISCLOSURE)) * F.pow(F.lit(float(max(texts, 1))), F.lit(1 - DISCLOSURE)) * (1 + 1e-9)


def disclosing_terms(read: DataFrame, texts: int) -> DataFrame:
    """``(entity, term)`` pairs at or above the thresholds.

    ``read`` has text, its mark and spans, and the text outside them; ``texts`` is
    the number of different texts. Copies of a text count once in all four figures,
    and term counts cover all documents. Before entities meet terms, those are left
    out of which the counts show that no pair can reach the thresholds.
    """
    held = stored(
        read.filter(F.size("_base") > 0)
        .select("mark", F.array_distinct(F.transform("_base", lambda x: F.lower(F.substring(F.col("text"), x["s"] + 1, x["e"] - x["s"])))).alias("entities"), F.array_distinct(_words("_outside")).alias("terms"))
        .dropDuplicates(["mark"]),
        "held",
    )
    entity_of = held.select("mark", F.explode("entities").alias("entity"))
    entities = stored(entity_of.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")).filter((F.col("of_entity") >= SUPPORT) & (F.col("of_entity") < texts)), "entities")
    known = stored(entity_of.join(entities, "entity"), "known")
    # The most frequent entity of a text allows the most frequent terms.
    best = known.groupBy("mark").agg(F.max("of_entity").alias("best"))
    seen = held.join(best, "mark").select("mark", "best", F.explode("terms").alias("term"))
    candidates = seen.groupBy("term").agg(F.count(F.lit(1)).alias("beside"), F.max("best").alias("best"))
    candidates = stored(candidates.filter((F.col("beside") >= SUPPORT) & (F.col("beside") <= _most(texts, "best"))), "candidates")
    listed = read.select("mark", F.explode_outer(F.array_distinct(_words("_outside"))).alias("term"))
    of_term = _meeting(listed, candidates).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    rare = stored(candidates.join(of_term, "term").filter(F.col("of_term") <= _most(texts, "best")).select("term", "of_term"), "rare")
    term_of = seen.select("mark", "term").join(rare, "term")
    together = known.join(term_of, "mark").filter(F.col("of_term") <= _most(texts, "of_entity"))
    pairs = together.groupBy("entity", "term", "of_entity", "of_term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= SUPPORT)
    total = F.lit(float(max(texts, 1)))
    shared = F.log2(total * F.col("both") / (F.col("of_term") * F.col("of_entity")))
    own = F.log2(total / F.col("of_entity"))
    return pairs.filter((own > 0) & (shared >= DISCLOSURE * own)).select("entity", "term")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Adds ``private``, an array of ``(s, o, e, kind)`` by start, to ``docs``.

    Places are code points, ends exclusive. Kinds: ``email``, ``ip``, ``card`` and
    ``phone`` by pattern, ``term`` for every occurrence of a disclosing word outside
    these. Null and empty texts have no spans. Rows of equal ``doc_id`` and text have
    the same spans. Extra columns stay; one named ``private`` is replaced, and names
    starting with ``_`` are reserved.
    """
    docs = docs.drop("private")
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64("text")
    read = (
        docs.filter("text is not null")
        .select("doc_id", "text", mark.alias("mark"), F.concat(*base_spans(text).values()).alias("_base"))
        .withColumn("_outside", _outside(F.col("text"), F.col("_base")))
    )
    texts = docs.filter("text is not null").select(mark.alias("mark")).distinct().count()
    telling = stored(disclosing_terms(read, texts).select("term").distinct(), "telling")
    listed = read.select("doc_id", "mark", F.posexplode_outer(_words("_outside")).alias("number", "term"))
    terms = _meeting(listed, telling).groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_set("number")).alias("_terms"))
    found = docs.select("*", F.concat(*base_spans(text).values()).alias("_base"), mark.alias("_own"))
    joined_docs = found.join(terms, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_mark")), "left")
    spans = F.when(F.size("_terms") > 0, _places(_outside(text, F.col("_base")), "_terms")).otherwise(F.array().cast(SPANS))
    return joined_docs.select(*[docs[c] for c in docs.columns], F.array_sort(F.concat("_base", spans)).alias("private"))


def query(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs.select("doc_id", "text"))
    base = F.filter("private", lambda x: x["o"] < 4)
    counts = [count_of("private", kind).alias(f"n_{kind}") for kind in KINDS[:4]]
    return found.select("doc_id", *counts, digest(joined(base)).alias("base_sha256"), joined(F.col("private")).alias("spans"))
