"""Places of pattern matches in texts, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<s:int,e:int,hit:string,part:string>>"


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern``, leftmost and not overlapping: start and end in code points, match, group.

    The pieces between matches and the matches themselves, in turn, give the places;
    either comes from one pass over the text.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(begin.alias("s"), end.alias("e"), x["hit"].alias("hit"), x["part"].alias("part"))
        found = F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one)))
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def of_kind(found: Column, kind: str, order: int) -> Column:
    """Spans as ``(s, kind_order, e, kind)``."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))


SPANS = "array<struct<s:int,o:int,e:int,kind:string>>"


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    parts = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(parts, ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first replaces all."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        label = F.when(x["s"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.concat(acc["out"], gap, label).alias("out"))

    whole = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
