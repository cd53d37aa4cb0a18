"""Benchmark passages in documents: a prefix-filtered join of shingles, column functions only.

Every window of an item is a set of shingles, ordered by how rare they are in the
documents. A window can only occur where its rarest shingle does, so that one
shingle is its necessary prefix; a window with a shingle that no document has is
dropped. Where a document has the prefix shingle, the window must begin a fixed
number of words before and fit into the document. What passes these bounds is
compared word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import digest, stored

WINDOW = 10
SHINGLE = 5
#: What stands between words, after A-Z are lowered and before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingles that one broadcast holds, 16 bytes each and overhead.
BLOCK = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _row_key(docs: DataFrame) -> Column:
    """Rows of equal id and text are alike."""
    return F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, w)``: the windows of each item as arrays of words; a shorter item is one window."""
    listed = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = F.sequence(F.lit(0), last)
    return listed.select("item_id", F.explode(starts).alias("i"), "words").select("item_id", F.slice("words", F.col("i") + 1, window).alias("w")).distinct()


def _matches(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """Places in documents that have one of the shingles; no text travels with a place."""
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    listed = docs.select(_row_key(docs).alias("key"), hashes.alias("words"))

    def hashed(size: int) -> Column:
        # Shifted copies of the list side by side: each place is hashed in constant time.
        shifted = F.arrays_zip(*[F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(size)])
        combined = F.transform(shifted, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(size)]))
        return F.slice(combined, 1, F.greatest(F.size("words") - (size - 1), F.lit(0)))

    out = None
    for size in sizes:
        # The outer form, as the other makes the optimizer test every list before it is built.
        places = listed.select("key", F.size("words").alias("n"), hashed(size).alias("hashes")).select("key", "n", F.posexplode_outer("hashes").alias("p", "h"))
        met = places.join(F.broadcast(shingles.filter(F.col("size") == size).select("h")), "h")
        met = met.select("key", F.lit(size).alias("size"), "h", "p", "n")
        out = met if out is None else out.union(met)
    return out


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(key, start, m, w)`` of every window in every document, and the windows ``(item_id, w)``."""
    windows = stored(item_windows(items, window), "windows")
    distinct = windows.select("w").distinct().withColumn("m", F.size("w"))
    size = F.least(F.col("m"), F.lit(SHINGLE))
    at = F.sequence(F.lit(0), F.col("m") - F.col("size"))
    shingled = distinct.withColumn("size", size).withColumn("offset", F.explode(at))
    parts = [F.when(F.col("size") > i, F.xxhash64(F.col("w")[F.col("offset") + i])) for i in range(SHINGLE)]
    shingled = stored(shingled.withColumn("h", F.xxhash64(*parts)), "shingles")
    wanted = shingled.select("h", "size").distinct()
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())
    blocks = max(1, math.ceil(wanted.count() / BLOCK))
    met = None
    for b in range(blocks):
        part = _matches(docs, wanted.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b), sizes) if sizes else None
        met = part if met is None else met.union(part)
    if met is None:
        empty = docs.select(_row_key(docs).alias("key"), F.lit(0).alias("start")).limit(0)
        return empty.crossJoin(windows.select(F.size("w").alias("m"), "w").limit(0)), windows
    met = stored(met, "matches")
    rarity = met.groupBy("h", "size").agg(F.count(F.lit(1)).alias("often"))
    ranked = shingled.join(rarity, ["h", "size"], "left").groupBy("w", "m").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "h", "size")).alias("rarest")
    )
    prefix = ranked.filter("rarest.often > 0").select("w", "m", "rarest.offset", "rarest.h", "rarest.size")
    start = F.col("p") - F.col("offset")
    joined = met.join(prefix, ["h", "size"]).withColumn("start", start)
    fits = joined.filter("start >= 0 and start + m <= n").select("key", "start", "m", "w").distinct()
    # Only documents with a place that passed the bounds meet their words again.
    lists = fits.groupBy("key").agg(F.collect_list(F.struct("start", "m", "w")).alias("places"))
    texts = docs.select(_row_key(docs).alias("key"), "text").join(lists, "key").dropDuplicates(["key"])
    checked = texts.select("key", words_of(F.col("text")).alias("words"), "places").select("key", "words", F.explode_outer("places").alias("x"))
    return checked.filter("slice(words, x.start + 1, x.m) = x.w").select("key", "x.*"), windows


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted as text) and ``contaminated`` to ``docs``.

    Words are runs of 0-9, a-z after A-Z are lowered, and characters beyond ASCII.
    A word is hit when an occurrence of a window of any item covers it. Items or
    documents without words (null, empty) match nothing. Rows of equal ``doc_id`` and
    text are alike; items that share an ``item_id`` are one. A null ``item_id`` is
    ignored. Extra columns stay; one named like a new column is replaced, and names
    starting with ``_`` are reserved.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    found, windows = occurrences(docs, items.filter("item_id is not null"), window)
    found = stored(found, "occurrences")
    covered = found.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("p")).distinct()
    hits = covered.groupBy("key").agg(F.count(F.lit(1)).alias("_hit"))
    named = found.select("key", "w").distinct().join(windows, "w").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    lists = named.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    known = hits.join(lists, "key").withColumnRenamed("key", "_key")
    keyed = docs.withColumn("_own", _row_key(docs)).withColumn(
        "n_words", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN_ANY_CASE), "")).cast("long")
    )
    return keyed.join(known, F.col("_own").eqNullSafe(F.col("_key")), "left").select(
        *docs.columns,
        "n_words",
        F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        F.col("_hit").isNotNull().alias("contaminated"),
    )


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    done = contamination(docs.select("doc_id", "text"), items)
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated"
    )
