"""Importance resampling towards a target: hashed n-grams, log ratios and Gumbel draws.

Separators collapse to single spaces; then an overlapped scan with look-arounds at both
ends gives the span of every n-gram, whose bytes are hashed in place. Bucket counts of
the corpus and of the target give a gain per bucket; a document's weight is the mean
gain of its features. Adding Gumbel noise to the weights and taking the largest sums
draws without replacement, so no document is looked at twice.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.llm.common import release, stored

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Per cent of the eligible documents that are drawn.
SHARE = 10
#: Gains and noise are whole thousandths.
UNIT = 1000
FEATURES = "doc_id long, text_hash long, n_words long, n_features long, grams binary"
SCORED = "doc_id long, text_hash long, n_words long, n_features long, weight long, score long"


def _table() -> bytes:
    """Lowers A-Z and turns what stands between words into spaces, byte by byte."""
    word = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
    return bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in word else 0x20 for b in range(0x100))


TABLE = _table()
SPACES = regex.compile(rb"  +")


def gram_pattern(n: int) -> regex.Pattern:
    """``n`` words with single spaces between them, from the start of a word to the end of one."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def collapsed(text: str | None) -> bytes:
    """Lowered words with one space between them, as UTF-8."""
    return SPACES.sub(b" ", (text or "").encode().translate(TABLE)).strip(b" ")


def hashes(text: bytes, pattern: regex.Pattern) -> Iterator[int]:
    """CRC-32 of every n-gram; the spans overlap."""
    return (zlib.crc32(text[m.start() : m.end()]) for m in pattern.finditer(text, overlapped=True))


def features(docs: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words``, ``n_features`` and ``grams``, the bucket of each feature.

    ``grams`` holds unsigned little-endian numbers, of 16 bits where these suffice, else 32.
    """
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    patterns = [gram_pattern(n + 1) for n in range(ngrams)]

    def run(batches):
        for batch in batches:
            words, counts, grams = [], [], []
            for text in batch.column(2).to_pylist():
                plain = collapsed(text)
                found = [np.fromiter(hashes(plain, p), np.uint32) % buckets for p in patterns]
                words.append(len(found[0]))
                counts.append(sum(map(len, found)))
                grams.append(np.concatenate(found).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(grams, pa.binary())],
                ["doc_id", "text_hash", "n_words", "n_features", "grams"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, FEATURES)


def _flat(column: pa.BinaryArray, buckets: int) -> np.ndarray:
    """The buckets of all rows of a batch, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(grams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; every task sends its sums, at most one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    summed = grams.select("grams").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    # As many rows as buckets, whatever the input.
    for row in summed.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and corpus shares per bucket, rounded down."""
    buckets, all_own, all_target = len(own), float(own.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_own + buckets) / ((own + 1.0) * (all_target + buckets))
    return np.array([math.floor(UNIT * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel draw that follows from seed and id."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-UNIT * math.log(-math.log((int(drawn[:8], 16) + 0.5) / 4294967296)))


def scored(grams: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """Weight and score of every row of ``features``."""

    def run(batches):
        for batch in batches:
            n = batch.column(3).to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[_flat(batch.column(4), len(gain))])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(weight, pa.int64()), pa.array(score, pa.int64())],
                ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"],
            )

    return grams.mapInArrow(run, SCORED)


def ranked(rows: DataFrame, min_words: int = MIN_WORDS, share: int = SHARE) -> DataFrame:
    """Adds ``rank``: 1, 2, 3, … for the drawn rows by falling score, then rising id; null for the others.

    Scores are whole numbers whose range follows from logarithms, so their histogram is
    small however many rows there are. It gives the lowest drawn score; only rows from
    there on are shuffled, by score, which the noise spreads evenly.
    """
    eligible = rows.filter(F.col("n_words") >= min_words)
    sizes = eligible.groupBy("score").agg(F.count(F.lit(1)).alias("rows"))
    falling = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = sizes.select("score", F.coalesce(F.sum("rows").over(falling), F.lit(0)).alias("above"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    wanted = F.floor(F.col("all") * share / 100)
    above = stored(above.filter(F.col("above") < wanted).select("score", "above", wanted.alias("wanted")), "above")
    lowest = above.agg(F.min("score")).first()[0]
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    reaches = F.coalesce((F.col("n_words") >= min_words) & (F.col("score") >= lowest), F.lit(False))
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "text_hash"))
    placed = rows.filter(reaches).join(above, "score").withColumn("rank", F.col("above") + within)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")).cast("long"))
    return placed.select(*rows.columns, "rank").union(rows.filter(~reaches).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    share: int = SHARE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Words are runs of 0-9, a-z after A-Z are lowered, and characters beyond ASCII;
    features are all runs of up to ``ngrams`` words, repeats counted. Null text, and text
    without words, has no feature and weight 0. The noise of a row follows from its
    ``doc_id``, of a null id from an empty one; null ids come before all others in ties.
    Rows that repeat id and text are drawn one by one. Counts are taken over all rows of
    ``docs`` and ``target``, empty tables included. Other columns are not read.
    """
    grams = stored(features(docs, ngrams, buckets), "grams")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), ngrams, buckets)
    gain = gains(bucket_counts(grams, buckets), bucket_counts(wanted, buckets))
    rows = stored(scored(grams, gain, seed), "scored")
    release(grams)
    return ranked(rows, min_words, share)


def drawn(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``resample`` has drawn, with all their columns."""
    picked = rows.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    return docs.join(picked, docs["doc_id"].eqNullSafe(picked["_id"]) & (F.xxhash64(docs["text"]) == picked["text_hash"]), "left_semi")


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
