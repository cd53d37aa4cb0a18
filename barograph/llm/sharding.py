"""Shards of nearly equal bytes from indivisible groups, by differencing.

Differencing keeps *partial partitions*: a list of piles, one per shard. It takes
the two whose piles differ most and adds them up in opposite order, the largest
pile of one onto the smallest of the other, until one is left. Here it runs on
two levels: tasks difference the groups of one chunk each, and the partial
partitions of all chunks are differenced in turn. Chunks are of bounded size, and
of a chunk only its few pile sizes travel on, in as many levels as it takes.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import numbered, shuffle_partitions, stored

#: Groups, or partial partitions, that one task differences: at most, and at least if there are as many.
CHUNK = 20_000
LEAST = 256


def difference(piles: np.ndarray) -> np.ndarray:
    """Place of every pile: ``piles`` has a row of pile sizes per partial partition.

    Returns the shard of each pile. Ties are settled by the order of the rows.
    """
    n, k = piles.shape
    counter = itertools.count()
    # Per partial partition: sizes in descending order and the members of each pile as a chain.
    follow = np.full(n * k, -1, np.int64)
    heap = []
    for i in range(n):
        order = np.argsort(-piles[i], kind="stable")
        sizes = [int(piles[i][j]) for j in order]
        heads = [i * k + int(j) for j in order]
        heap.append((sizes[-1] - sizes[0], next(counter), sizes, heads, list(heads)))
    heapq.heapify(heap)
    follow = follow.tolist()
    while len(heap) > 1:
        _, _, a, a_head, a_tail = heapq.heappop(heap)
        _, _, b, b_head, b_tail = heapq.heappop(heap)
        merged = []
        for j in range(k):
            o = k - 1 - j
            follow[a_tail[j]] = b_head[o]
            merged.append((a[j] + b[o], a_head[j], b_tail[o]))
        merged.sort(key=lambda x: -x[0])
        sizes = [x[0] for x in merged]
        heapq.heappush(heap, (sizes[-1] - sizes[0], next(counter), sizes, [x[1] for x in merged], [x[2] for x in merged]))
    shard = np.empty(n * k, np.int64)
    if heap:
        for s, head in enumerate(heap[0][3]):
            while head >= 0:
                shard[head] = s
                head = follow[head]
    return shard.reshape(n, k)


def _difference_chunks(rows: DataFrame, shards: int, chunks: int) -> DataFrame:
    """One level: ``(key, piles)`` to ``(key, chunk, places, sums)`` with the place of each pile in its chunk."""
    marked = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("long"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable").reset_index(drop=True)
        piles = np.stack(part["piles"].to_numpy()).astype(np.int64)
        places = difference(piles)
        sums = np.zeros(shards, np.int64)
        np.add.at(sums, places.ravel(), piles.ravel())
        out = part[["key", "chunk"]].copy()
        out["places"] = list(places.astype(np.int32))
        out["sums"] = [sums if i == 0 else None for i in range(len(part))]
        return out

    return marked.groupBy("chunk").applyInPandas(solve, "key binary, chunk long, places array<int>, sums array<long>")


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Assign each document to one of ``shards``, byte totals as equal as differencing makes them.

    Adds ``size`` (UTF-8 bytes of the text, plus 1), ``shard`` and ``slot`` (gapless
    from 0 within the shard) to all columns of ``docs``. Documents of equal text
    are one indivisible group; null counts as the empty text. A group above the
    mean of a shard gets one to itself as far as sizes allow. Rows that repeat a
    ``doc_id`` are rows like any other. Extra columns stay; one named like a new
    column is replaced, and names starting with ``_`` are reserved.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn(
        "_key", F.unhex(F.sha2(text.cast("binary"), 256))
    )
    groups = marked.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("total"))
    zeros = F.array(*[F.lit(0).cast("long")] * (shards - 1))
    level = stored(groups.select("key", F.concat(F.array("total"), zeros).alias("piles")), "piles")
    links, count = [], level.count()
    while True:
        chunks = max(math.ceil(count / CHUNK), min(shuffle_partitions(spark), math.ceil(count / LEAST)), 1)
        solved = stored(_difference_chunks(level, shards, chunks), "differenced")
        links.append(solved.select("key", "chunk", "places"))
        if chunks == 1:
            break
        # A chunk is one partial partition of the next level.
        level = solved.filter("sums is not null").select(
            F.unhex(F.lpad(F.hex("chunk"), 16, "0")).alias("key"), F.col("sums").alias("piles")
        )
        count = chunks
    place = links[0].select(F.col("key").alias("_key"), "chunk", F.element_at("places", 1).alias("place"))
    for upper in links[1:]:
        upper = upper.select(F.col("key").alias("_upper"), F.col("chunk").alias("_chunk"), F.col("places").alias("_places"))
        here = F.unhex(F.lpad(F.hex("chunk"), 16, "0"))
        place = place.join(upper, here == F.col("_upper")).select(
            "_key", F.col("_chunk").alias("chunk"), F.element_at("_places", F.col("place") + 1).alias("place")
        )
    placed = marked.join(place.select("_key", F.col("place").alias("shard")), "_key").drop("_key")
    return numbered(placed, ["shard"], ["doc_id", "size"], "slot")


def query(docs: DataFrame) -> DataFrame:
    small = docs.select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # The checksum is taken before the shuffle, so texts stay where they are.
    slim = small.select("doc_id", "text", crc.alias("text_crc32"))
    out = shard_by_bytes(slim)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
