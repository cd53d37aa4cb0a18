"""Find windows that occur elsewhere: anchors route equal windows to the same shard.

Every window of ``length`` symbols is represented by its anchor, the run of
``gram`` symbols within it whose hash is least (the leftmost of equals). Equal
windows have equal anchors at equal places, so only windows around anchors that
occur more than once can repeat. Windows with one anchor are consecutive and form
a *segment* of at most ``2 * length - gram`` symbols:

1. anchor hashes are counted; a hash that occurs once needs no further work;
2. segments of shared anchors are grouped by content. Copies of a segment are
   covered by its first occurrence at once, however many there are;
3. distinct segments that share an anchor (*variants*) differ somewhere. They go
   to shards of bounded size, where the caller's solver finds which of their
   windows occur earlier;
4. an anchor with more than ``VARIANTS`` variants, such as one inside a line that
   a third of all documents hold, would not fit a shard's share. Its variants are
   cut into *parts*, the windows whose anchor stands at one of ``WIDTHS`` places.
   Equal windows lie in parts that agree in the symbols all windows of such a part
   hold, so parts meet by these alone. Equal parts are covered by their first at
   once; the others go to shards, or, where still too many, are cut again, at last
   to single windows, which are equal if they meet.

Anchors, variants and parts that hold a thousandth of all rows or more meet by a
broadcast; there are fewer than a thousand of them, whatever the input.

Symbols are bytes or hashes of words; a unit object says how a text becomes
symbols. Texts are processed whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm import textbytes
from barograph.llm.common import release, shuffle_partitions, stored

#: Variants of one anchor that a shard takes.
VARIANTS = 200
#: Places of the anchor that one part covers, cut after cut.
WIDTHS = (16, 4, 1)
#: Keys with more than this share of a table's rows are broadcast.
HOT_SHARE = 1e-3
CHUNK = 1 << 20
PLACE_BITS = np.uint64(24)
KEY = ["h", "sh", "off", "len"]


class Bytes:
    """Symbols are the bytes of the UTF-8 text."""

    width = 1

    @staticmethod
    def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return textbytes.letters(False)[data], offsets

    @staticmethod
    def content(data: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return data


class Words:
    """Symbols are hashes of the words of the text."""

    width = 8

    @staticmethod
    def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, hashes, owner, _ = textbytes.words(data, offsets, fold=False)
        return hashes, owner

    @staticmethod
    def content(data: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return symbols


def anchor_runs(symbols: np.ndarray, owner: np.ndarray, length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Segments of all texts: ``text``, ``h``, ``sh``, ``off``, ``len`` and ``lo`` (place in its text).

    ``owner`` has the first symbol of each text and the number of symbols.
    """
    mask = np.uint64((1 << int(PLACE_BITS)) - 1)
    for first in range(0, max(len(symbols) - length + 1, 0), CHUNK):
        last = min(first + CHUNK, len(symbols) - length + 1)
        total = textbytes.prefix_sums(symbols[first : last + length - 1])
        starts = np.arange(len(total) - gram)
        hashes = textbytes.range_hash(total, starts, starts + gram)
        least = textbytes.sliding_min((hashes & ~mask) | starts.astype(np.uint64), length - gram + 1)
        anchor = (least & mask).astype(np.int64)
        text = np.searchsorted(owner, np.arange(first, last), "right") - 1
        valid = np.arange(first, last) + length <= owner[text + 1]
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        change |= ~valid
        begins = np.flatnonzero(change)
        ends = np.append(begins[1:], len(anchor))
        keep = valid[begins]
        lo, hi = begins[keep], ends[keep] - 1
        at = anchor[lo]
        yield {
            "text": text[lo],
            "h": hashes[at].view(np.int64),
            "sh": textbytes.range_hash(total, lo, hi + length).view(np.int64),
            "off": (at - lo).astype(np.int32),
            "len": (hi + length - lo).astype(np.int32),
            "lo": lo + first - owner[text[lo]],
        }


def _parts(batch: pa.RecordBatch, unit) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = textbytes.flat(batch.column(batch.schema.get_field_index("text")))
    for a, b in textbytes.slices(offsets, CHUNK):
        part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        symbols, owner = unit.symbols(part, inner)
        yield a, b, part, symbols, owner


def _segments(docs: DataFrame, unit, length: int, gram: int) -> DataFrame:
    """``(h, doc_id)`` of every anchor."""

    def find(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for a, _, _, symbols, owner in _parts(batch, unit):
                for runs in anchor_runs(symbols, owner, length, gram):
                    yield pa.RecordBatch.from_pydict({"h": runs["h"], "doc_id": ids[a + runs["text"]]})

    return docs.mapInArrow(find, "h long, doc_id long")


def _shared_segments(marked: DataFrame, unit, length: int, gram: int) -> DataFrame:
    """Segments whose anchor is among the shared ones of their document (column ``hs``)."""

    def find(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            lists = batch.column(batch.schema.get_field_index("hs"))
            flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            for a, b, _, symbols, owner in _parts(batch, unit):
                # Anchors of each text and the shared ones meet under one key.
                spread = textbytes.mix(np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1])).astype(np.uint64))
                shared = flat[bounds[a] : bounds[b]].view(np.uint64) ^ spread
                for runs in anchor_runs(symbols, owner, length, gram):
                    keys = runs["h"].view(np.uint64) ^ textbytes.mix((a + runs["text"]).astype(np.uint64))
                    keep = np.isin(keys, shared)
                    rows = {c: runs[c][keep] for c in (*KEY, "lo")}
                    yield pa.RecordBatch.from_pydict({**rows, "doc_id": ids[a + runs["text"][keep]]})

    return marked.select("doc_id", "text", "hs").mapInArrow(find, "h long, sh long, off int, len int, lo long, doc_id long")


def _contents(wanted: DataFrame, unit) -> DataFrame:
    """Contents of the segments listed per document in ``segments``."""

    def cut(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            lists = batch.column(batch.schema.get_field_index("segments"))
            rows, bounds = lists.flatten(), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            fields = {c: rows.field(c).to_numpy() for c in (*KEY, "lo")}
            for a, b, part, symbols, owner in _parts(batch, unit):
                mine = slice(bounds[a], bounds[b])
                text = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                content = unit.content(part, symbols)
                start = owner[text] + fields["lo"][mine]
                end = start + fields["len"][mine]
                raw = content.tobytes()
                w = unit.width
                cuts = pa.array([raw[w * s : w * e] for s, e in zip(start.tolist(), end.tolist())], pa.binary())
                columns = {c: pa.array(fields[c][mine]) for c in (*KEY, "lo")}
                yield pa.RecordBatch.from_pydict({**columns, "doc_id": ids[a + text], "content": cuts})

    schema = "h long, sh long, off int, len int, lo long, doc_id long, content binary"
    return wanted.select("doc_id", "text", "segments").mapInArrow(cut, schema)


def place_ranges(
    anchor: np.ndarray, sizes: np.ndarray, length: int, gram: int, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, least and greatest place of each range of ``width`` places that the anchor takes in a part's windows."""
    # It stands furthest right in the first window.
    least = (anchor - (sizes - length)) // width
    many = anchor // width - least + 1
    row = np.repeat(np.arange(len(sizes)), many)
    low = (least[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * width
    return row, low, np.minimum(low + width - 1, length - gram)


def may_share(contents: list[bytes], anchor: np.ndarray, length: int, gram: int, size: int) -> np.ndarray:
    """Which parts agree with another one in what all windows of half the places hold; others share no window."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents)) // size
    raw = b"".join(contents)
    symbols = textbytes.letters(False)[np.frombuffer(raw, np.uint8)] if size == 1 else np.frombuffer(raw, np.uint64)
    row, low, high = place_ranges(anchor, sizes, length, gram, -(-(length - gram + 1) // 2))
    at = (np.cumsum(sizes) - sizes + anchor)[row]
    held = textbytes.range_hash(textbytes.prefix_sums(symbols), at - low, at - high + length)
    _, which, times = np.unique(textbytes.mix(held + low.astype(np.uint64)), return_inverse=True, return_counts=True)
    out = np.zeros(len(contents), bool)
    out[row[times[which] > 1]] = True
    return out


def _parts_of(parts: DataFrame, length: int, gram: int, size: int, width: int) -> DataFrame:
    """Parts of ``parts`` whose windows have their anchor at one of ``width`` places.

    Adds ``at`` (anchor in the part), ``n`` (symbols) and ``c`` (hash of them); ``g``
    becomes the hash of what all windows of such a part have in common.
    """

    def cut(batches):
        for batch in batches:
            get = {c: batch.column(batch.schema.get_field_index(c)) for c in (*KEY, "rel", "lo", "doc_id", "content")}
            pieces = get.pop("content").to_pylist()
            get = {c: v.to_numpy() for c, v in get.items()}
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // size
            raw = b"".join(pieces)
            symbols = textbytes.letters(False)[np.frombuffer(raw, np.uint8)] if size == 1 else np.frombuffer(raw, np.uint64)
            first = np.cumsum(sizes) - sizes
            anchor = get["off"].astype(np.int64) - get["rel"]
            row, low, high = place_ranges(anchor, sizes, length, gram, width)
            at = np.minimum(high, anchor[row])
            start = anchor[row] - at
            end = np.minimum(anchor[row] - low + length, sizes[row])
            total, base = textbytes.prefix_sums(symbols), first[row]
            shared = textbytes.range_hash(total, base + anchor[row] - low, base + anchor[row] - high + length)
            content = textbytes.range_hash(total, base + start, base + end)
            columns = {c: get[c][row] for c in (*KEY, "doc_id")}
            yield pa.RecordBatch.from_pydict(
                {
                    **columns,
                    "rel": (get["rel"][row] + start).astype(np.int32),
                    "lo": get["lo"][row] + start,
                    "g": textbytes.mix(shared + low.astype(np.uint64)).view(np.int64),
                    "at": at.astype(np.int32),
                    "n": (end - start).astype(np.int32),
                    "c": content.view(np.int64),
                    "content": pa.array(
                        [raw[size * i : size * j] for i, j in zip((base + start).tolist(), (base + end).tolist())], pa.binary()
                    ),
                }
            )

    schema = "h long, sh long, off int, len int, doc_id long, rel int, lo long, g long, at int, n int, c long, content binary"
    return parts.mapInArrow(cut, schema)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """``left`` and ``right`` joined on ``keys``, where ``right`` has a row per key and its ``rows`` in ``left``.

    Keys above ``HOT_SHARE`` of these rows, by their sum fewer than its inverse, are
    broadcast and so stay where they are; only the others are shuffled.
    """
    limit = (right.agg(F.sum(rows)).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(right.filter(F.col(rows) > limit))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col(rows) <= limit), keys)
    return rest.unionByName(left.join(hot, keys))


def covered_runs(flags: np.ndarray, rows: np.ndarray, rel: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal ranges that flagged windows cover; input sorted by row, then place."""
    rows, rel = rows[flags], rel[flags]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (rel[1:] > rel[:-1] + length)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(rows))[: len(begin)] - 1
    return rows[begin], rel[begin], rel[end] + length


Solver = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def repeated_ranges(
    docs: DataFrame, unit, length: int, gram: int, solve: Solver, across: bool, shard_symbols: int
) -> DataFrame:
    """``(doc_id, ranges)``: symbol ranges of each document covered by windows that also occur earlier.

    Earlier means in a document with a smaller id, or, unless ``across``, at a
    smaller place of the same document. Documents without such windows have no
    row. ``solve(contents, doc_ids, starts)`` gets the variants of one shard and
    returns row, start and end of the covered ranges of each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    anchors = stored(_segments(texts, unit, length, gram), "anchors")
    seen = [F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")]
    counted = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *(seen if across else []))
    shared = stored(counted.filter("least < greatest" if across else "n > 1").select("h", "n"), "shared")
    per_doc = spread_join(anchors, shared, ["h"], "n").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    marked = stored(texts.join(per_doc, "doc_id"), "marked")
    release(anchors, shared)
    segments = stored(_shared_segments(marked, unit, length, gram), "segments")

    first = F.min(F.struct("doc_id", "lo")).alias("first")
    groups = stored(segments.groupBy(*KEY).agg(first, F.count(F.lit(1)).alias("n")), "variants")
    variants = groups.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    variants = stored(variants, "anchor_variants")
    several = spread_join(groups.select(*KEY, "first.*"), variants, ["h"], "variants").drop("variants")
    # The list of one document is at most as long as its text.
    lists = several.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY, "lo")).alias("segments"))
    contents = stored(_contents(marked.select("doc_id", "text").dropDuplicates(["doc_id"]).join(lists, "doc_id"), unit), "contents")
    release(marked)
    steps = [variants, contents]
    parts = contents.select("*", F.lit(0).alias("rel"), F.col("h").alias("g"))
    sizes, solvable, behind = variants.withColumnRenamed("h", "g"), [], []
    for width in WIDTHS:
        solvable.append(spread_join(parts, sizes.filter(F.col("variants").between(2, VARIANTS)), ["g"], "variants"))
        crowded = sizes.filter(F.col("variants") > VARIANTS)
        if crowded.isEmpty():
            break
        parts = stored(_parts_of(spread_join(parts, crowded, ["g"], "variants"), length, gram, unit.width, width), "parts")
        same, here = ["g", "at", "n", "c"], F.struct("doc_id", "lo")
        earliest = stored(parts.groupBy(*same).agg(F.min(here).alias("earliest"), F.count(F.lit(1)).alias("rows")), "earliest")
        later = F.col("earliest.doc_id") < F.col("doc_id") if across else F.col("earliest") < here
        told = stored(spread_join(parts, earliest, same, "rows").withColumn("later", later).drop("earliest", "rows"), "told")
        release(parts, earliest)
        behind.append(told.filter("later").select(*KEY, F.col("rel").alias("s"), (F.col("rel") + F.col("n")).alias("e")))
        parts = told.filter("not later").select(*KEY, "doc_id", "rel", "lo", "g", "content")
        sizes = stored(parts.groupBy("g").agg(F.count(F.lit(1)).alias("variants")), "part_variants")
        steps += [told, sizes]
    # Single windows that meet are equal: none is left to compare.
    columns = [*KEY, "doc_id", "rel", "lo", "g", "content"]
    wanted = functools.reduce(DataFrame.union, [x.select(*columns) for x in solvable])
    size = (wanted.agg(F.sum(F.length("content"))).first()[0] or 0) // unit.width
    shards = max(math.ceil(size / shard_symbols), shuffle_partitions(spark))
    ranges_type = "array<struct<s:int,e:int>>"

    out = pa.schema([("h", pa.int64()), ("sh", pa.int64()), *((c, pa.int32()) for c in ("off", "len", "s", "e"))])

    def solve_shard(table: pa.Table) -> pa.Table:
        anchor = table.column("off").to_numpy().astype(np.int64) - table.column("rel").to_numpy()
        table = table.filter(pa.array(may_share(table.column("content").to_pylist(), anchor, length, gram, unit.width)))
        if not table.num_rows:
            return out.empty_table()
        table = table.sort_by([("doc_id", "ascending"), ("lo", "ascending"), ("h", "ascending")])
        rows, start, end = solve(
            table.column("content").to_pylist(), table.column("doc_id").to_numpy(), table.column("lo").to_numpy()
        )
        at = pa.array(rows)
        columns = {c: table.column(c).combine_chunks().take(at) for c in KEY}
        rel = table.column("rel").to_numpy()[rows]
        return pa.table({**columns, "s": (rel + start).astype(np.int32), "e": (rel + end).astype(np.int32)})

    solved = (
        wanted.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(solve_shard, "h long, sh long, off int, len int, s int, e int")
    )
    covered = functools.reduce(DataFrame.union, behind, solved)
    partial = covered.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).cast(ranges_type).alias("part"))
    partial = stored(partial, "partial")
    release(*steps)
    known = stored(groups.join(partial, KEY, "left").filter("n > 1 or part is not null"), "known")
    release(groups, partial)
    is_first = (F.col("first.doc_id") == F.col("doc_id")) if across else (F.col("first") == F.struct("doc_id", "lo"))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("len").alias("e"))).cast(ranges_type)
    ranges = F.when(is_first, F.coalesce("part", F.array().cast(ranges_type))).otherwise(whole)
    moved = F.transform(ranges, lambda x: F.struct((x["s"] + F.col("lo")).alias("s"), (x["e"] + F.col("lo")).alias("e")))
    ranges = stored(
        spread_join(segments, known, KEY, "n")
        .select("doc_id", F.explode(moved).alias("range"))
        .groupBy("doc_id")
        .agg(F.collect_list("range").alias("ranges")),
        "ranges",
    )
    release(segments, known)
    return ranges


def merged(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a union of ranges within ``size`` symbols; ranges that touch become one."""
    start, end = np.clip(start, 0, size), np.clip(end, 0, size)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start))[: len(begin)] - 1
    return start[begin], end[last]
