"""Near-duplicate documents: tensored MinHash banding with verified candidates.

Two collections of ``GROUP`` hashes are computed per document, each the
concatenation of ``ROWS`` minima. Table keys are all pairs of one hash of the first
collection and one of the second: ``GROUP ** 2`` tables of ``2 * ROWS`` rows from
``2 * GROUP * ROWS`` minima instead of ``2 * GROUP ** 2 * ROWS``. Documents of
Jaccard similarity ``s`` meet in a table with probability
``(1 - (1 - s ** ROWS) ** GROUP) ** 2``, 0.9997 at 0.8.

Documents of one table key are compared with one of them, the hub, not with each
other. Where that leaves a key in several components, another hub is tried, and in
the end all pairs of different components that still share a key, each in one table
only, and can be similar at all: a bitmap of each set shows how many members of one the other lacks at
least, which bounds the intersection from above before any text is read.
Copies (equal sets) are one class throughout, so the work follows the number of
different texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm import textbytes
from barograph.llm.common import lean, release, stored
from barograph.llm.components import components

ROWS = 2
GROUP = 9
#: Rounds of one hub per key before all remaining pairs.
HUBS = 2
#: Longs of the bitmap of a set.
BITMAP = 16
CHUNK = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of all texts, and the first of each text.

    Words are runs of anything but white space, A-Z in lower case. A text of fewer
    words is one shingle if ``tail``, and has none otherwise; without words, none.
    """
    _, _, words, owner, _ = textbytes.words(data, offsets, fold=True)
    counts = np.diff(owner)
    total = textbytes.prefix_sums(words)
    if tail:
        many = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    else:
        many = np.maximum(counts - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(counts)), many)
    start = owner[text] + np.arange(len(text)) - bounds[text]
    end = np.minimum(start + n, owner[text + 1])
    return textbytes.range_hash(total, start, end), bounds


def _minima(hashes: np.ndarray, bounds: np.ndarray, number: int) -> np.ndarray:
    """``number`` MinHash values of every text that has shingles."""
    has = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, number), np.uint64)
    if len(has):
        seeds = textbytes.mix(np.arange(1, 2 * number + 1, dtype=np.uint64))
        for k in range(number):
            x = (hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[has, k] = np.minimum.reduceat(x, bounds[has])
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(pa.int64()))


def _sketch(n: int, tail: bool, rows: int, group: int):
    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets = textbytes.flat(batch.column(1))
            for a, b in textbytes.slices(offsets, CHUNK):
                hashes, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, tail)
                minima = _minima(hashes, bounds, 2 * group * rows).reshape(b - a, 2 * group, rows)
                keys = np.zeros((b - a, 2 * group), np.uint64)
                for r in range(rows):
                    keys = textbytes.mix(keys * np.uint64(textbytes.BASE) + minima[:, :, r])
                sizes, marks = np.zeros(b - a, np.int64), np.zeros((b - a, 2), np.uint64)
                bitmaps = np.zeros((b - a, 64 * BITMAP), np.uint8)
                for i in range(b - a):
                    if bounds[i + 1] > bounds[i]:
                        own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                        sizes[i] = len(own)
                        bitmaps[i, own & np.uint64(64 * BITMAP - 1)] = 1
                        # The set itself, as two sums over its members.
                        marks[i] = own.sum(), (own * (own >> np.uint64(1) | np.uint64(1))).sum()
                marks = marks.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]), _lists(keys), _lists(np.packbits(bitmaps, axis=1).view(np.uint64))],
                    ["doc_id", "n", "k1", "k2", "hashes", "bitmap"],
                )

    return sketch


def _verify(n: int, tail: bool, percent: int):
    """Keep the pairs whose sets have 100 * intersection >= percent * union."""

    def verify(batches):
        # Pairs of one hub follow each other; its set is built once.
        text, members = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(len(a), bool)
            data, offsets = textbytes.flat(right)
            for i, j in textbytes.slices(offsets, CHUNK):
                hashes, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, tail)
                for k in range(i, j):
                    hub = left[k].as_py()
                    if hub != text:
                        raw = hub.encode()
                        text = hub
                        members = np.unique(shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), n, tail)[0])
                    own = np.unique(hashes[bounds[k - i] : bounds[k - i + 1]])
                    both = len(own) + len(members)
                    shared = both - len(np.unique(np.concatenate([own, members])))
                    keep[k] = 100 * shared >= percent * (both - shared)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    return verify


def _buckets(classes: DataFrame, group: int) -> DataFrame:
    """``(key, p, q, rep, n)``: the table keys, and the places of their two hashes, of every class that some other class shares.

    A pair that shares a table shares a hash of each collection, so the hashes that
    occur once are dropped before pairs of them are formed.
    """
    single = classes.select("rep", F.posexplode("hashes").alias("place", "value"))
    common = single.groupBy("place", "value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    shared = single.join(common, ["place", "value"]).groupBy("rep").agg(F.collect_list(F.struct("place", "value")).alias("hashes"))

    def side(first: bool) -> Column:
        return F.filter("hashes", lambda x: (x["place"] < group) if first else (x["place"] >= group))

    pairs = F.flatten(F.transform(side(True), lambda x: F.transform(side(False), lambda y: F.struct(F.xxhash64(x["place"], x["value"], y["place"], y["value"]).alias("key"), x["place"].alias("p"), y["place"].alias("q")))))
    keyed = shared.select("rep", F.inline(pairs)).join(classes.select("rep", "n"), "rep")
    return keyed.select("key", "p", "q", "rep", "n")


def _crowded(buckets: DataFrame) -> DataFrame:
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return buckets.join(several, "key")


def _may_link(percent: int) -> str:
    """Whether two sets can be that similar: members that the other's bitmap lacks are not shared."""
    lacks = [" + ".join(f"bit_count({p}.bits{i} & ~{q}.bits{i})" for i in range(BITMAP)) for p, q in ("xy", "yx")]
    most = f"least(x.n - ({lacks[0]}), y.n - ({lacks[1]}))"
    return f"x.component <> y.component and {100 + percent} * {most} >= {percent} * (x.n + y.n)"


def _first_shared(group: int) -> str:
    """Whether no earlier hash of either collection is equal: of the tables that a pair shares only one has it."""
    same = "zip_with(x.hashes, y.hashes, (u, v) -> u = v)"
    return f"not exists(slice({same}, 1, x.p), e -> e) and not exists(slice({same}, {group + 1}, x.q - {group}), e -> e)"


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, tail: bool = False, rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """Adds ``n_shingles``, ``component_id`` and ``kept`` to all columns of ``docs``.

    Two documents are linked when the Jaccard similarity of their sets of
    ``words``-word shingles is ``percent`` or more, confirmed on the full sets.
    ``component_id`` is the smallest ``doc_id`` reachable over links; ``kept`` marks
    the document it names. With ``tail``, a text of fewer words is one shingle.

    A text without shingles (null, empty, white space, or too short) has
    ``n_shingles`` 0 and links with nothing. Rows that repeat a ``doc_id`` get the
    component of that id; of equal rows each is ``kept``. A null ``doc_id`` links with
    nothing. Extra columns stay; one named like a new column is replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, k1 long, k2 long, hashes array<long>, bitmap array<long>"
    sketched = stored(ids.mapInArrow(lean(_sketch(words, tail, rows, group)), schema), "sketches")
    key = ["n", "k1", "k2"]
    usable = sketched.filter("n > 0 and doc_id is not null")
    classes = stored(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("hashes").alias("hashes"), F.first("bitmap").alias("bitmap")), "classes")
    buckets = stored(_crowded(_buckets(classes, group)), "buckets")
    texts = stored(
        ids.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text"), "texts"
    )

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b)."""
        first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(_verify(words, tail, percent)), "a long, b long")

    spark = docs.sparkSession
    tested = spark.createDataFrame([], "a long, b long")
    bits = [f"bits{i}" for i in range(BITMAP)]
    side = ["rep", "n", "component", *bits]
    maps = classes.select("rep", *[F.col("bitmap")[i].alias(c) for i, c in enumerate(bits)])
    labels, opened = None, buckets.withColumn("component", F.col("rep")).join(maps, "rep")
    for turn in range(HUBS + 1):
        if turn < HUBS:
            # The first hub is the smallest id, mostly the same in all tables; later ones differ by table.
            choice = F.col("rep") if turn == 0 else F.xxhash64("rep", "key", F.lit(turn))
            hub = opened.groupBy("key").agg(F.min_by(F.struct(*side), choice).alias("x"))
            met = opened.select("key", F.struct(*side).alias("y")).join(hub, "key").filter(_may_link(percent))
        else:
            # A pair meets once, in the first of its tables, however many it shares.
            whole = opened.join(classes.select("rep", "hashes"), "rep").select("key", F.struct(*side, "p", "q", "hashes").alias("x"))
            y = whole.select(F.col("key").alias("_key"), F.col("x").alias("y"))
            met = whole.join(y, (F.col("key") == F.col("_key")) & F.expr(f"x.rep < y.rep and {_may_link(percent)} and {_first_shared(group)}"))
        pairs = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        if turn:
            known = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not turn or not pairs.isEmpty():
            tested, links = tested.union(pairs), stored(verified(pairs), "confirmed")
            # What is known already enters as the stars it was left as.
            labels = components(links if labels is None else links.union(labels.select("node", "component")))
        if turn < HUBS:
            named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            unsettled = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
            opened = stored(named.join(unsettled, "key").select("key", "p", "q", "rep", "n", "component").join(maps, "rep"), "open")
    release(texts)
    of_class = classes.select(*key, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component_id")
    )
    # Rows of one document have one component, whichever of them is read first.
    known = (
        sketched.select("doc_id", *key)
        .join(of_class, key, "left")
        .groupBy("doc_id")
        .agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
        .withColumnRenamed("doc_id", "_doc")
    )
    return (
        docs.join(known, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left")
        .withColumn("component_id", F.coalesce("component_id", "_doc"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("_doc"), F.lit(True)))
        .select(*docs.columns, "n_shingles", "component_id", "kept")
    )


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), words=4, tail=True).select("doc_id", "n_shingles", "component_id", "kept")
