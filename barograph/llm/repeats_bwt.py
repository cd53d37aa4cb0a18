"""Remove repeated byte strings: suffix order of many segments, built column by column.

The suffix order of a shard's segments comes from inserting one symbol of every
segment in each round, from the last symbol to the first. A round sorts the
present transform by symbol, which gives the rows of the new suffixes, and merges
them into two sequential columns, the Burrows-Wheeler transform and the lengths
of common prefixes. No suffix is ever compared with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm import anchors
from barograph.llm.common import extended

LENGTH = 100
GRAM = 32
#: Symbols of a shard; the columns of one hold about 30 bytes a symbol and stay in a core's cache.
SHARD_SYMBOLS = 200_000


def collection_transform(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Transform (0 for "nothing before", else byte + 1) and common prefix with the row above.

    UTF-8 has no byte 255, so a symbol fits into a byte and a round sorts in linear time.
    Rows are the suffixes of all strings in order, the empty ones first, those of
    equal content in the order of the strings.
    """
    m = len(contents)
    sizes = np.fromiter(map(len, contents), np.int64, m)
    data = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum(sizes)

    def before(which: np.ndarray, taken: int) -> np.ndarray:
        """The symbol before the last ``taken`` ones of the strings ``which``."""
        out = np.zeros(len(which), np.uint8)
        some = sizes[which] > taken
        out[some] = data[ends[which[some]] - taken - 1] + 1
        return out

    everyone = np.arange(m)
    transform, common, row = before(everyone, 0), np.zeros(m, np.int16), everyone.copy()
    for taken in range(1, int(sizes.max(initial=0)) + 1):
        active = everyone[sizes >= taken]
        order = np.argsort(transform, kind="stable")
        order = order[np.count_nonzero(transform == 0) :]
        symbols = transform[order]
        # Rows of the new suffixes: where the symbol before each newest suffix goes when sorted.
        n = len(transform)
        keys = symbols.astype(np.int64)
        keys *= n
        keys += order
        newest = row[active]
        target = np.searchsorted(keys, transform[newest].astype(np.int64) * n + newest)
        new = np.zeros(m + len(order), bool)
        new[m + target] = True
        merged = np.empty(len(new), np.uint8)
        merged[~new] = transform
        merged[m + target] = before(active, taken)
        # A prefix changes at a new row and at the row below it: one more than the
        # least between the two shorter suffixes in the columns of the last round.
        prefixes = np.empty(len(new), np.int16)
        prefixes[~new] = common
        moved = new[m:].copy()
        moved[1:] |= new[m:-1]
        touched = np.flatnonzero(moved)
        same = symbols[touched] == symbols[np.maximum(touched - 1, 0)]
        same &= touched > 0
        prefixes[m + touched] = 0
        touched = touched[same]
        if len(touched):
            pairs = np.empty(2 * len(touched), np.int64)
            pairs[0::2], pairs[1::2] = order[touched - 1] + 1, order[touched] + 1
            prefixes[m + touched] = np.minimum.reduceat(np.append(common, np.int16(0)), pairs)[0::2] + 1
        transform, common = merged, prefixes
        row[active] = m + target
    return transform, common


def suffix_rows(transform: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and start of every row, by walking all strings backwards through the transform."""
    m = len(sizes)
    order = np.argsort(transform, kind="stable")[np.count_nonzero(transform == 0) :]
    longer = np.empty(len(transform), np.int64)
    longer[order] = m + np.arange(len(order))
    string, start = np.empty(len(transform), np.int64), np.empty(len(transform), np.int64)
    which, row, taken = np.arange(m), np.arange(m), 0
    while len(which):
        string[row], start[row] = which, sizes[which] - taken
        go = sizes[which] > taken
        which, row, taken = which[go], longer[row[go]], taken + 1
    return string, start


def solve(contents: list[bytes], docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each string covered by windows that start earlier in another string or the same."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    transform, common = collection_transform(contents)
    string, start = suffix_rows(transform, sizes)
    group = np.cumsum(common < LENGTH)
    whole = sizes[string] - start >= LENGTH
    string, start, group = string[whole], start[whole], group[whole]
    at = places[string] + start
    order = np.lexsort((at, docs[string], group))
    doc_sorted, at_sorted, group_sorted = docs[string][order], at[order], group[order]
    head = np.ones(len(order), bool)
    head[1:] = group_sorted[1:] != group_sorted[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    repeated = np.zeros(len(order), bool)
    repeated[order] = (doc_sorted != doc_sorted[first]) | (at_sorted != at_sorted[first])
    by = np.lexsort((start, string))
    return anchors.covered_runs(repeated[by], string[by], start[by], LENGTH)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut from each text the bytes of 100-byte strings that also start earlier.

    Returns all columns of ``docs`` and ``n_bytes``, ``removed`` (array of start
    and end in bytes, maximal, sorted) and ``kept`` (binary: remaining bytes
    joined; a cut may fall inside a character).

    Earlier: in a document with a smaller ``doc_id``, or before in the same one.
    All windows are judged on the input. Null text is empty. Texts under 100
    bytes keep all. Rows that repeat a ``doc_id`` are one document: they are not
    repeats of each other, and each gets its row. A null ``doc_id`` takes no
    part and keeps all. Extra columns stay; names starting with
    ``_`` are reserved, and one named like a new column is replaced.
    """
    ranges = anchors.repeated_ranges(docs, anchors.Bytes, LENGTH, GRAM, solve, False, SHARD_SYMBOLS)
    ranges = ranges.select(F.col("doc_id").alias("_doc"), F.col("ranges").alias("_ranges"))
    docs = docs.drop("n_bytes", "removed", "kept", "_ranges", "_doc")
    joined = docs.join(ranges, docs["doc_id"] == ranges["_doc"], "left").drop("_doc")
    out = extended(docs.schema, "n_bytes long, removed array<struct<s:long,e:long>>, kept binary")

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text")).cast(pa.large_binary())
            lists = batch.column(names.index("_ranges"))
            sizes, removed, kept = [], [], []
            for text, parts in zip(texts, lists):
                raw = text.as_py() or b""
                s = e = np.empty(0, np.int64)
                if parts.is_valid:
                    fields = parts.values
                    s, e = anchors.merged(fields.field("s").to_numpy(), fields.field("e").to_numpy(), len(raw))
                bounds = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
                sizes.append(len(raw))
                removed.append([{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())])
                kept.append(b"".join(raw[bounds[i] : bounds[i + 1]] for i in range(0, len(bounds), 2)))
            columns = [batch.column(i) for i, n in enumerate(names) if n != "_ranges"]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "_ranges"] + ["n_bytes", "removed", "kept"])

    return joined.mapInArrow(cut, out)


def query(docs: DataFrame) -> DataFrame:
    """The digest of ``remove_repeats`` per document."""
    done = remove_repeats(docs.select("doc_id", "text"))
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return done.select(
        "doc_id", "n_bytes", lengths.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
