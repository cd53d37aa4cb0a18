"""Remove repeated word passages: matching statistics against a compressed index per shard.

The variants of a shard are indexed once: the Burrows-Wheeler transform of their
words in a wavelet matrix of packed bits, with common prefix lengths and the least
document of any range of suffixes. Documents then stream through it from their
last word to the first. A search step extends the match to the left; where that
fails, the match is shortened from the right to its parent interval. A match
counts only while its interval holds a smaller document, so the length at each
word is that of the longest passage that an earlier document also holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm import anchors, textbytes
from barograph.llm.common import extended

LENGTH = 50
GRAM = 8
#: Symbols of a shard; its index holds about 250 bytes a symbol while it is built.
SHARD_SYMBOLS = 400_000


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of a symbol in a prefix, one bit of the symbol per level."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.size, self.levels = len(symbols), []
        for shift in range(max(kinds - 1, 1).bit_length() - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.origin = self._descend(np.arange(kinds), np.zeros(kinds, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(symbol, i) - self.origin[symbol]


def _outward_smaller(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the nearest above and below with a smaller common prefix."""
    values = common.tolist()
    above, below, stack = [0] * len(values), [len(values) - 1] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            below[stack.pop()] = i
        above[i] = (above[stack[-1]] if values[stack[-1]] == v else stack[-1]) if stack else 0
        stack.append(i)
    # Equal values share their nearest smaller one below.
    for i in range(len(values) - 2, -1, -1):
        if values[below[i]] == values[i]:
            below[i] = below[below[i]]
    return np.array(above), np.array(below)


class Index:
    """The compressed index of segments that end with the symbol 0."""

    def __init__(self, symbols: np.ndarray, kinds: int, docs: np.ndarray, longest: int):
        n = len(symbols)
        # Suffixes sorted by doubling up to the longest segment; no match is longer.
        rank, step, ranks = symbols.astype(np.int64), 1, []
        while True:
            ranks.append((step, rank))
            if step > longest:
                break
            follow = np.zeros(n, np.int64)
            follow[:-step or None] = rank[step:] + 1
            _, rank = np.unique(rank * (n + kinds + 2) + follow, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.size = n
        self.transform = WaveletMatrix(symbols[order - 1], kinds)
        self.first = np.searchsorted(symbols[order], np.arange(kinds))
        # Common prefixes of neighbouring rows from the ranks of the doublings.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for step, rank in reversed(ranks):
            inside = np.maximum(a, b) < n
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            common[same] += step
            a[same] += step
            b[same] += step
        self.common = np.concatenate([[-1], common, [-1]])
        self.above, self.below = _outward_smaller(self.common)
        self.least = [docs[order]]
        while 2 ** len(self.least) <= n:
            half, row = 2 ** (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(row[:-half], row[half:]))

    def least_doc(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least document among the rows of each non-empty interval."""
        level = np.frexp((right - left).astype(float))[1] - 1
        out = np.empty(len(left), self.least[0].dtype)
        for k in np.unique(level):
            mine = level == k
            row = self.least[k]
            out[mine] = np.minimum(row[left[mine]], row[right[mine] - 2**k])
        return out

    def matching_statistics(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For every symbol, the longest passage from it that a smaller document holds.

        All segments advance together, each from its last symbol to its first.
        """
        found = np.zeros(len(symbols), np.int64)
        todo = np.flatnonzero(sizes > 0)
        at = starts[todo] + sizes[todo] - 1
        left, right = np.zeros(len(todo), np.int64), np.full(len(todo), self.size)
        length = np.zeros(len(todo), np.int64)
        while len(todo):
            symbol = symbols[at]
            base = self.first[symbol]
            l2 = base + self.transform.rank(symbol, left)
            r2 = base + self.transform.rank(symbol, right)
            ok = r2 > l2
            ok[ok] = self.least_doc(l2[ok], r2[ok]) < docs[todo[ok]]
            # Nothing left to shorten: this symbol has no match.
            none = ~ok & (length == 0)
            shrink = ~ok & ~none
            left, right = np.where(ok, l2, left), np.where(ok, r2, right)
            length = length + ok
            found[at[ok]] = length[ok]
            if shrink.any():
                l, r = left[shrink], right[shrink]
                low, high = self.common[l], self.common[r]
                shorter = np.maximum(low, high)
                left[shrink] = np.where(low == shorter, self.above[l], l)
                right[shrink] = np.where(high == shorter, self.below[r], r)
                length[shrink] = shorter
                empty = shrink.copy()
                empty[shrink] = shorter <= 0
                left[empty], right[empty], length[empty] = 0, self.size, 0
            at = at - (ok | none)
            go = at >= starts[todo]
            todo, at, left, right, length = todo[go], at[go], left[go], right[go], length[go]
        return found


def solve(contents: list[bytes], docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each segment covered by windows that a segment of a smaller document holds."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents)) // 8
    kinds, words = np.unique(np.frombuffer(b"".join(contents), np.uint64), return_inverse=True)
    # Segment after segment, each closed by the symbol 0.
    starts = np.cumsum(sizes + 1) - sizes - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    rel = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    symbols[starts[row] + rel] = words + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    _, doc_rank = np.unique(docs, return_inverse=True)
    doc_rank = doc_rank.astype(np.int32)
    index = Index(symbols, len(kinds) + 1, doc_rank[owner], int(sizes.max(initial=0)))
    found = index.matching_statistics(symbols, starts, sizes, doc_rank)
    return anchors.covered_runs(found[starts[row] + rel] >= LENGTH, row, rel, LENGTH)


def remove_passages(docs: DataFrame) -> DataFrame:
    """Cut from each text the words of 50-word windows that a smaller document also holds.

    Returns all columns of ``docs`` and ``n_words``, ``removed`` (array of first
    word and word after the last, maximal, sorted) and ``kept`` (remaining words
    joined by one space).

    Words are runs of anything but space and \\x09 to \\x0D, unchanged. All windows
    are judged on the input. A null text has no words; a text under 50 words keeps
    all. Rows that repeat a ``doc_id`` are one document, and each gets its row. A
    null ``doc_id`` takes no part and keeps all. Extra columns stay; names starting
    with ``_`` are reserved, and one named like a new column is replaced.
    """
    ranges = anchors.repeated_ranges(docs, anchors.Words, LENGTH, GRAM, solve, True, SHARD_SYMBOLS)
    ranges = ranges.select(F.col("doc_id").alias("_doc"), F.col("ranges").alias("_ranges"))
    docs = docs.drop("n_words", "removed", "kept", "_ranges", "_doc")
    joined = docs.join(ranges, docs["doc_id"] == ranges["_doc"], "left").drop("_doc")
    out = extended(docs.schema, "n_words long, removed array<struct<s:long,e:long>>, kept string")

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            data, offsets = textbytes.flat(batch.column(names.index("text")))
            lists = batch.column(names.index("_ranges"))
            starts, ends, _, owner, _ = textbytes.words(data, offsets, fold=False)
            raw = data.tobytes()
            sizes, removed, kept = [], [], []
            for i, parts in enumerate(lists):
                a, b = owner[i], owner[i + 1]
                s = e = np.empty(0, np.int64)
                if parts.is_valid:
                    fields = parts.values
                    s, e = anchors.merged(fields.field("s").to_numpy(), fields.field("e").to_numpy(), b - a)
                stay = np.ones(b - a, bool)
                for x, y in zip(s.tolist(), e.tolist()):
                    stay[x:y] = False
                keep = np.flatnonzero(stay) + a
                sizes.append(int(b - a))
                removed.append([{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist())])
                kept.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]).decode())
            columns = [batch.column(i) for i, n in enumerate(names) if n != "_ranges"]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "_ranges"] + ["n_words", "removed", "kept"])

    return joined.mapInArrow(cut, out)


def query(docs: DataFrame) -> DataFrame:
    """The digest of ``remove_passages`` per document."""
    done = remove_passages(docs.select("doc_id", "text"))
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return done.select("doc_id", "n_words", lengths.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
