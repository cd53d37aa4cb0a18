"""Words, hashes and window minima of many texts at once, on their UTF-8 bytes.

The helpers work on one flat byte array and the offsets of the texts in it, as
Arrow stores a text column. All of them are plain array functions for the inside
of a task; Spark splits and shuffles the rows around them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: White space between words: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def letters(fold: bool) -> np.ndarray:
    """A 64-bit value per byte; with ``fold``, A-Z have the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        table[65:91] = table[97:123]
    return table


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


@functools.cache
def _slab_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, SLAB + 1), powers(BASE_INVERSE, SLAB + 1)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= SLAB + 1:
        up, down = _slab_powers()
        return up[:n], down[:n]
    return powers(BASE, n), powers(BASE_INVERSE, n)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a text column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values if values is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of whole texts that together have at most ``limit`` bytes, or are one text."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


def _edges(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last; words end where texts end."""
    inside = ~separator[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(
    data: np.ndarray, offsets: np.ndarray, fold: bool, separator: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends and hashes of all words, first word of each text, and hashes of word beginnings.

    Hashes are polynomials over 64-bit values, mixed. Work goes slab by slab, cut
    between words, so scratch memory does not grow with the length of a text.
    """
    starts, ends = _edges(data, offsets, separator)
    n = len(starts)
    hashes = np.empty(n, np.uint64)
    begun = [np.empty(n, np.uint64) for _ in prefixes]
    table, first = letters(fold), 0
    while first < n:
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + SLAB, "right")), first + 1)
        s, e = starts[first:last] - base, ends[first:last] - base
        size = int(e[-1])
        up, down = power_tables(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[base : base + size]] * up[:size], out=total[1:])
        hashes[first:last] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        for out, p in zip(begun, prefixes):
            cut = np.minimum(s + p, e)
            out[first:last] = (total[cut] - total[s]) * down[s] + np.uint64(p)
        first = last
    owner = np.searchsorted(starts, offsets)
    return starts, ends, mix(hashes), owner, [mix(b) for b in begun]


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive symbols (64-bit values)."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(BASE)
        out += symbols[i : i + n]
    return mix(out)


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums, for ``range_hash``."""
    up, _ = power_tables(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return total


def range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols from ``start`` to ``end``, exclusive."""
    _, down = power_tables(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values, by doubling."""
    out, width = values, 1
    while width < w:
        step = min(width, w - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out
