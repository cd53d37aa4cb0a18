"""Pack tokenised documents into sequences by best fit, partition by partition, then up a tree.

Every task packs the pieces of its own documents by best fit, longest first. Bins
that are nearly full are final. The others become items themselves: fewer and
fewer tasks take them, repack their pieces with those of other tasks, and again
keep what is nearly full. Bins carry their pieces along, so nothing is joined.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barograph.llm import textbytes
from barograph.llm.common import numbered, shuffle_partitions, stored

CAPACITY = 2048
#: Tokens that a final bin may lack.
SLACK = 16
#: Tasks whose underfull bins one task of the next round takes, the bins it takes if there are as many, and at most.
FAN_IN = 8
LEAST = 512
MOST = 4096
#: With more bins than one task takes, rounds end when they save a smaller share of them.
GAIN = 0.01
#: Words whose tokens a worker remembers, beside those of the texts at hand.
REMEMBERED = 600_000
#: Bytes of the texts that are split at a time; a longer text is alone.
CHUNK = 1 << 22
TOKENIZER = "word_bpe_49k.json"


class WordIds(dict):
    """Token ids, as little-endian bytes, of pieces of text between ASCII white space.

    White space always ends a token of this tokenizer, so the ids of a text are
    those of its words in turn. Latin letters are read in lower case and a closing
    comma or full stop apart from them, so one stem serves several words. Stems that
    are not remembered yet are tokenised together: a token that closes a run of
    letters says so in its name, and other words have ``BETWEEN`` between them.
    """

    #: A word of one token, by which the ids of words that are not letters alone are told apart.
    BETWEEN = "~"

    def __init__(self, name: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        (self.between,) = self.ids_of([self.BETWEEN])[0]
        self.mark = {m.encode(): self.ids_of([m])[0].tobytes() for m in (".", ",")}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_letters(self, stems: list[bytes]) -> list[bytes]:
        """Ids of each stem; stems are runs of letters, so each is closed by one token."""
        joined = self.ids_of([b" ".join(stems).decode()])[0]
        ends = np.flatnonzero(self.closes[joined]) + 1
        if len(ends) != len(stems):
            return self.encode(stems)
        raw, end = joined.tobytes(), (4 * ends).tolist()
        return [raw[i:j] for i, j in zip([0, *end], end)]

    def encode(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        joined = self.ids_of([f" {self.BETWEEN} ".join(texts)])[0]
        at = np.flatnonzero(joined == self.between)
        if len(at) != len(texts) - 1:
            # Some word has that token itself.
            return [x.tobytes() for x in self.ids_of(texts)]
        raw, begin, end = joined.tobytes(), [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), 4 * len(joined)]
        return [raw[i:j] for i, j in zip(begin, end)]

    def stem(self, word: bytes) -> bytes | None:
        """The letters of the word, but for a mark that closes it, in lower case; none for other words."""
        body = word[:-1] if word[-1:] in self.mark else word
        if body.isalpha():
            return body.lower()
        if body.isascii():
            return None
        # Beyond Latin, or where lower case adds a combining sign, letters may not stay letters.
        text = body.decode()
        if max(text) < "\u0250" and (lower := text.lower()).isalpha():
            return lower.encode()
        return None

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of ``words``, all different; older ones are forgotten when there are too many."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = words
        stems = list(map(self.stem, new))
        # A word that is its own stem is new itself.
        letters = {w for w, s in zip(new, stems) if s == w}
        letters |= {s for w, s in zip(new, stems) if s and s != w and s not in self}
        between = self.BETWEEN.encode()
        others = [w for w, s in zip(new, stems) if not s]
        plain, marked = [w for w in others if between not in w], [w for w in others if between in w]
        for some, encode in ((list(letters), self.encode_letters), (plain, self.encode)):
            if some:
                self.update(zip(some, encode(some)))
        self.update((w, self.ids_of([w.decode()])[0].tobytes()) for w in marked)
        self.update((w, self[s] + self.mark.get(w[-1:], b"")) for w, s in zip(new, stems) if s and s != w)


@functools.cache
def word_ids(name: str) -> WordIds:
    # Spark has a task for every core already.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(name)


def token_bytes(texts: pa.Array, known: WordIds) -> Iterator[bytes]:
    """Ids of each text and the closing id 0, four bytes each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets = textbytes.flat(texts)
    for a, b in textbytes.slices(offsets, CHUNK):
        words = pc.ascii_split_whitespace(texts.slice(a, b - a))
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.cast(pa.large_binary()).to_pylist()
        known.learn(different)
        ids = pa.array(map(known.__getitem__, different), pa.large_binary()).take(coded.indices)
        data, ends = textbytes.flat(ids)
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        raw = data.tobytes()
        for i, j in zip(bounds, bounds[1:]):
            yield raw[i:j] + b"\0\0\0\0"


def best_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each item and the number of bins; items in the order given, each into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, count = 0, [], 0
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, count
            count += 1
        left = room - n
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(at)
        bins.append(at)
    return bins, count


PIECES = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
BIN = "fill long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def fill_bins(items: pa.ListArray, capacity: int) -> pa.RecordBatch:
    """Bins of ``items``, each a list of pieces that stay together: how full, and their pieces."""
    counts = np.diff(items.offsets.to_numpy())
    pieces = items.flatten()
    lengths = pieces.field("length").to_numpy()
    bounds = np.cumsum(counts) - counts
    sizes = np.add.reduceat(lengths, bounds)
    first = [pieces.field(c).take(pa.array(bounds)).to_pandas() for c in ("doc_id", "piece", "ids_crc32")]
    # Longest first; equal ones by their first piece, so that a repeated task packs alike.
    order = pd.DataFrame({"size": -sizes, **dict(enumerate(first))}).sort_values(["size", 0, 1, 2], kind="stable").index.to_numpy()
    bins, count = best_fit(sizes[order].tolist(), capacity)
    order = order[np.argsort(bins, kind="stable")]
    grouped = items.take(pa.array(order))
    members = np.bincount(np.sort(bins), weights=counts[order], minlength=count)
    offsets = np.concatenate([[0], np.cumsum(members)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), grouped.flatten())
    fill = np.add.reduceat(grouped.flatten().field("length").to_numpy(), offsets[:-1])
    return pa.RecordBatch.from_arrays([pa.array(fill), lists], ["fill", "pieces"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents with the sequence and place that each has.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` (gapless from 0) and ``offset``. A document is its token ids
    and the id 0; only documents above ``capacity`` are cut, into pieces of that
    many tokens and a last one. Null text is empty and packs the id 0 alone. Rows
    that repeat a ``doc_id`` are packed like any others. Other columns are not read.
    """
    spark = docs.sparkSession

    def cut_and_pack(batches):
        known, parts = word_ids(tokenizer), []
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1), known)):
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)]
            if columns:
                parts.append(pa.StructArray.from_arrays(columns, fields=list(PIECES)))
        if parts:
            pieces = pa.concat_arrays(parts)
            alone = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), pieces)
            yield fill_bins(alone, capacity)

    def merge(batches):
        parts = [b.column(b.schema.get_field_index("pieces")).cast(pa.list_(PIECES)) for b in batches if b.num_rows]
        if parts:
            yield fill_bins(pa.concat_arrays(parts), capacity)

    bins = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_and_pack, BIN), "bins")
    full = f"fill >= {capacity - SLACK}"
    done, tasks, rounds = bins.filter(full), shuffle_partitions(spark) * FAN_IN, 0
    while True:
        under = bins.filter(f"not ({full})")
        taken, rounds = under.count(), rounds + 1
        bound = max(1, math.ceil(taken / MOST))
        tasks = max(bound, min(tasks // FAN_IN, math.ceil(taken / LEAST)))
        # The first piece names a bin; its hash decides the task, so a repeated task sees the same bins,
        # and those of one task part in the next round.
        first = F.element_at("pieces", 1)
        dealt = under.repartition(tasks, F.xxhash64(F.lit(rounds), first["doc_id"], first["piece"]))
        bins = stored(dealt.mapInArrow(merge, BIN), "merged")
        if tasks == 1 or (tasks == bound and bins.count() > (1 - GAIN) * taken):
            break
        done = done.union(bins.filter(full))
    done = done.union(bins)
    first = F.element_at("pieces", 1)
    named = done.select("pieces", first["doc_id"].alias("first_doc"), first["piece"].alias("first_piece"))
    named = numbered(named, [], ["first_doc", "first_piece"], "sequence_id")
    lengths = F.transform("pieces", lambda x: x["length"])
    # A bin has at most ``capacity`` pieces, and few on average.
    offsets = F.transform(lengths, lambda x, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, y: a + y))
    placed = named.select("sequence_id", F.explode(F.arrays_zip("pieces", offsets.alias("offset"))).alias("x"))
    return placed.select("x.pieces.*", "sequence_id", F.col("x.offset").alias("offset"))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
