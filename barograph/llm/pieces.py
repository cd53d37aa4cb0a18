"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map
has; every normalised byte remembers the source byte it stems from, so each piece is
projected to the span of the original text that it covers. A segment begins where spaces
do, and no piece goes on beyond its end, so merging segments apart gives what merging
the text gives: each is merged once, by the public library with its own normalisation off,
and remembered.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import batches_of, digest, extended

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Segments whose pieces a worker remembers, beside those of the texts at hand, and the longest of them.
REMEMBERED = 600_000
LONGEST = 64
#: Characters of the texts that are encoded at a time; a longer text is alone.
CHUNK = 1 << 20
ENCODED = "ids array<int>, begins array<int>, ends array<int>"

# Field numbers of the public model format.
NORMALIZER, PIECE = 3, 1
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
PIECE_TYPE, NORMAL, USER_DEFINED = 3, 1, 4
#: Behind a model, this takes its normalisation away: of fields given twice the later one holds.
BARE = bytes([NORMALIZER << 3 | 2, 8, CHARACTER_MAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, REMOVE_SPACES << 3, 0, ESCAPE_SPACES << 3, 0])


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The longest prefix of a text that a compiled map has, and what replaces it.

    The map is a double-array trie of 32-bit units over UTF-8 bytes, whose values are
    places in a list of texts that end with a zero byte.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]
        first = (b for b in range(1, 0x100) if self.units and self._step(0, b) is not None)
        starts = b"".join(regex.escape(bytes([b])) for b in first)
        #: Where a replacement may begin; no text of the map begins within a character.
        self.start = regex.compile(b"[" + starts + b"]") if starts else None

    def _step(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        child = node ^ ((unit >> 10) << ((unit & 0x200) >> 6)) ^ byte
        return child if child < len(self.units) and self.units[child] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text[at:]`` and its replacement."""
        node, best = 0, None
        for i in range(at, len(text)):
            child = self._step(node, text[i])
            if child is None:
                break
            node, unit = child, self.units[child]
            if unit >> 8 & 1:
                leaf = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                best = i + 1 - at, leaf
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


def char_starts(text: bytes) -> np.ndarray:
    """For each byte of UTF-8 the place where its character begins."""
    raw = np.frombuffer(text, np.uint8)
    return np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))


class Pieces:
    """Encoding and decoding by one model with byte fallback."""

    def __init__(self, model: bytes):
        spec = dict(fields(next((v for f, v in fields(model) if f == NORMALIZER), b"")))
        self.map = CharacterMap(spec.get(CHARACTER_MAP, b""))
        self.dummy_prefix = bool(spec.get(DUMMY_PREFIX, 1))
        self.remove_spaces = bool(spec.get(REMOVE_SPACES, 1))
        self.space = SPACE_BYTES if spec.get(ESCAPE_SPACES, 1) else b" "
        kinds = [dict(fields(v)).get(PIECE_TYPE, NORMAL) for f, v in fields(model) if f == PIECE]
        self.library = known = sentencepiece.SentencePieceProcessor(model_proto=model + BARE)
        names = [known.id_to_piece(i) for i in range(len(kinds))]
        if USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        if sum(map(known.is_byte, range(len(kinds)))) < 0x100:
            raise ValueError("the model must fall back to bytes")
        if any(SPACE in n.lstrip(SPACE) for n, k in zip(names, kinds) if k == NORMAL):
            raise ValueError("a piece goes on beyond a space")
        byte_ids = [known.piece_to_id(f"<0x{b:02X}>") for b in range(0x100)]
        self.lengths = np.array([len(n.encode()) for n in names], np.int64)
        self.lengths[byte_ids] = 1
        self.is_byte = np.zeros(len(names), bool)
        self.is_byte[byte_ids] = True
        self.surface = [n.replace(SPACE, " ").encode() if k == NORMAL else b"" for n, k in zip(names, kinds)]
        for i in range(len(names)):
            if known.is_unknown(i):
                self.surface[i] = known.decode([i]).encode()
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        self.led_by_space = {i for i, (n, k) in enumerate(zip(names, kinds)) if k == NORMAL and n.startswith(SPACE)}
        #: Ids of segments as little-endian bytes.
        self.remembered: dict[str, bytes] = {}

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text to be merged, and for each of its bytes, and its end, the source byte.

        Bytes of a replacement, and of a character, stem from where its source begins.
        """
        if not text:
            return b"", np.zeros(1, np.int64)
        out, origin = self._replaced(text) if self.map.start else (text, char_starts(text))
        end = len(text)
        if self.remove_spaces:
            raw = np.frombuffer(out, np.uint8)
            blank = raw == 0x20
            # Of spaces side by side the first stays; none stays at either end.
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            last = np.flatnonzero(keep & ~blank)
            if not len(last):
                return b"", np.zeros(1, np.int64)
            if last[-1] + 1 < len(out):
                end = int(origin[last[-1] + 1])
                keep[last[-1] + 1 :] = False
            out, origin = raw[keep].tobytes(), origin[keep]
        if self.space != b" ":
            blank = np.frombuffer(out, np.uint8) == 0x20
            origin = np.repeat(origin, np.where(blank, len(self.space), 1))
            out = out.replace(b" ", self.space)
        if self.dummy_prefix:
            out = self.space + out
            origin = np.concatenate([np.full(len(self.space), origin[0]), origin])
        return out, np.append(origin, end)

    def _replaced(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """``text`` with the replacements of the character map, and the source byte of each byte."""
        own, parts, origins, done, at = char_starts(text), [], [], 0, 0
        while found := self.map.start.search(text, at):
            at = found.start()
            match = self.map.longest(text, at)
            if match is None:
                at += 1
                continue
            size, new = match
            parts += [text[done:at], new]
            origins += [own[done:at], np.full(len(new), at)]
            done = at = at + size
        return b"".join([*parts, text[done:]]), np.concatenate([*origins, own[done:]])

    def merged(self, segments: list[str]) -> Iterator[bytes]:
        """Ids of normalised text."""
        return (array("i", ids).tobytes() for ids in self.library.encode(segments, num_threads=1))

    def learn(self, segments: set[str]) -> None:
        """Remember the ids of ``segments``; older ones are forgotten when there are too many."""
        known = self.remembered
        new = segments.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = segments
        known.update(zip(new, self.merged([SPACE + s for s in new])))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids, and where each piece begins and ends in its UTF-8 bytes.

        Of the bytes of one character the last one has its span, those before are empty.
        """
        plain, origins = zip(*(self.normalised(text.encode()) for text in texts))
        parts = [split(x.decode()) for x in plain]
        self.learn(set().union(*(segments for _, segments in parts)))
        for (head, segments), origin in zip(parts, origins):
            ids = b"".join(map(self.remembered.__getitem__, segments))
            if head:
                ids = next(self.merged([head])) + ids
            ids = np.frombuffer(ids, "<i4")
            places = origin[np.concatenate([[0], np.cumsum(self.lengths[ids])])]
            yield ids, places[:-1], places[1:]
        for s in {s for _, segments in parts for s in segments if len(s) > LONGEST}:
            del self.remembered[s]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; control pieces have none, bytes that are no UTF-8 become U+FFFD one by one."""
        if not ids:
            return ""
        led = (self.dummy_prefix or self.remove_spaces) and self._first_space(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        return text[1:] if led else text

    def _first_space(self, ids: list[int]) -> bool:
        """Whether the first piece that has a text begins with the space put before every text."""
        first = next((i for i in ids if self.surface[i]), None)
        return first in self.led_by_space

    def _runs(self, ids: list[int]) -> Iterator[str]:
        run = b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                try:
                    yield run.decode()
                    break
                except UnicodeDecodeError as error:
                    yield run[: error.start].decode() + "�"
                    run = run[error.start + 1 :]
            run = b""
            if i is not None:
                yield self.surface[i].decode()


MORE_SPACES = regex.compile(rf"{SPACE}({SPACE}*[^{SPACE}]*)")


def split(plain: str) -> tuple[str, list[str]]:
    """What stands before the first space, and the segments, each without the space that begins it."""
    at = plain.find(SPACE)
    if at < 0:
        return plain, []
    if SPACE * 2 in plain:
        return plain[:at], MORE_SPACES.findall(plain, at)
    return plain[:at], plain[at + 1 :].split(SPACE)


@functools.cache
def pieces(name: str) -> Pieces:
    with open(public_tokenizers.path(name), "rb") as file:
        return Pieces(file.read())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``ids``, ``begins`` and ``ends`` to ``docs``: the pieces of each text and the bytes they cover.

    ``model`` names a file of the public tokenizers, which every worker loads itself.
    Spans are places in the UTF-8 of the original text: without gaps but for spaces that
    the model removes, and whole characters, so that several byte pieces of one character
    have one span between them. Null and empty texts have no piece. Rows are independent,
    repeated ones too. Extra columns stay; one named like a new column is replaced.
    """
    schema = extended(docs.schema, ENCODED)
    kept = [c for c in docs.columns if c not in ("ids", "begins", "ends")]

    def run(batches):
        known = pieces(model)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for rows in batches_of(range(len(texts)), CHUNK, lambda i: len(texts[i])):
                done = [*known.encode([texts[i] for i in rows])]
                own = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *(_lists(list(x)) for x in zip(*done))], schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the pieces in column ``ids``; null gives an empty text."""
    schema = extended(encoded.schema, "decoded string")
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        known = pieces(model)
        for batch in batches:
            column = batch.column(ids)
            for at in range(0, len(batch), 256):
                texts = [known.decode(x or []) for x in column.slice(at, 256).to_pylist()]
                own = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), pa.array(texts, pa.string())], schema.names)

    return encoded.select(*kept).mapInArrow(run, schema)


def listed(ids: Column) -> Column:
    """Ids in decimal, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def query(docs: DataFrame) -> DataFrame:
    done = decode(encode(docs.select("doc_id", "text")).select("doc_id", "ids"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(listed(F.col("ids"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )
