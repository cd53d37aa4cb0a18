"""Resampling, fill-in-middle and SentencePiece against brute force and the public library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from barograph.llm import fim, pieces, resample

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd_texts():
    """Null, empty, blank, long, odd and repeated texts, and such with sentinels."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(("alpha", "Beta", "gamma7", "Äpfel", "日本", "x")) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    lines = ["\n".join(rng.choice(("", "one", "two words", "\r")) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    alphabet = "ab é日😀▁ \n\t<>\x00́ﬁ½"
    noisy = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)]
    odd = [None, "", " ", "\n", "\n\n", "no break", "break\n", "a <P> b\nc", "<S", "<M>", "﷽ �𐍈​▁", "word " * 30_000, "\n" * 20_000, "a" * 5000, " " * 100]
    return [*prose, *lines, *noisy, *odd, prose[0], prose[0]]


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    """``odd_texts`` with repeated and null ids, and columns named like new ones."""
    rows = [(3 * i, t, "own", 1.5, "o") for i, t in enumerate(odd_texts)]
    rows += [rows[5], rows[5], (None, "null id " * 12, "own", 2.5, "o"), (rows[9][0], "same id, other text " * 8, "own", 0.5, "o")]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, rank double, ids string").repartition(3), rows


def drawn(doc_id, seed):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def middle_by_lines(doc_id, text, seed, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h1, h2, h3, h4 = drawn(doc_id, seed)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("seed,rate,spm_rate", [(7, 100, 50), (1, 40, 0), (2, 100, 100), (3, 0, 50)])
def test_fill_in_middle(docs, seed, rate, spm_rate):
    df, rows = docs
    out = fim.fill_in_middle(df, seed, rate, spm_rate)
    assert out.columns == ["doc_id", "text", "rank", "ids", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = repr
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(
        ((i, t, *middle_by_lines(i, t, seed, rate, spm_rate)) for i, t, *_ in rows), key=key
    )
    assert all(r.back == (r.text or "") for r in got)
    if (rate, spm_rate) == (100, 50):
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_by_words(spark):
    """Other units and sentinels, with characters that patterns read."""
    df = spark.createDataFrame([(i, "one two  three four") for i in range(40)], "doc_id long, text string")
    marks = ("[.", "$(", "\\d")
    got = fim.fill_in_middle(df, unit=r" *[^ ]+", sentinels=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.n for r in got} == {4} and {r.back for r in got} == {"one two  three four"}
    assert {r.prefix_chars for r in got} <= {0, 3, 7, 14, 19}


def test_fill_in_middle_empty(spark):
    assert fim.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def weighted(rows, target, ngrams, buckets, seed, min_words, share):
    """Every step in the plainest way: per row (id, n_features, weight, score, rank)."""

    def grams(text):
        w = WORD.findall((text or "").translate(LOWERED))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]

    own, wanted = [grams(t) for _, t, *_ in rows], [grams(t) for t in target]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, some in ((s, own), (t, wanted)):
        for _, found in some:
            np.add.at(counts, found, 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t)]
    out = []
    for (i, *_), (n, found) in zip(rows, own):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((drawn(i, seed)[0] + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(eligible[: share * len(eligible) // 100], 1):
        r[5] = rank
    return [(r[0], *r[2:]) for r in out]


@pytest.mark.parametrize("ngrams,buckets,share", [(1, 10_000, 10), (2, 100_000, 35), (3, 50, 100)])
def test_resample(spark, docs, ngrams, buckets, share):
    df, rows = docs
    target = ["alpha Beta gamma7 in the target", "日本 x", None, "", "alpha"]
    wanted = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    out = resample.resample(df, wanted, ngrams=ngrams, buckets=buckets, share=share)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    expected = weighted(rows, target, ngrams, buckets, 2024, 20, share)
    # Rows that repeat an id and score may swap ranks among themselves.
    assert sorted((r[:4] for r in got), key=repr) == sorted((r[:4] for r in expected), key=repr)
    assert sorted((r for r in got if r[4]), key=lambda r: r[4]) == sorted((r for r in expected if r[4]), key=lambda r: r[4])
    kept = resample.drawn(df, out).collect()
    assert {(r.doc_id, r.text) for r in kept} <= {(i, t) for i, t, *_ in rows} and {r.doc_id for r in kept} == {r[0] for r in got if r[4]}


def test_overlapping_spans():
    text = resample.collapsed(" Ab-cd  e\n日 ")
    assert text == "ab cd e 日".encode()
    spans = [text[m.start() : m.end()].decode() for m in resample.gram_pattern(2).finditer(text, overlapped=True)]
    assert spans == ["ab cd", "cd e", "e 日"]


def test_resample_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, item_id string, text string")
    assert resample.query(none, none).count() == 0
    df, rows = docs
    got = resample.query(df, none).collect()
    assert len(got) == len(rows) and sum(r["rank"] is not None for r in got) > 0
    assert resample.resample(df, none, min_words=10**9).filter("rank is not null").count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_sentencepiece(docs, library):
    """Ids and decoded texts are the library's; spans cover the text piece by piece."""
    df, rows = docs
    out = pieces.decode(pieces.encode(df))
    assert out.columns == ["doc_id", "text", "output", "rank", "ids", "begins", "ends", "decoded"]
    got = out.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, ((i, t) for i, t, *_ in rows)))
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        raw = (r.text or "").encode()
        assert [*r.begins, len(raw)] == [0, *r.ends]
        for i, a, b in zip(r.ids, r.begins, r.ends):
            piece, covered = library.id_to_piece(i), raw[a:b].decode()
            assert library.is_byte(i) or covered.replace("▁", " ") in (piece.replace("▁", " "), piece[1:].replace("▁", " "))


def test_sentencepiece_query(spark, odd_texts, library):
    df = spark.createDataFrame([*enumerate(odd_texts)], "doc_id long, text string")
    for r in pieces.query(df).collect():
        ids = library.encode(odd_texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.query(df.limit(0)).count() == 0


def test_decoding_of_any_ids(library):
    rng, known = random.Random(2), pieces.pieces(pieces.MODEL)
    for _ in range(3000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.choice(np.flatnonzero(known.is_byte).tolist()) for _ in range(rng.randrange(12))]
        assert known.decode(ids) == library.decode(ids)


def test_segments_of_any_length(library):
    """Long segments are not remembered, and many are forgotten, without effect on the ids."""
    rng, known = random.Random(4), pieces.pieces(pieces.MODEL)
    texts = ["".join(rng.choice("abcdefghijklmno ") if n < 500 else rng.choice("abc") for _ in range(n)) for n in (1, 3, 50, 99, 100, 101, 400, 3000)] * 2
    assert [ids.tolist() for ids, *_ in known.encode(texts)] == library.encode(texts)
    assert max(map(len, known.remembered)) <= pieces.LONGEST


def test_forgotten_segments(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    known = pieces.Pieces(open(public_tokenizers.path(pieces.MODEL), "rb").read())
    for texts in (["a b c d e f"], ["a b"], ["g h a"], [""]):
        assert [ids.tolist() for ids, *_ in known.encode(texts)] == library.encode(texts)


def message(number: int, value: int | bytes) -> bytes:
    """A field of a serialised message."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 0x7F:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("prefix,spaces,escape", [(1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 1), (1, 1, 0)])
def test_character_map(odd_texts, prefix, spaces, escape):
    """A model with the library's own compiled map normalises, and aligns, as the library does."""
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=bool(prefix), remove_extra_whitespaces=bool(spaces), escape_whitespaces=bool(escape))
    spec = dict(pieces.fields(dict(pieces.fields(rule.serialized_model_proto()))[pieces.NORMALIZER]))
    assert len(spec[pieces.CHARACTER_MAP]) > 10_000
    changed = b"".join(
        message(f, v)
        for f, v in ((1, b"nmt_nfkc"), (pieces.CHARACTER_MAP, spec[pieces.CHARACTER_MAP]), (pieces.DUMMY_PREFIX, prefix), (pieces.REMOVE_SPACES, spaces), (pieces.ESCAPE_SPACES, escape))
    )
    with open(public_tokenizers.path(pieces.MODEL), "rb") as file:
        own = [(f, v) for f, v in pieces.fields(file.read()) if f in (pieces.PIECE, 2)]
    model = b"".join(message(f, v) for f, v in own) + message(pieces.NORMALIZER, changed)
    known, library = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in filter(None, [*odd_texts, "ｶﾞ ﬁne ½　wide Ａ", " ㍿ ", "é é́", "  x 　", "㍑\n㍑"]):
        plain, origin = known.normalised(text.encode())
        assert plain.decode() == library.normalize(text)
        assert len(origin) == len(plain) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())
        if escape:
            ids = next(known.encode([text]))[0].tolist()
            assert ids == library.encode(text) and known.decode(ids) == library.decode(ids)
            _, places = library.normalize(text, with_offsets=True)
            starts = [len(text[:p].encode()) for p in places]
            mine = [*origin[np.flatnonzero(np.frombuffer(plain, np.uint8) & 0xC0 != 0x80)], origin[-1]]
            assert mine == starts
