"""The operators of the package against brute force, on hand-written and small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from barograph.llm import (
    components,
    decontaminate,
    near_dup,
    packing,
    pii,
    repeats_bwt,
    repeats_fm,
    secrets,
    sharding,
    toxicity,
    vectors,
)
from barograph.llm.common import stored

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, empty, null and long texts, a repeated row, clashing columns."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(40)]
    base = words(rng, 150)
    for _ in range(8):
        near = list(base)
        near[rng.randrange(150)] = "changed"
        texts.append(" ".join(near))
    passage = " ".join(words(rng, 70))
    texts += [" ".join([*words(rng, 30), passage, *words(rng, 20)]) for _ in range(6)]
    texts += [texts[3]] * 3 + ["", None, " \t\n", "one two", "One TWO", "é" * 150 + " " + "é" * 150, " ".join(words(rng, 9000))]
    rows = [(7 * i + 3, t, "x", 1.5) for i, t in enumerate(texts)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, items double").repartition(3), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    out = defaultdict(list)
    for row in df.collect():
        out[row["doc_id"]].append(row)
    assert all(len(set(rows)) == 1 for rows in out.values())
    return {k: rows[0] for k, rows in out.items()}


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900, x) for x in range(700, 900)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(links, nodes)


@pytest.mark.parametrize(
    ("links", "rounds"),
    [
        ([], 0),
        ([(1, 1), (None, 2)], 0),
        ([(1, x) for x in range(2, 20)] + [(30, 31), (31, 30), (31, 31)], 0),
        ([(5, 1), (5, 2)], 1),
        ([(1, 2), (2, 3), (2, 2)], 1),
    ],
)
def test_components_end_with_the_stars(spark, monkeypatch, links, rounds):
    made = []
    monkeypatch.setattr(components, "stored", lambda df, purpose: made.append(purpose) or stored(df, purpose))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = [(a, b) for a, b in links if None not in (a, b) and a != b]
    assert got == roots(linked, {n for link in linked for n in link})
    # No round is made only to see that nothing moves.
    assert made.count("stars") == rounds



def test_near_duplicates(corpus):
    df, rows = corpus
    got = by_id(near_dup.query(df))
    sets = {}
    for i, text, *_ in rows:
        w = SPACE_WORD.findall((text or "").translate(LOWERED))
        sets[i] = frozenset(tuple(w[a : a + 4]) for a in range(max(len(w) - 3, 1))) if w else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = roots(links, sets)
    assert {i: (r.n_shingles, r.component_id, r["kept"]) for i, r in got.items()} == {i: (len(s), component[i], component[i] == i) for i, s in sets.items()}


def test_pipeline_drops_short_copies(spark):
    """Of short copies one stays; empty texts and texts of other words all do."""
    texts = ["Die tz.", "die TZ.", "Die tz.", "Die", "one two three four", "one two three four", "one two three four five", "", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {0, 3, 4, 6, 7, 8, 9}


def test_shards(corpus):
    df, rows = corpus
    out = sharding.query(df).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    sizes, where = defaultdict(int), defaultdict(set)
    slots = defaultdict(list)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r["size"]
        where[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_differencing_is_tight():
    rng = np.random.default_rng(2)
    piles = np.zeros((3000, 8), np.int64)
    piles[:, 0] = rng.integers(1, 9000, 3000)
    totals = np.zeros(8, np.int64)
    np.add.at(totals, sharding.difference(piles)[:, 0], piles[:, 0])
    assert totals.sum() == piles.sum() and totals.max() - totals.min() <= 2


def test_column_wise_transform():
    rng = random.Random(3)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(10))) for _ in range(rng.randrange(1, 7))]
        transform, common = repeats_bwt.collection_transform(strings)
        string, start = repeats_bwt.suffix_rows(transform, np.array([len(s) for s in strings]))
        want = sorted((strings[i][j:], i, j) for i in range(len(strings)) for j in range(len(strings[i]) + 1))
        assert [(strings[i][j:], i, j) for i, j in zip(string, start)] == want
        for r in range(1, len(want)):
            a, b = want[r - 1][0], want[r][0]
            assert common[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_byte_repeats(corpus, monkeypatch):
    df, rows = corpus
    # Low enough that the shared passage takes the way for anchors of many variants.
    monkeypatch.setattr("barograph.llm.anchors.VARIANTS", 4)
    got = by_id(repeats_bwt.query(df))
    seen = set()
    for i, text in sorted({(i, t or "") for i, t, *_ in rows}):
        raw = text.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone[a : a + 100] = b"\x01" * 100
            seen.add(raw[a : a + 100])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        assert tuple(got[i])[1:] == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("variants", [4, 200])
def test_passage_repeats(corpus, monkeypatch, variants):
    df, rows = corpus
    monkeypatch.setattr("barograph.llm.anchors.VARIANTS", variants)
    got = by_id(repeats_fm.query(df))
    seen = set()
    for i, text in sorted({(i, t or "") for i, t, *_ in rows}):
        w = SPACE_WORD.findall(text)
        gone, own = [False] * len(w), set()
        for a in range(len(w) - 49):
            if tuple(w[a : a + 50]) in seen:
                gone[a : a + 50] = [True] * 50
            own.add(tuple(w[a : a + 50]))
        seen |= own
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert tuple(got[i])[1:] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_matching_statistics_against_search(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        monkeypatch.setattr(repeats_fm, "LENGTH", rng.randrange(1, 5))
        parts = [np.array([rng.randrange(3) for _ in range(rng.randrange(1, 12))], np.uint64) for _ in range(rng.randrange(1, 8))]
        docs = np.array([rng.randrange(4) for _ in parts])
        row, start, end = repeats_fm.solve([p.tobytes() for p in parts], docs, np.zeros(len(parts)))
        got = {(int(r), p) for r, s, e in zip(row, start, end) for p in range(s, e)}
        n, least = repeats_fm.LENGTH, {}
        windows = [(i, a, tuple(p[a : a + n])) for i, p in enumerate(parts) for a in range(len(p) - n + 1)]
        for i, _, w in windows:
            least[w] = min(least.get(w, 9), docs[i])
        assert got == {(i, q) for i, a, w in windows if least[w] < docs[i] for q in range(a, a + n)}


def test_toxicity_learns_and_ignores_other_columns(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        w = words(rng, 40, 300)
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = by_id(toxicity.query(docs, labels))
    held = [(r.predicted, rows[i][2]) for i, r in got.items() if i < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score and got[1000].predicted == 0


def test_thresholds_see_the_true_share_of_classes(spark, monkeypatch):
    """A sample capped per class sets the threshold as one that is not capped."""
    rng = np.random.default_rng(14)
    toxic = np.arange(2000) % 10 == 0
    logits = rng.normal(toxic * 2.0, 1.0)
    whole = toxicity._threshold(logits, toxic.astype(float), np.ones(2000))
    drawn = toxic | (rng.random(2000) < 200 / 1800)
    weights = np.where(toxic[drawn], 1.0, (~toxic).sum() / (~toxic & drawn).sum())
    even = toxicity._threshold(logits[drawn], toxic[drawn].astype(float), np.ones(drawn.sum()))
    weighted = toxicity._threshold(logits[drawn], toxic[drawn].astype(float), weights)
    assert abs(weighted - whole) < 0.4 < abs(even - whole)

    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    docs = spark.createDataFrame([(i, f"w{i} some words here") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "doc_id long, toxic int")
    taken, totals = toxicity.drawn(docs, labels, lambda doc: doc >= 0)
    rows, language, marks = toxicity.arrays(taken.collect())
    assert (len(rows), int(marks.sum()), totals) == (60, 30, (360, 40))
    monkeypatch.setattr(toxicity, "_threshold", lambda logits, toxic, weights: float((toxic * weights).sum() / weights.sum()))
    assert abs(toxicity.train(rows, language, marks, totals).thresholds[0] - 0.1) < 0.01


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """More documents, and longer ones, than a trial sample has; several shards."""
    monkeypatch.setattr(toxicity, "SAMPLE", 3)
    monkeypatch.setattr(toxicity, "SHARD", 60)
    rng = random.Random(16)
    rows = []
    for i in range(200):
        w = words(rng, 2100, 300)
        if i % 4 == 0:
            w[rng.randrange(2100)] = "vile"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(999, 1), (3, 1)], "doc_id long, toxic int")
    teaching = {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 and i != 3}
    known = toxicity.labelled(docs, labels, toxicity.in_training)
    assert {r._doc: r._toxic for r in known.collect()} == teaching
    for toxic in (0, 1):
        assert sorted(r._place for r in known.filter(f"_toxic = {toxic}").collect()) == list(range(sum(y == toxic for y in teaching.values())))
    row = int(toxicity._hash_words("vile")[0]) & (toxicity.TABLE - 1)
    assert toxicity._counted(known)[:, row].tolist() == [0, sum(teaching.values())]
    got = by_id(toxicity.query(docs, labels))
    assert sum(got[i].predicted == y for i, _, y in rows) >= 0.95 * len(rows)
    assert by_id(toxicity.query(docs.repartition(5), labels.repartition(3)))[1].score == pytest.approx(got[1].score, rel=1e-4)


def test_equal_logits_are_on_one_side():
    logits, toxic = np.array([2.0, 1.0, 1.0, 0.0]), np.array([1, 0, 1, 0])
    assert toxicity._threshold(logits, toxic, np.array([1, 1, 5, 9])) == 0.5
    assert toxicity._threshold(logits, toxic, np.array([9, 9, 1, 9])) == 1.5


def test_toxicity_without_labels(spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.query(corpus[0], labels).collect()} == {0}


def test_secrets(spark):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    ordinary = ["".join(rng.choice(["an", "er", "ing", "the", "on"]) for _ in range(12)) for _ in range(300)]
    odd = ["".join(rng.choice(b64) for _ in range(44)) for _ in range(20)]
    texts = [f"see {w} here" for w in ordinary] + [f"key {t} end" for t in odd]
    texts += [None, "", "é😀 Password : 'abcdef' x", "secret: token: abcdef123", "token=abc", "AKIA" + "A" * 16, "AKIAabc", "f" * 24 + "g" + "0" * 23, "apikey=" + "a1" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(secrets.query(df))
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for i, text in enumerate(texts):
        found = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    random_found = {i for i, r in got.items() if "random" in r.spans}
    assert len(random_found & set(range(300, 320))) >= 18 and not random_found & set(range(300))


def test_secrets_without_long_words(spark):
    """Random tokens are found where the table has no long words of letters, even alone; patterned ones are not."""
    rng = random.Random(15)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    odd = ["".join(rng.choice(b64) for _ in range(44)) for _ in range(20)]
    regular = ["ab1" * 15, "a" * 40 + "1", "1234567890" * 4, "-_" * 20, "user_name_of_the_user_of_the_other_name_1"]
    texts = [f"key {t} end" for t in odd + regular]

    def found(listed):
        return {r.doc_id for r in secrets.query(spark.createDataFrame(list(enumerate(listed)), "doc_id long, text string")).collect() if "random" in r.spans}

    got = found(texts)
    assert len(got & set(range(20))) >= 18 and not got - set(range(20))
    assert found(texts[:1]) == {0}


def names(rng):
    """Ordinary tokens, each built in another way."""
    stock = "garden river monthly invoice winter analysis python network station museum concert kitchen solar engine bridge meadow".split()
    some = [rng.choice(stock) for _ in range(rng.randrange(4, 7))]
    dated = f"{some[0]}-{rng.randrange(1999, 2025)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}-{some[1]}"
    return ["/".join(some), "_".join(some), "".join(w.capitalize() for w in some), "-".join(some), dated, "".join(some)]


@pytest.mark.parametrize("ordinary,random_ones", [(120, 30), (600, 10), (100, 0), (0, 1)])
def test_few_reported_tokens_are_ordinary(spark, ordinary, random_ones):
    """Of what is reported a tenth at most is ordinary, and nine of ten random tokens are, whatever the mixture."""
    rng = random.Random(ordinary)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = [t for _ in range(ordinary) for t in names(rng)] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(24, 41))) for _ in range(random_ones)]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string")
    got = {r.doc_id for r in secrets.query(df).collect() if "random" in r.spans}
    wrong = sum(i < 6 * ordinary for i in got)
    assert wrong <= 0.1 * len(got) and len(got) - wrong >= 0.9 * random_ones


def p_random(token):
    """The battery in numpy."""
    bare = token.rstrip("=").replace("-", "+").replace("_", "/")
    lower, upper, digits = secrets.LOWER, secrets.UPPER, secrets.DECIMAL
    tried = [digits, secrets.HEX_LOWER, secrets.HEX_UPPER, lower, upper, secrets.BASE32, secrets.BASE36, upper + lower, secrets.BASE64]
    alphabet = next(x for x in tried if set(bare) <= set(x))
    v, k, n = np.array([alphabet.index(c) for c in bare], float), len(alphabet), len(bare)

    def to_normal(chi, df):
        return ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))

    z = [max(to_normal(k / n * sum(bare.count(c) ** 2 for c in set(bare)) - n, k - 1), 0)]
    kinds = [upper, lower, "".join(set(secrets.BASE64) - set(upper + lower))]
    expected = [sum(c in x for c in alphabet) / k * n for x in kinds]
    found = [sum(c in x for c in bare) for x in kinds]
    own = sum(e > 0 for e in expected)
    z.append(max(to_normal(sum((f - e) ** 2 / e for f, e in zip(found, expected) if e), own - 1), 0) if own > 1 else 0)
    high = v * 2 >= k
    runs, h = 1 + int((high[1:] != high[:-1]).sum()), int(high.sum())
    mean = 2 * h * (n - h) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    z.append((runs - mean) / math.sqrt(variance) if variance > 0 else 9.0)
    spread = ((v - v.mean()) ** 2).sum()
    z.append(((v[1:] - v.mean()) * (v[:-1] - v.mean())).sum() / spread * math.sqrt(n) if spread else 9.0)
    x = to_normal(sum(y * y for y in z), 4 if own > 1 else 3)
    return 1 - 1 / (1 + math.exp(-1.5976 * x - 0.070566 * x**3))


def test_randomness_against_numpy(spark):
    rng = random.Random(12)
    tokens = [t for _ in range(8) for t in names(rng)] + ["a" * 20, "1" * 25 + "==", "0123456789" * 3, "deadbeef" * 4, "ABCDEF012345" * 2, "ABCDEFGHIJKLMNOPQRSTUVWX"]
    for alphabet in (secrets.LOWER, secrets.HEX_LOWER, secrets.BASE32, secrets.BASE36, secrets.BASE64, secrets.UPPER + secrets.LOWER):
        tokens += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    got = {r.token: r.p_random for r in secrets.randomness(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == pytest.approx({t: p_random(t) for t in tokens}, abs=1e-9)


def test_decoys_are_like_their_tokens(spark):
    rng = random.Random(13)
    tokens = spark.createDataFrame([(t,) for _ in range(5) for t in names(rng)], "token string")
    words = secrets._words(tokens)
    assert {"garden", "river"} & set(words) and len(words) <= len(secrets.COMMON.split()) + secrets.PIECES
    made = [r.token for r in secrets.decoys(tokens, words).collect()]
    own = [r.token for r in tokens.collect()]
    assert sorted(map(len, made)) == sorted(n for t in own for n in [len(t)] * secrets.DECOYS)
    assert sum(t.isalpha() for t in made) >= sum(t.isalpha() for t in own) * secrets.DECOYS


def test_personal_data(spark):
    rng = random.Random(9)
    texts = ["x a@b.c_d@e.f, 1.2.3.4.5.6.7.8 300.1.1.1 a@b..c 4111 1111 1111 1111", "+1 (377) 555-0271 +12 3 4", "é😀 q@r.st 1.2.3.4", "\x01\x02 a\x02b@c\x02d", None, "", "a" * 5000 + "@" + "b." * 3000 + "c"]
    texts += ["".join(rng.choice("ab1234567890.-+@ ()_ 4") for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.query(df))

    def digits(m):
        return re.sub("[^0-9]", "", m)

    def luhn(m):
        return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(digits(m)[::-1])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for i, text in enumerate(texts):
        found = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text


def test_terms_that_disclose(spark):
    near = [(i, f"filler number {i} writes Zanzibar beside ann@example.org today") for i in range(3)]
    rest = [(10 + i, f"plain words beside today number {i}") for i in range(30)]
    df = spark.createDataFrame(near + rest, "doc_id long, text string")
    got = by_id(pii.query(df))
    text = near[0][1]
    s = text.index("Zanzibar")
    assert f"term:{s}:{s + 8}" in got[0].spans and "today" not in [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[0].spans.split(",")]


def test_copies_do_not_hide_terms(spark):
    """A text copied often counts once, in the term's figure as in the others."""
    texts = [f"text {i} has Zanzibar beside ann@example.org today" for i in range(2)]
    rest = [f"plain words beside today number {i}" for i in range(60)]
    rows = list(enumerate(texts + rest)) + [(100 + i, texts[0]) for i in range(200)]
    got = by_id(pii.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    s = texts[0].index("Zanzibar")
    assert all(f"term:{s}:{s + 8}" in got[i].spans for i in (0, 1, 100, 299))


def test_terms_far_from_the_entity(spark):
    """A term counts anywhere in a text with the entity, and is marked in texts without it; against brute force."""
    rng = random.Random(13)
    mails = [f"user{k}@host{k}.org" for k in range(6)]
    names = [f"{w}heim" for w in ("Alten", "Brocken", "Crailen", "Düren", "Enzen", "Falken")]
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = []
    for i in range(200):
        w = rng.choices(plain, k=60)
        if i < 24:
            w = [names[i % 6], *w, mails[i % 6], "and", names[i % 6].upper()]
        elif i < 28:
            w[30] = names[i % 6]
        texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(300 + i, texts[i % 3]) for i in range(30)] + [(400, None), (401, None), (402, "")]
    got = by_id(pii.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    unique = {t for _, t in rows if t is not None}
    mail = re.compile(r"user\d@host\d\.org")
    blanked = {t: mail.sub(lambda m: " " * len(m[0]), t) for t in unique}
    held = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", blanked[t])} for t in unique}
    of = defaultdict(set)
    for t in unique:
        for x in [*held[t], *mail.findall(t)]:
            of[x].add(t)
    telling = set()
    for m in mails:
        for w in {w for t in of[m] for w in held[t]}:
            both = len(of[m] & of[w])
            if both >= 2 and np.log2(len(unique) * both / (len(of[w]) * len(of[m]))) >= 0.8 * np.log2(len(unique) / len(of[m])):
                telling.add(w)
    assert telling == {n.lower() for n in names}
    for i, t in rows:
        t = t or ""
        want = [(m.start(), f"email:{m.start()}:{m.end()}") for m in mail.finditer(t)]
        want += [(m.start(), f"term:{m.start()}:{m.end()}") for m in re.finditer(r"[^\W\d_]{4,}", blanked.get(t, "")) if m[0].lower() in telling]
        assert got[i].spans == ",".join(x for _, x in sorted(want)), i


def test_decontamination(spark, corpus):
    df, rows = corpus
    texts = {i: t for i, t, *_ in rows}
    long = SPACE_WORD.findall(texts[3 + 7 * 5])
    items = [(1, " ".join(long[:25])), (2, " ".join(long[5:18]).upper()), (10, "one TWO"), (11, ""), (12, None), (13, "w5"), (14, "absent words of no text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.query(df, bench))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(LOWERED))
        for a in range(max(len(w) - 9, 1)):
            if w:
                windows[tuple(w[a : a + 10])].add(item)
    for i, text in texts.items():
        w = word.findall((text or "").translate(LOWERED))
        hit, named = set(), set()
        for k, of in windows.items():
            for a in range(len(w) - len(k) + 1):
                if tuple(w[a : a + len(k)]) == k:
                    hit.update(range(a, a + len(k)))
                    named |= of
        joined = ",".join(sorted(map(str, named)))
        assert tuple(got[i])[1:] == (len(w), len(hit), len(named), hashlib.sha256(joined.encode()).hexdigest(), bool(hit))


def test_vectors(spark):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.12 * rng.standard_normal(16)).tolist(), i % 2 if i % 11 else None) for i in range(300)]
    rows += [(400, rows[1][1], rows[1][2]), (401, rows[1][1], rows[1][2]), (402, [0.0] * 16, 1), (403, None, 1), (404, [float("nan")] * 16, 1), (405, [1.0, None], 0), (406, [], 1)]
    got = {r.vec_id: r for r in vectors.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a in usable for b in usable if a != b and label[a] == label[b] and usable[a] @ usable[b] >= 0.93]
    component = roots(links, [r[0] for r in rows])
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in links), component[i], component[i] == i)


def test_crowded_vectors(spark, monkeypatch):
    """Crowds of near copies several times larger than the window, in two labels, one with a second crowd."""
    monkeypatch.setattr(vectors, "WINDOW", 32)
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(vectors, "CROWD", 8, raising=False)
    monkeypatch.setattr(vectors, "CELL", 200, raising=False)
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((2, 32))
    crowd = [(centres[k] + rng.uniform(0.1, 0.3) * rng.standard_normal(32), 0) for k in (0, 0, 0, 1) for _ in range(200)]
    crowd += [(centres[0] + 0.2 * rng.standard_normal(32), 1) for _ in range(150)]
    spread = [(rng.standard_normal(32), i % 3) for i in range(600)]
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate([*crowd, *spread])]
    rows += [(5000, rows[0][1], 0), (5001, rows[0][1], 0)]
    got = {r.vec_id: r for r in vectors.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, labels = np.array([i for i, *_ in rows]), np.array([y for *_, y in rows])
    linked = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    component = roots([(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked)) if i < j], ids)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(linked[k].sum()) - 1, component[i]) for k, i in enumerate(ids)}


def test_dense_label(spark, monkeypatch):
    """Vectors that all share most signs while few of them link: at least nine of ten links are found, and none too many."""
    monkeypatch.setattr(vectors, "WINDOW", 32)
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(vectors, "CELL", 500)
    rng = np.random.default_rng(16)

    def around(units, cosine):
        aside = rng.standard_normal(units.shape)
        aside -= (aside * units).sum(axis=1, keepdims=True) * units
        return cosine * units + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)

    middle = np.eye(64)[:1]
    base = around(np.repeat(middle, 3000, 0), np.sqrt(0.87))
    x = np.concatenate([base, around(base[:150], 0.95), rng.standard_normal((500, 64))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in vectors.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= vectors.COSINE).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() and links.sum() > 300 and links.max() < 64


@pytest.mark.parametrize("query", [repeats_bwt.query, repeats_fm.query])
def test_shared_anchors_without_shared_windows(spark, query):
    rng = random.Random(1)
    run = " ".join(f"r{i}" for i in range(12))
    rows = [(i, " ".join([*words(rng, 60, 10**6), run, *words(rng, 60, 10**6)])) for i in range(6)]
    got = query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0] * 6


def test_packing(corpus):
    df, rows = corpus
    out = packing.query(df).collect()
    tokenizer = packing.word_ids(packing.TOKENIZER).tokenizer
    texts = {i: t or "" for i, t, *_ in rows}
    want = []
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in out) == sorted(want) and texts
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]]).tolist()[:-1] and sum(n for _, n in parts) <= 2048
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // 2048) + 1


def test_special_words_are_tokenised_whole():
    known = packing.WordIds(packing.TOKENIZER)
    texts = ["It's 12.5% of <|endoftext|> café́ ÉCOLE, İstanbul İ, ΣΑΣ. a b\x1cc d don't.", "x,", ".,", "日本語 テスト。", "A.B. C,", None, "~ a~ ~~ B~,", "état. ÉTAT, État"]
    want = [np.array([*known.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert list(packing.token_bytes(pa.array(texts), known)) == want
    assert [next(packing.token_bytes(pa.array([t], pa.string()), packing.word_ids(packing.TOKENIZER))) for t in texts] == want


def test_packing_bounds_every_task(spark, monkeypatch):
    # No two of these documents share a sequence, so no round saves one, however many bins a task takes.
    rng = random.Random(5)
    rows = [(i, "a " * rng.randrange(1100, 1900)) for i in range(600)]
    monkeypatch.setattr(packing, "MOST", 64)
    tasks = []
    monkeypatch.setattr(packing, "stored", lambda df, purpose: tasks.append(df.rdd.getNumPartitions()) or stored(df, purpose))
    out = packing.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.sequence_id for r in out}) == len(out) == 600 and tasks[-1] == 10


@pytest.mark.parametrize("run", [near_dup.query, sharding.query, repeats_bwt.query, repeats_fm.query, secrets.query, pii.query, packing.query])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_empty_other_tables(spark, empty, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.query(empty, none).count() == 0
    assert {r.contaminated for r in decontaminate.query(corpus[0], none).collect()} == {False}
    assert vectors.query(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert toxicity.query(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
