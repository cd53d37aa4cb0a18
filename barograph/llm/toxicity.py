"""A convolutional text classifier for toxicity, trained on all labelled documents.

Every word is the sum of hashed embeddings: of the word itself and of its first
letters, so that a compound is known by its beginning. Filters of several widths
run over the words, the maximum of each over the whole text is its feature, and a
logistic layer weighs the features. Document counts of the word parts, all passes of
the training and the thresholds read every labelled document whole: shards of them
are learnt in parallel, and Spark averages their models after each pass. Thresholds
are set per language on a fifth that training does not see. The language is guessed
from the function words of the text; no column but the text takes part in a score.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm import textbytes
from barograph.llm.common import batches_of, extended, lean, numbered, release, stored

#: A trial sample (``drawn``, not used by ``fit``): documents of each class, and words of a document to be in it.
SAMPLE = 3000
SAMPLE_WORDS = 2000
#: Embeddings are hashed into so many rows; each sample word part with fewer documents stays zero.
TABLE = 1 << 18
LEAST_DOCS = 2
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of the word beginnings that have embeddings.
PREFIXES = (4, 5, 6, 7, 8)
#: Passes over few documents, and over many.
EPOCHS = 12
PASSES = 4
BATCH = 64
#: Documents of a shard, which one task learns in one pass; there are as many shards as that takes.
SHARD = 4096
#: Every so manieth document of a class sets thresholds.
HELD = 5
#: Steps of a logit in which documents are counted for the thresholds, and the largest one.
GRID = 64
LARGEST = 64
RATE = 0.02
DECAY = 1e-4
CHUNK = 1 << 18
#: Words of the documents that thresholds are set on, looked at at a time.
SLICE = 1 << 16
#: Everything but letters and digits separates words; A-Z count as a-z.
SEPARATOR = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
#: Function words by which the language of a text is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be this",
    "de": "der die und das den von zu mit sich des auf ist nicht ein eine dem",
    "fr": "le la les et des du est pour que dans un une sur pas par avec",
    "es": "el los las del se por con una su para es al lo como y o",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _hash_words(text: str) -> np.ndarray:
    raw = text.encode()
    return textbytes.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), True, SEPARATOR)[2]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the parts of every word, the first word of each text, and guessed languages."""
    starts, ends, words, owner, begun = textbytes.words(data, offsets, True, SEPARATOR, PREFIXES)
    rows = np.empty((len(words), 1 + len(PREFIXES)), np.int32)
    rows[:, 0] = words & np.uint64(TABLE - 1)
    for k, (size, hashes) in enumerate(zip(PREFIXES, begun), 1):
        # A word no longer than the beginning is known whole.
        rows[:, k] = np.where(ends - starts > size, (hashes >> np.uint64(7 * k)) & np.uint64(TABLE - 1), np.uint64(TABLE))
    votes = np.zeros((len(owner) - 1, len(LANGUAGES)), np.int64)
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        hit = np.concatenate([[0], np.cumsum(np.isin(words, _hash_words(listed)))])
        votes[:, k] = hit[owner[1:]] - hit[owner[:-1]]
    language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES) - 1)
    return rows, owner, language


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: float
    #: Logit per language at which a text counts as toxic.
    thresholds: np.ndarray

    def pooled(self, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Features per text and the place of each maximum; a text without words has zeros."""
        texts = len(owner) - 1
        x = np.zeros((len(rows), DIM), np.float32)
        for k in range(rows.shape[1]):
            x += self.embedding[rows[:, k]]
        wide = np.concatenate([x, np.zeros((max(WIDTHS), DIM), np.float32)])
        text = np.repeat(np.arange(texts), np.diff(owner))
        last = owner[1:][text]
        has = np.flatnonzero(np.diff(owner))
        out, places = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32), []
        for k, (width, filters, bias) in enumerate(zip(WIDTHS, self.filters, self.bias)):
            values = np.zeros((len(x), FILTERS), np.float32)
            for j in range(width):
                # Words behind the end of the text count as zero.
                part = wide[j : j + len(x)] if j == 0 else wide[j : j + len(x)] * (np.arange(len(x)) + j < last)[:, None]
                values += part @ filters[j * DIM : (j + 1) * DIM]
            values = np.maximum(values + bias, 0)
            if len(has):
                top = np.maximum.reduceat(values, owner[has])
                out[has, k * FILTERS : (k + 1) * FILTERS] = top
                places.append(values)
            else:
                places.append(values)
        return out, places

    def logits(self, rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.pooled(rows, owner)[0] @ self.weights + self.offset

    def scores(self, rows: np.ndarray, owner: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the threshold of the language."""
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, owner).astype(float) - self.thresholds[language], -30, 30)))


def _empty() -> Model:
    return Model(np.zeros((TABLE + 1, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), -1.0, np.zeros(len(LANGUAGES)))


def _started(docs: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> tuple[Model, np.ndarray]:
    """The model before any step, and the table rows that learn, from documents of each class with a part and in all.

    The smoothed log-odds of each part are in the first dimension, noise in the others.
    """
    smooth = 0.5
    odds = np.log((docs[1] + smooth) / (totals[1] + 2 * smooth)) - np.log((docs[0] + smooth) / (totals[0] + 2 * smooth))
    seen = docs.sum(axis=0) >= LEAST_DOCS
    seen[TABLE] = False
    embedding = np.zeros((TABLE + 1, DIM), np.float32)
    embedding[seen] = rng.normal(0, 0.02, (int(seen.sum()), DIM))
    # Odds backed by few documents count less.
    embedding[seen, 0] += 0.3 * odds[seen] * (1 - np.exp(-docs[:, seen].sum(axis=0) / 6))
    filters = [rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters):
        f[::DIM] = np.abs(f[::DIM]) + 0.6 / w
    return Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), -2.0, np.zeros(len(LANGUAGES))), seen


class Learner:
    """A model, the moments of its gradients and the steps so far; only rows of ``seen`` learn."""

    def __init__(self, model: Model, seen: np.ndarray):
        self.model, self.seen, self.steps = model, seen, 0
        self.second = np.full(TABLE + 1, 1e-8, np.float32)
        params = self._params()
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
        self.offset_moment = np.zeros(2)

    def _params(self) -> dict[str, np.ndarray]:
        model = self.model
        return {"w": model.weights, **{f"f{k}": f for k, f in enumerate(model.filters)}, **{f"b{k}": b for k, b in enumerate(model.bias)}}

    def dense(self) -> np.ndarray:
        """All that is not a row of the table, as one vector."""
        params = self._params()
        pieces = [a.ravel() for k in params for a in (params[k], *self.moments[k])]
        return np.concatenate([*pieces, [self.model.offset], self.offset_moment]).astype(float)

    def set_dense(self, vector: np.ndarray) -> None:
        at, params = 0, self._params()
        for k in params:
            for a in (params[k], *self.moments[k]):
                a[...] = vector[at : at + a.size].reshape(a.shape)
                at += a.size
        self.model.offset = float(vector[at])
        self.offset_moment = np.array(vector[at + 1 :], float)

    def step(self, parts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step on documents given as table rows of their words."""
        model, params = self.model, self._params()
        owner = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        stacked = np.concatenate(parts)
        pooled, places = model.pooled(stacked, owner)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.offset, -30, 30)))
        error = ((p - toxic) * weight / len(parts)).astype(np.float32)
        grads = {"w": pooled.T @ error + DECAY * model.weights}
        back = error[:, None] * model.weights[None, :] * (pooled > 0)
        touched, slopes = [], []
        ends = owner[1:, None]
        for k, width in enumerate(WIDTHS):
            mine = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"f{k}"] = DECAY * model.filters[k]
            grads[f"b{k}"] = mine.sum(axis=0)
            top = np.zeros(mine.shape, np.int64)
            for d in np.flatnonzero(mine.any(axis=1)):
                top[d] = owner[d] + places[k][owner[d] : owner[d + 1]].argmax(axis=0)
            for j in range(width):
                # Windows that a text does not fill, and maxima of zero, teach nothing.
                text, of = np.nonzero((mine != 0) & (top + j < ends))
                index = stacked[top[text, of] + j]
                vectors = model.embedding[index].sum(axis=1)
                g = mine[text, of][:, None]
                np.add.at(grads[f"f{k}"][j * DIM : (j + 1) * DIM].T, of, vectors * g)
                touched.append(index.ravel())
                slopes.append(np.repeat(model.filters[k][j * DIM : (j + 1) * DIM].T[of] * g, index.shape[1], axis=0))
        self.steps += 1
        for name, g in grads.items():
            m, v = self.moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[name] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        slope = float(error.sum())
        self.offset_moment += [0.1 * (slope - self.offset_moment[0]), 0.001 * (slope**2 - self.offset_moment[1])]
        model.offset -= rate * (self.offset_moment[0] / (1 - 0.9**self.steps)) / (np.sqrt(self.offset_moment[1] / (1 - 0.999**self.steps)) + 1e-8)
        unique, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        slope_rows = np.concatenate(slopes)
        sums = np.column_stack([np.bincount(inverse, slope_rows[:, d], len(unique)) for d in range(DIM)]).astype(np.float32)
        learn = self.seen[unique]
        unique, sums = unique[learn], sums[learn]
        self.second[unique] += (sums * sums).mean(axis=1)
        model.embedding[unique] -= rate * sums / np.sqrt(self.second[unique])[:, None] * 0.2


def train(rows: list[np.ndarray], language: np.ndarray, toxic: np.ndarray, population: tuple[int, int] | None = None, seed: int = 7) -> Model:
    """A trial model of documents held in memory, given as table rows of their words; a fifth sets the thresholds.

    ``population`` has the clean and toxic documents that a sample stands for; the
    thresholds see either class in that share. Without it they see the sample's.
    ``fit`` trains on all documents of a table instead.
    """
    rng = np.random.default_rng(seed)
    n = len(rows)
    if n == 0 or toxic.min() == toxic.max():
        return _empty()
    order = rng.permutation(n)
    # The fifth for thresholds has its share of either class.
    order = np.concatenate([order[toxic[order] == 1], order[toxic[order] == 0]])
    calibrating = np.zeros(n, bool)
    calibrating[order[::HELD]] = True
    fit = np.flatnonzero(~calibrating)
    docs = np.zeros((2, TABLE + 1), np.float32)
    for i in fit:
        docs[int(toxic[i]), np.unique(rows[i])] += 1
    totals = np.array([(toxic[fit] == c).sum() for c in (0, 1)], np.float32)
    learner = Learner(*_started(docs, totals, rng))
    model, weight = learner.model, _weights(totals)[toxic.astype(int)]
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(fit)
        for at in range(0, len(shuffled), BATCH):
            batch = shuffled[at : at + BATCH]
            learner.step([rows[i] for i in batch], toxic[batch], weight[batch], RATE * (1 - epoch / EPOCHS))

    held = np.flatnonzero(calibrating)
    logits = np.concatenate(
        [model.logits(np.concatenate([rows[i] for i in some]), np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])) for some in batches_of(held, SLICE, lambda i: len(rows[i]))]
    )
    drawn = np.array([(toxic == c).sum() for c in (0, 1)], float)
    weights = ((drawn if population is None else np.array(population, float)) / drawn)[toxic[held].astype(int)]
    model.thresholds[:] = _threshold(logits, toxic[held], weights)
    for k in range(len(LANGUAGES)):
        mine = language[held] == k
        if toxic[held][mine].sum() >= 8 and (1 - toxic[held][mine]).sum() >= 8:
            model.thresholds[k] = _threshold(logits[mine], toxic[held][mine], weights[mine])
    return model


def _weights(totals: np.ndarray) -> np.ndarray:
    """Weight of a document by its class, of which either counts half."""
    return 0.5 / np.maximum(totals, 1) * totals.sum()


def _threshold(logits: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """Midway between the two logits whose cut gives the best F1, each document counted by its weight."""
    order = np.argsort(-logits, kind="stable")
    # Equal logits are on one side.
    last = np.append(np.diff(logits[order]) != 0, True)
    hits = np.cumsum(toxic[order] * weights[order], dtype=float)[last]
    f1 = 2 * hits / (np.cumsum(weights[order], dtype=float)[last] + max(hits[-1], 1e-9))
    ranked = logits[order][last]
    best = int(np.argmax(f1))
    below = ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1
    return float((ranked[best] + below) / 2)


def _marked(labels: DataFrame, usable) -> DataFrame:
    """``(_doc, _toxic)`` of the usable documents with one clear label."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").cast("int").alias("_toxic")).filter("_doc is not null")
    marks = marks.groupBy("_doc").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_most")).filter("_toxic = _most and _toxic in (0, 1)")
    return marks.filter(usable(F.col("_doc"))).select("_doc", "_toxic")


def drawn(docs: DataFrame, labels: DataFrame, usable) -> tuple[DataFrame, tuple[int, int]]:
    """For trials: at most ``SAMPLE`` labelled documents of each class, stored, and the usable documents of each.

    ``(doc, toxic, language, rows, place)``: label, language, words as table rows, and
    the hash of the id that the choice follows. Documents of more than ``SAMPLE_WORDS``
    words or without a clear label are not in it.
    """
    marks = _marked(labels, usable)
    present = marks.join(docs.select(F.col("doc_id").cast("long").alias("_doc")), "_doc", "left_semi")
    counts = {r["_toxic"]: r["count"] for r in present.groupBy("_toxic").count().collect()}
    # Twice the sample, as some documents may be too long or missing.
    chance = F.xxhash64(F.lit("sample"), F.col("_doc"))
    chosen = marks.filter("_toxic = 1").orderBy(chance).limit(2 * SAMPLE).union(marks.filter("_toxic = 0").orderBy(chance).limit(2 * SAMPLE))
    known = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(F.broadcast(chosen.select("_doc", "_toxic")), "_doc")

    def words(batches):
        for batch in batches:
            data, offsets = textbytes.flat(batch.column(1))
            for a, b in textbytes.slices(offsets, CHUNK):
                rows, owner, language = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                fits = np.diff(owner) <= SAMPLE_WORDS
                lists = [rows[owner[i] : owner[i + 1]].tobytes() for i in np.flatnonzero(fits)]
                at = pa.array(np.flatnonzero(fits) + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), pa.array(language[fits].astype(np.int32)), pa.array(lists, pa.binary())],
                    ["doc", "toxic", "language", "rows"],
                )

    found = stored(known.mapInArrow(lean(words), "doc long, toxic int, language int, rows binary"), "labelled")
    placed = found.withColumn("place", F.xxhash64(F.lit("sample"), F.col("doc")))
    first = [placed.filter(F.col("toxic") == kind).orderBy("place", "doc").limit(SAMPLE) for kind in (0, 1)]
    taken = stored(first[0].union(first[1]), "sample")
    release(found)
    return taken, (counts.get(0, 0), counts.get(1, 0))


def arrays(taken: Iterable) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Words, languages and labels of the rows of ``drawn``, in a fixed order."""
    taken = sorted(taken, key=lambda r: (r["toxic"], r["place"], r["doc"]))
    rows = [np.frombuffer(r["rows"], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in taken]
    return rows, np.array([r["language"] for r in taken], int), np.array([r["toxic"] for r in taken], np.float32)


def in_training(doc: Column) -> Column:
    """Rows that may teach: the CRC-32 of the id as text does not divide by 5."""
    return F.crc32(doc.cast("string").cast("binary")) % 5 != 0


def labelled(docs: DataFrame, labels: DataFrame, usable) -> DataFrame:
    """All usable documents with a clear label, stored: ``(_doc, _toxic, _place, text)``.

    ``_place`` numbers the documents of a class from 0, in the order of a hash.
    """
    marks = _marked(labels, usable)
    ids = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    placed = numbered(marks.join(ids.select("_doc"), "_doc", "left_semi"), ["_toxic"], ["_doc"], "_place")
    return stored(ids.join(placed, "_doc").select("_doc", "_toxic", "_place", "text"), "labelled")


def _documents(batches, toxic: str = "_toxic"):
    """Label, language and table rows of the words of each text, in order."""
    for batch in batches:
        marks = batch.column(toxic).to_numpy(zero_copy_only=False)
        data, offsets = textbytes.flat(batch.column("text"))
        for a, b in textbytes.slices(offsets, CHUNK):
            rows, owner, language = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                yield int(marks[a + i]), int(language[i]), rows[owner[i] : owner[i + 1]]


def _counted(known: DataFrame) -> np.ndarray:
    """Documents of each class with each table row."""

    def count(batches):
        docs = np.zeros((2, TABLE + 1), np.int64)
        for toxic, _, rows in _documents(batches):
            docs[toxic, np.unique(rows)] += 1
        index = np.flatnonzero(docs.any(axis=0))
        for some in np.array_split(index, 1 + len(index) // CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(docs[0, some]), pa.array(docs[1, some])], ["row", "clean", "toxic"])

    counts = known.select("_toxic", "text").mapInArrow(lean(count), "row int, clean long, toxic long")
    summed = stored(counts.groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "parts")
    found = summed.toArrow()
    release(summed)
    docs = np.zeros((2, TABLE + 1), np.float32)
    for c, name in enumerate(("clean", "toxic")):
        docs[c, found["row"].to_numpy()] = found[name].to_numpy()
    return docs


def _pass(known: DataFrame, learner: Learner, weight: np.ndarray, shards: int, epoch: int, rate: float) -> None:
    """Every shard goes on from the same model for one pass over its documents; then their models are averaged.

    A table row is averaged over the shards in which it has changed, everything else
    over all. Shards and the order within are given by hashes of the ids.
    """
    spark = known.sparkSession
    shared = spark.sparkContext.broadcast(learner)
    names = [f"v{k}" for k in range(DIM + 1)]

    def learn(batches):
        mine, before = None, shared.value
        for some in _steps(_documents(batches)):
            mine = mine or copy.deepcopy(before)
            toxic = np.array([t for t, _, _ in some])
            mine.step([rows for _, _, rows in some], toxic, weight[toxic], rate)
        if mine is not None:
            index = np.flatnonzero(mine.second != before.second).astype(np.int32)
            values = np.column_stack([mine.model.embedding[index], mine.second[index]]).astype(float)
            dense = mine.dense()
            rest = np.zeros((len(dense) + 1, DIM + 1))
            rest[:, 0] = np.append(dense, mine.steps)
            index = np.concatenate([index, np.arange(len(rest), dtype=np.int32) + TABLE + 1]).astype(np.int32)
            values = np.concatenate([values, rest])
            yield pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(DIM + 1)]], ["row", *names])

    # Of the places of a class, those that do not set thresholds, numbered without gaps.
    number = F.col("_place") - F.floor(F.col("_place") / HELD) - 1
    dealt = known.select("_toxic", "text", F.pmod(number, F.lit(shards)).cast("int").alias("_shard"), F.xxhash64(F.lit(epoch), "_doc").alias("_order"))
    dealt = dealt.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_order", "text")
    learnt = dealt.select("_toxic", "text").mapInArrow(lean(learn), f"row int, {', '.join(f'{n} double' for n in names)}")
    averaged = stored(learnt.groupBy("row").agg(*[F.avg(n).alias(n) for n in names]), "model")
    found = averaged.toArrow()
    release(averaged)
    shared.destroy()
    row = found["row"].to_numpy()
    values = np.column_stack([found[n].to_numpy() for n in names])
    of_table = row <= TABLE
    learner.model.embedding[row[of_table]] = values[of_table, :DIM]
    learner.second[row[of_table]] = values[of_table, DIM]
    dense = np.zeros((~of_table).sum())
    dense[row[~of_table] - TABLE - 1] = values[~of_table, 0]
    learner.set_dense(dense[:-1])
    # Shards differ by a step at most.
    learner.steps = round(dense[-1])


def _steps(documents: Iterable[tuple[int, int, np.ndarray]]) -> Iterable[list]:
    """Documents in lists of ``BATCH``, or of fewer with many words."""
    for some in batches_of(documents, SLICE, lambda d: len(d[2])):
        for at in range(0, len(some), BATCH):
            yield some[at : at + BATCH]


def _set_thresholds(held: DataFrame, model: Model) -> None:
    """From the number of documents by language, class and step of the logit."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        model = shared.value
        for some in batches_of(_documents(batches), SLICE, lambda d: len(d[2])):
            owner = np.concatenate([[0], np.cumsum([len(rows) for _, _, rows in some])])
            logits = model.logits(np.concatenate([rows for _, _, rows in some]), owner).astype(float)
            at = np.floor(np.clip(logits, -LARGEST, LARGEST) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in some], pa.int32()), pa.array([k for _, k, _ in some], pa.int32()), pa.array(at)], ["toxic", "language", "at"])

    judged = held.select("_toxic", "text").mapInArrow(lean(judge), "toxic int, language int, at int")
    counted = stored(judged.groupBy("toxic", "language", "at").count(), "logits")
    found = counted.toArrow()
    release(counted)
    shared.destroy()
    toxic, language, at, n = (found[c].to_numpy() for c in ("toxic", "language", "at", "count"))
    logits = (at + 0.5) / GRID
    model.thresholds[:] = _threshold(logits, toxic, n)
    for k in range(len(LANGUAGES)):
        mine = language == k
        if n[mine & (toxic == 1)].sum() >= 8 and n[mine & (toxic == 0)].sum() >= 8:
            model.thresholds[k] = _threshold(logits[mine], toxic[mine], n[mine])


def fit(docs: DataFrame, labels: DataFrame, usable=in_training, seed: int = 7) -> Model:
    """Learnt from all usable labelled documents, whole; counts, averaged models and thresholds reach the driver.

    Their size is that of the model, whatever the number of documents. Each pass reads
    all documents but the fifth that sets the thresholds; few documents get more passes.
    """
    known = labelled(docs, labels, usable)
    sizes = {(r["_toxic"], r["held"]): r["count"] for r in known.groupBy("_toxic", (F.col("_place") % HELD == 0).alias("held")).count().collect()}
    model = _empty()
    if {toxic for toxic, _ in sizes} == {0, 1}:
        totals = np.array([sizes.get((c, False), 0) for c in (0, 1)], np.float32)
        taught, held = known.filter(f"_place % {HELD} != 0"), known.filter(f"_place % {HELD} = 0")
        n = int(totals.sum())
        learner = Learner(*_started(_counted(taught), totals, np.random.default_rng(seed)))
        passes = max(PASSES, min(EPOCHS, -(-EPOCHS * SHARD // max(n, 1))))
        for epoch in range(passes if n else 0):
            _pass(taught, learner, _weights(totals), -(-n // SHARD), epoch, RATE * (1 - epoch / passes))
        model = learner.model
        _set_thresholds(held, model)
    release(known)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``toxicity`` (0 to 1) and ``toxic`` (at least 0.5) to all columns of ``docs``.

    Whole texts are scored. Null, empty and wordless texts have the score of a text
    without features. Without labels of both classes every text has the same low
    score. Repeated rows are scored alike. Extra columns stay; one named like a new
    column is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("toxicity", "toxic")
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def apply(batches):
        model = shared.value
        for batch in batches:
            data, offsets = textbytes.flat(batch.column(names.index("text")))
            scores = np.empty(len(offsets) - 1)
            for a, b in textbytes.slices(offsets, CHUNK):
                rows, owner, language = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                scores[a:b] = model.scores(rows, owner, language)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(scores >= 0.5)], [*names, "toxicity", "toxic"])

    return docs.mapInArrow(lean(apply), extended(docs.schema, "toxicity double, toxic boolean"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))
