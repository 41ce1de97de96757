"""Toxicity by bags of subwords: vectors of character n-grams, averaged over a text, into a linear softmax.

Vectors and softmax are trained jointly, in numpy, on a bounded sample of labelled documents. A word's vector is the mean
of its n-grams' vectors, a text's the mean of its words' (one that occurs n times counts as sqrt(n)), so a misspelt word
that was never seen still shares most of its n-grams with the word it stands for. For scoring, each n-gram's vector is
multiplied by the softmax's weights beforehand: what tasks get is one number for each n-gram bucket.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import text_of
from orewash.scratch import written

SAMPLE = 4_000  # labelled documents of each class, at most
SAMPLE_CHARS = 20_000  # longer texts are scored, but not learnt from
BUCKETS = 1 << 17
DIMENSIONS = 4
EPOCHS = 10
LEAST_STEPS = 300  # few texts are gone through more often
LEAST_TEXTS = 5  # n-grams of fewer sampled texts keep a vector of zero
PADDING = 30  # words of zero that every text is averaged with, lest one chance word decide over a short text
BATCH = 128
RATE = 0.002
MOMENTUM = 0.8
RIDGE = 0.003  # an n-gram in this share of the sampled texts is halved by the ridge, a rarer one shrinks more
GRAMS = (4, 5, 7)
MARKS = ".,;:!?\"'()[]{}<>*#%&$-_~|/\\"
FOLDS = 5
REMEMBERED = 200_000


def grams(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word's n-grams, of the word between ends, and of the word itself."""
    whole = f"<{word.lower().strip(MARKS)}>".encode()
    found = [whole[i : i + n] for n in GRAMS for i in range(len(whole) - n + 1)]
    found.append(whole)
    return [zlib.crc32(g) % buckets for g in found]


@dataclass(frozen=True)
class Model:
    """Logit of a text: ``bias`` plus the mean over its words (and the padding) of the mean of ``weights`` over their n-grams."""

    weights: np.ndarray
    bias: float


def train(labelled: Iterable[tuple[str, int]], prior: float) -> Model:
    """Vectors and softmax fitted to (text, toxic), of which the counts of words are held. Of one class only, ``prior`` is every text's score."""
    number: dict[str, int] = {}
    gram, size, documents, toxic = array("i"), array("i"), [], []
    for text, label in labelled:
        toxic.append(label)
        words = Counter(text.split())
        for w in words:
            if number.setdefault(w, len(number)) == len(size):
                found = grams(w)
                gram.extend(found)
                size.append(len(found))
        ids = np.fromiter((number[w] for w in words), np.int32, len(words))
        documents.append((ids, np.sqrt(np.fromiter(words.values(), np.float32, len(words)))))
    number.clear()
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), logit(prior))
    gram, size = np.array(gram, np.int32), np.array(size, np.int64)
    first = np.cumsum(size) - size
    owner_of = np.repeat(np.arange(len(size)), size)
    texts_with, square = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for words_of, count in documents:
        sizes = size[words_of]
        ends = np.cumsum(sizes)
        found = gram[np.repeat(first[words_of] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        found, which = np.unique(found, return_inverse=True)
        texts_with[found] += 1
        square[found] += np.bincount(which, np.repeat(count / (count.sum() + PADDING) / sizes, sizes), len(found)) ** 2
    # Only n-grams with a vector of their own go on; a word is still averaged over all that it has.
    held = texts_with[gram] >= LEAST_TEXTS
    gram, owner_of = gram[held], owner_of[held]
    of_all, size = size, np.bincount(owner_of, minlength=len(size))
    first = np.cumsum(size) - size
    label = np.array(toxic)
    random = np.random.default_rng(7)
    vectors = random.normal(0, 0.001, (BUCKETS, DIMENSIONS)).astype(np.float32)
    vectors[texts_with < LEAST_TEXTS] = 0
    softmax = random.normal(0, 1.0, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # Steps are scaled by each n-gram's curvature and by the ridge, which is set at the curvature of a typical n-gram.
    seen = texts_with >= LEAST_TEXTS
    square /= len(documents)
    ridge = RIDGE * float(np.median(square[seen] * len(documents) / texts_with[seen])) if seen.any() else 1.0
    scale = (1 / (square + ridge))[:, None].astype(np.float32)
    moved = np.zeros_like(vectors)
    share = label.mean()
    weight = np.where(label == 1, 0.25 / share, 0.75 / (1 - share)).astype(np.float32)
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(documents))):
        order = random.permutation(len(documents))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            lengths = np.array([len(documents[r][0]) for r in rows])
            used, word = np.unique(np.concatenate([documents[r][0] for r in rows]), return_inverse=True)
            doc = np.repeat(np.arange(len(rows)), lengths)
            count = np.concatenate([documents[r][1] for r in rows])
            total = np.bincount(doc, count, len(rows))
            part = (count / (total[doc] + PADDING)).astype(np.float32)
            sizes = size[used]
            ends = np.cumsum(sizes)
            mine = gram[np.repeat(first[used] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
            owner = np.repeat(np.arange(len(used)), sizes)
            # Forward: n-grams to words to texts to classes.
            words = np.stack([np.bincount(owner, vectors[mine, d], len(used)) for d in range(DIMENSIONS)], 1) / of_all[used][:, None]
            bags = np.stack([np.bincount(doc, part * words[word, d], len(rows)) for d in range(DIMENSIONS)], 1)
            scores = bags @ softmax + bias
            scores -= scores.max(1, keepdims=True)
            error = np.exp(scores)
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(rows)), label[rows]] -= 1
            error *= weight[rows][:, None] / len(rows)
            # Backward, the same way.
            to_bags = error @ softmax.T
            to_words = np.stack([np.bincount(word, part * to_bags[doc, d], len(used)) for d in range(DIMENSIONS)], 1) / of_all[used][:, None]
            to_vectors = np.stack([np.bincount(mine, to_words[owner, d], BUCKETS) for d in range(DIMENSIONS)], 1)
            moved = MOMENTUM * moved - RATE * scale * (to_vectors + ridge * vectors)
            vectors += moved
            softmax -= RATE * (bags.T @ error)
            bias -= RATE * error.sum(0)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def held_out(folds: int = FOLDS):
    """Whether a document is kept from learning; without a doc_id it is."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labels outside the held-out fold, from at most ``sample`` documents of each class.

    The sample is taken in the order of a hash of doc_id. Labels that are null say nothing; a document labelled more than
    once is toxic if any label says so; of a doc_id that several rows share, the text of smallest hash is learnt from.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(sample).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(sample))
    fitting = docs.select("doc_id", text_of().alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    # One row for each doc_id, so at most 2 * sample in all; they stream to the driver and are counted there one by one.
    one = fitting.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = written(one.orderBy("doc_id"), "toxicity-sample").orderBy("doc_id").toLocalIterator()
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return train(((r["text"], r["toxic"]) for r in rows), prior)


class Scorer:
    """Scores texts in a task, remembering what words amount to."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        weights = self.model.weights
        found = grams(word, len(weights))
        value = self.known[word] = sum([weights.item(g) for g in found]) / len(found)
        return value

    def score(self, text: str) -> float:
        known, words = self.known, Counter(text.split())
        values = [known[w] if w in known else self.word(w) for w in words]
        counts = np.sqrt(np.fromiter(words.values(), np.float64, len(words)))
        z = self.model.bias + float(counts @ np.array(values, np.float64)) / (float(counts.sum()) + PADDING)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text. Null and empty texts get the model's bias alone.

    All columns are kept; a column called ``out`` is replaced. The model has a fixed number of weights, which all tasks get.
    """
    kept = docs.drop(out)
    weights, bias = model.weights.tobytes(), model.bias
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Scorer(Model(np.frombuffer(sent.value, np.float32), bias))
        for batch in batches:
            texts = batch.column("text")
            found = [by.score(str(t.as_buffer(), "utf-8") if t.is_valid else "") for t in texts]
            yield batch.append_column(out, pa.array(found, pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(add, f"{schema}, `{out}` double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents with ``score`` and ``predicted`` (1 from a score of 0.5), by a model fitted to ``labels``.

    Labels serve learning alone. Without labels of both classes every score is the share of toxic labels (nearly 0 if
    there are none). Whole texts are scored, however long; null and empty ones get the model's bias alone. No documents
    give no rows; repeated rows get the same score. Other columns are kept; ones called score or predicted are replaced.
    """
    return score(docs, fit(docs, labels, sample)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
