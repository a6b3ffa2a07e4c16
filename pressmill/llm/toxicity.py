"""Toxicity by bags of subwords: embeddings of character n-grams, averaged, under a linear softmax, trained jointly.

A word is the mean of the vectors of its hashed n-grams, a document the mean of its words.  The vectors and the softmax
are trained together in numpy, by Adam, on a bounded sample, so a misspelling shares the n-grams of what it misspells.
Scoring is one pass over the documents; a worker keeps each word's share of the margin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, released
from .ngrams import WordCache, ngram_buckets, plain

#: Training takes this many documents of each label at most, the least by hash, none longer than so many bytes.
TRAIN_DOCS, TRAIN_BYTES = 2000, 12_000
SIZES, BUCKETS, DIMENSIONS = (3, 4, 5), 1 << 17, 4
#: Steps of Adam, their documents, and their rate.
STEPS, BATCH, RATE = 500, 128, 0.02
#: A bucket gets a vector if so many training documents hold it; its share counts against the root of its sum of squares
#: over them, with so much of a frequent bucket's sum added, so that rare buckets don't learn single documents by heart.
LEAST_DOCS, FLOOR = 4, 0.005


class ToxicityModel:
    """margins: for each bucket, its vector's product with the difference of the two classes' weights."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins, bias

    def word_scores(self, words: list[str]) -> np.ndarray:
        gram, word = ngram_buckets([plain(w) for w in words], SIZES, BUCKETS)
        total, n = np.bincount(word, self.margins[gram], len(words)), np.bincount(word, minlength=len(words))
        return (total / np.maximum(n, 1))[:, None]


def _bags(texts: list[str], part: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, share) of the texts' buckets: the mean over a text's words of the mean over a word's n-grams."""
    docs, grams, shares = [], [], []
    for begin in range(0, len(texts), part):  # what a word's n-grams take is held for a part of the texts only
        vocabulary: dict[str, int] = {}
        own = [text.lower().split() for text in texts[begin : begin + part]]
        word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for words in own for w in words), np.int64)
        n = np.fromiter(map(len, own), np.int64)
        key, times = np.unique(np.repeat(np.arange(len(own)), n) * (len(vocabulary) + 1) + word, return_counts=True)
        doc, word = np.divmod(key, len(vocabulary) + 1)
        gram, owner = ngram_buckets([plain(w) for w in vocabulary], SIZES, BUCKETS)
        gram = gram[np.argsort(owner, kind="stable")]
        size = np.bincount(owner, minlength=len(vocabulary))
        first, each = np.cumsum(size) - size, size[word]
        at = np.repeat(first[word] - np.cumsum(each) + each, each) + np.arange(each.sum())
        key, inverse = np.unique(np.repeat(doc, each) * BUCKETS + gram[at], return_inverse=True)
        docs.append((key // BUCKETS + begin).astype(np.int32))
        grams.append((key % BUCKETS).astype(np.int32))
        shares.append(np.bincount(inverse, np.repeat(times / n[doc] / np.maximum(each, 1), each)).astype(np.float32))
    return np.concatenate(docs), np.concatenate(grams), np.concatenate(shares)


def gradients(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, bag: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, class_weight: np.ndarray):
    """Gradients of the weighted cross-entropy of a batch: for the vectors, the softmax's weights and its bias.

    bag has (document of the batch, row of vectors, value) of each entry.
    """
    doc, row, value = bag
    mean = np.stack([np.bincount(doc, value * vectors[row, k], len(y)) for k in range(vectors.shape[1])], 1)
    z = mean @ weights + bias
    z = np.exp(z - z.max(1, keepdims=True))
    error = (z / z.sum(1, keepdims=True) - np.eye(2)[y]) * class_weight[y][:, None] / len(y)
    back = error @ weights.T
    return np.stack([np.bincount(row, value * back[doc, k], len(vectors)) for k in range(vectors.shape[1])], 1), mean.T @ error, error.sum(0)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> ToxicityModel:
    """Trains on texts with labels 0 and 1; without both labels the model scores every text alike."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 4.0 if labels and labels[0] else -4.0)
    doc, gram, value = _bags(texts)
    spread = np.bincount(gram, value.astype(float) ** 2, BUCKETS)
    docs = np.bincount(gram, minlength=BUCKETS)
    known = np.flatnonzero(docs >= min(LEAST_DOCS, len(y)))
    row = np.full(BUCKETS, -1, np.int32)
    row[known] = np.arange(len(known))
    scale = np.sqrt(spread[known] + FLOOR * np.percentile(spread[docs > 0], 99)) if len(known) else np.ones(0)
    has = row[gram] >= 0
    doc, gram, value = doc[has], row[gram[has]], value[has]
    value /= scale[gram].astype(np.float32)
    first = np.searchsorted(doc, np.arange(len(y) + 1))

    rng = np.random.default_rng(seed)
    parameters = [rng.normal(0, 0.001, (len(known), DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)]
    speeds = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    class_weight = len(y) / (2 * np.bincount(y, minlength=2))
    order = np.zeros(0, np.int64)
    for step in range(STEPS):
        if len(order) < min(BATCH, len(y)):
            order = np.append(order, rng.permutation(len(y)))
        batch, order = order[:BATCH], order[BATCH:]
        n = first[batch + 1] - first[batch]
        at = np.repeat(first[batch] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = gradients(*parameters, (np.repeat(np.arange(len(batch)), n), gram[at], value[at]), y[batch], class_weight)
        rate = RATE * (1 - step / STEPS)
        for i, (p, g, (m, v)) in enumerate(zip(parameters, found, speeds, strict=True)):
            m += 0.1 * (g - m)
            v += 0.001 * ((g * g if i else (g * g).mean()) - v)  # all vectors share one, so that rare ones don't move as far as frequent ones
            p -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    vectors, weights, bias = parameters
    margins = np.zeros(BUCKETS, np.float32)
    margins[known] = vectors @ (weights[:, 1] - weights[:, 0]) / scale
    return ToxicityModel(margins, float(bias[1] - bias[0]))


def _chosen(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """doc_id, toxic of the documents to learn from: of each label the least by hash."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sized = docs.where(f"octet_length(text) between 1 and {TRAIN_BYTES}").select("doc_id")
    return least_by_hash(known.join(sized, "doc_id", "left_semi"), "toxic", train_docs)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Learns ``labels.toxic`` (0 or 1) of ``docs`` (doc_id, text) from a bounded sample of each label."""
    chosen = _chosen(docs, labels, train_docs)
    rows = docs.select("doc_id", "text").where(f"octet_length(text) between 1 and {TRAIN_BYTES}").join(F.broadcast(chosen), "doc_id")
    sample = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    return fit(list(sample.text), [int(x) for x in sample.toxic])


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) for each row of ``docs`` (doc_id, text), whole texts.

    Null and wordless texts score 0.  Rows are independent: repeated rows repeat their score, a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        model = shared.value
        cache = WordCache(model.word_scores, 1)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 200):
                bags = [x.lower().split() if x else [] for x in texts[i : i + 200]]
                cache.rows(bags)
                value = cache.table[:, 0]
                for j, bag in enumerate(bags):
                    if bag:
                        margin = value[np.fromiter(map(cache.__getitem__, bag), np.int64, len(bag))].mean() + model.bias
                        out[i + j] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(released(predict), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
