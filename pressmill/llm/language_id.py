"""Language identification by inferring each document's mixture of languages.

A language is a distribution of hashed character trigrams, and gives a word the product of its trigrams' probabilities.
A document's words are draws from a mixture of languages; expectation-maximisation estimates the proportions.  Languages
enter in the order of their estimated share as long as the log-likelihood, less the Bayesian information penalty of half
the logarithm of the number of words for each further language, improves.  The documents of an Arrow batch are estimated
together in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, released
from .ngrams import WordCache, ngram_buckets, plain

#: Training takes this many documents of each language at most, the least by hash, and of each this many bytes at most.
TRAIN_DOCS, TRAIN_BYTES = 400, 20_000
BUCKETS, SMOOTHING, STEPS = 1 << 16, 0.02, 8
#: Words of a batch that are estimated together.
GROUP_WORDS = 100_000


class LanguageModel:
    def __init__(self, languages: list[str], log_probs: np.ndarray):
        self.languages, self.log_probs = languages, log_probs  # one row a language

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language; zero throughout for a word without letters."""
        letters = [plain(w) for w in words]
        gram, word = ngram_buckets(letters, (3,), BUCKETS)
        out = np.stack([np.bincount(word, self.log_probs[k][gram], len(words)) for k in range(len(self.languages))], 1)
        out[[not any(map(str.isalpha, w)) for w in letters]] = 0
        return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learns from ``docs`` (doc_id, text, lang): rows with a language and text; per language a bounded sample, of a long
    text its beginning."""
    usable = docs.where("lang is not null and octet_length(text) > 0")
    chosen = least_by_hash(usable.select("doc_id", "lang"), "lang", train_docs)

    def counts(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                gram, _ = ngram_buckets([plain(w) for w in text.lower().split()], (3,), BUCKETS)
                total[lang] = total.get(lang, 0) + np.bincount(gram, minlength=BUCKETS)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["lang", "n"])

    # a character has four bytes at most
    piece = F.when(F.octet_length("text") <= TRAIN_BYTES, F.col("text")).otherwise(F.left("text", F.lit(TRAIN_BYTES // 4)))
    sample = usable.select("doc_id", "lang", piece.alias("text")).join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")
    # the sample alone moves; rows that repeat a doc_id are one
    found = sample.groupBy("doc_id", "lang").agg(F.max("text").alias("text")).coalesce(4).mapInArrow(counts, "lang string, n binary").collect()  # 512 kB a language and task
    languages = sorted({r.lang for r in found})
    n = np.zeros((max(1, len(languages)), BUCKETS))
    for r in found:
        n[languages.index(r.lang)] += np.frombuffer(r.n, "<i8")
    n += SMOOTHING
    return LanguageModel(languages, np.log(n / n.sum(1, keepdims=True)).astype(np.float32))


def _mixture(p: np.ndarray, first: np.ndarray, share: np.ndarray, allowed: np.ndarray, steps: int) -> np.ndarray:
    """EM: p has words' likelihoods, first the documents' first words; returns the documents' shares of languages."""
    share = np.where(allowed, share, 0) + 1e-12 * allowed
    share /= share.sum(1, keepdims=True)
    n = np.diff(first)
    for _ in range(steps):
        joint = p * np.repeat(share, n, 0)
        joint /= joint.sum(1, keepdims=True) + 1e-300
        share = np.add.reduceat(joint, first[:-1], 0) / n[:, None]
    return share


def _log_likelihood(p: np.ndarray, top: np.ndarray, first: np.ndarray, share: np.ndarray) -> np.ndarray:
    each = np.log((p * np.repeat(share, np.diff(first), 0)).sum(1) + 1e-300) + top
    return np.add.reduceat(each, first[:-1])


def infer(scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of languages, and a posterior weight of the leading one against the others, of documents that all have words."""
    n_docs, n_lang = len(first) - 1, scores.shape[1]
    top = scores.max(1)
    p = np.exp(scores - top[:, None])
    alone = np.add.reduceat(scores, first[:-1], 0)
    lead = alone.argmax(1)
    share = np.zeros((n_docs, n_lang))
    share[np.arange(n_docs), lead] = 1
    against = np.exp(np.clip(alone - alone.max(1, keepdims=True), -700, 0))
    weight = 1 / against.sum(1)
    if n_lang == 1:
        return share, weight
    best = alone.max(1)
    n = np.diff(first)
    penalty = 0.5 * np.log(np.maximum(n, 2))
    # no mixture exceeds the sum of the words' best languages
    open_ = np.flatnonzero(np.add.reduceat(top, first[:-1]) - best > penalty)
    if not len(open_):
        return share, weight
    words = np.concatenate([np.arange(first[d], first[d + 1]) for d in open_])
    p, top = p[words], top[words]
    first = np.concatenate([[0], np.cumsum(n[open_])])
    full = _mixture(p, first, np.full((len(open_), n_lang), 1 / n_lang), np.ones((len(open_), n_lang), bool), STEPS)
    full[np.arange(len(open_)), lead[open_]] += 1  # the best single language enters first
    rank = np.argsort(np.argsort(-full, 1), 1)
    going, score = np.arange(len(open_)), best[open_]
    for k in range(2, n_lang + 1):
        if len(going) < len(first) - 1:
            keep = np.isin(np.arange(len(first) - 1), going)
            p, top = p[np.repeat(keep, np.diff(first))], top[np.repeat(keep, np.diff(first))]
            first = np.concatenate([[0], np.cumsum(np.diff(first)[keep])])
            open_, rank, full, score = open_[keep], rank[keep], full[keep], score[keep]
        mixed = _mixture(p, first, full, rank < k, STEPS)
        value = _log_likelihood(p, top, first, mixed) - (k - 1) * penalty[open_]
        going = np.flatnonzero(value > score)
        if not len(going):
            break
        score[going] = value[going]
        share[open_[going]] = mixed[going]
    return share, weight


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def language_mixture(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and shares (language -> proportion) for each row of ``docs`` (doc_id, text).

    lang_pred has the largest share, of equal ones the first by name; score is that share, times its posterior against the other languages alone.  A text
    that is null or has no letter is ``und`` with score 0, as is every text when no language was learned.  Rows are
    independent: repeated rows repeat their result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        model = shared.value
        names = model.languages
        cache = WordCache(model.word_scores, len(names))
        for batch in batches:
            pred, score, shares = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [{}] * batch.num_rows
            pending, size = [], 0

            def settle(pending):
                cache.rows([w for _, w in pending])
                ids = np.fromiter((cache[w] for _, words in pending for w in words), np.int64)
                first = np.concatenate([[0], np.cumsum([len(w) for _, w in pending])])
                share, weight = infer(cache.table[ids], first)
                for j, (i, _) in enumerate(pending):
                    k = int(share[j].argmax())
                    pred[i], score[i] = names[k], float(min(1.0, share[j, k] * weight[j]))
                    shares[i] = {names[x]: float(share[j, x]) for x in np.flatnonzero(share[j] > 1e-6)}

            for i, text in enumerate((x.as_py() for x in batch.column("text")) if names else []):
                if has_letters(text):
                    pending.append((i, words := text.lower().split()))
                    size += len(words)
                    if size >= GROUP_WORDS:
                        settle(pending)
                        pending, size = [], 0
            if pending:
                settle(pending)
            columns = [batch.column("doc_id"), pa.array(pred), pa.array(score), pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "shares"])

    return docs.select("doc_id", "text").mapInArrow(released(predict), f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")
