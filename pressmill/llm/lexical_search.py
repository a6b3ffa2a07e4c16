"""Ranked lexical search with per-term geometric blocking: exact top documents of each query.

1. One pass over whole texts writes each document's length and its counts of the query terms (a vector); the corpus's
   counts (documents, terms, documents of a term) are aggregates of that.
2. Tasks take documents in shards of bounded size.  In a shard, every query term's posting list is cut into blocks of
   similar documents: evenly spread members are the centres, each document goes to the centre that its projected vector is
   nearest to.  A block's summary is the greatest impact of each term among its documents.
3. A query's weights times a summary are an upper bound of the score of every document in the block.  Blocks are taken by
   bound, highest first; a block is skipped only if its bound is below the worst score that can still be ranked.  Documents
   of the other blocks are scored in full, each once.  A document with a positive score stands in the list of a query term,
   and is missed only if its score is below a score that ``k`` others reach, so the result is exact.
4. The same search over the vectors of every 64th document (by hash) comes first: the k-th best score there is a floor for
   all tasks, so a query's candidates are some 64 * k rows at any size of the corpus.

All arithmetic is in 64-bit integers but the weights, which are logarithms rounded down once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import int_column, released, written

#: Terms: letters, digits and what lies beyond ASCII; A-Z in lower case, the rest a blank.
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: Queries are taken in blocks of about this many bytes of text and so many items, each a pass over the documents.
QUERY_BYTES, QUERY_ITEMS = 256 << 10, 2048
#: Cells (documents times terms) of a shard, the least and the most documents of one, documents of a block, dimensions of
#: the projection, and the share of documents that gives the floors.
SHARD_CELLS, LEAST_SHARD, MOST_SHARD, BLOCK, DIMENSIONS, SEED_SHARE = 4 << 20, 128, 4096, 32, 24, 64
#: Places of posting lists that are summed up at a time.
POSTINGS = 20_000


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def term_vectors(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf (int32, packed) of the terms in ``index``, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        number = shared.value.get
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                tf.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(count), "doc_id long, n long, terms binary, tf binary")


def document_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each of the terms."""

    def count(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                total[np.frombuffer(x.as_buffer(), np.int32)] += 1  # a document names a term once
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in vectors.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


class Shard:
    """Posting lists of some documents, in blocks with summaries."""

    def __init__(self, doc_ids: np.ndarray, impacts: np.ndarray, block: int = BLOCK):
        self.doc_ids, self.impacts = doc_ids, impacts
        n_docs, n_terms = impacts.shape
        scale = impacts.max(0, initial=1).astype(np.float32)
        directions = np.random.default_rng(5).standard_normal((n_terms, DIMENSIONS)).astype(np.float32)
        near = (impacts / np.maximum(scale, 1)).astype(np.float32) @ directions
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), np.float32(1e-9))
        term, doc = np.nonzero(impacts.T)
        ends = np.searchsorted(term, np.arange(n_terms + 1))
        starts, first = [], np.zeros(n_terms + 1, np.int64)
        for t in range(n_terms):
            a, b = ends[t], ends[t + 1]
            own = doc[a:b]
            if b - a > block:
                centres = near[own[np.linspace(0, b - a - 1, -(-(b - a) // block)).astype(np.int64)]]
                of = (near[own] @ centres.T).argmax(1)
                order = np.argsort(of, kind="stable")
                doc[a:b] = own[order]
                edges = np.flatnonzero(np.diff(of[order], prepend=-1))
                sizes = np.diff(np.append(edges, b - a))
                for e, size in zip(edges.tolist(), sizes.tolist(), strict=True):  # a cluster of more documents is cut
                    starts.extend(range(a + e, a + e + size, block))
            elif b > a:
                starts.append(a)
            first[t + 1] = len(starts)
        self.starts, self.members, self.first = np.array(starts, np.int64), doc, first
        self.stops = np.append(self.starts[1:], len(doc))
        self.summaries = np.zeros((len(starts), n_terms), np.int32)
        row, column = np.nonzero(impacts)  # a document has few of the terms, so its terms alone are looked at
        value, before = impacts[row, column], np.searchsorted(row, np.arange(n_docs + 1))
        owner = np.repeat(np.arange(len(starts)), self.stops - self.starts)
        for i in range(0, len(doc), POSTINGS):
            own, block_of = doc[i : i + POSTINGS], owner[i : i + POSTINGS]
            size = before[own + 1] - before[own]
            at = np.repeat(before[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            np.maximum.at(self.summaries.ravel(), np.repeat(block_of * n_terms, size) + column[at], value[at])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, doc_ids) of ``best`` and this shard; none below the floor, equal scores by doc_id."""
        scores, ids = best
        blocks = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms]) if len(terms) else np.zeros(0, np.int64)
        bounds = self.summaries[np.ix_(blocks, terms)] @ weights
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        seen = np.zeros(len(self.doc_ids), bool)
        at, step = 0, 4
        while at < len(blocks):
            least = max(floor, int(scores[k - 1]) if len(scores) >= k else 0, 1)
            stop = min(at + step, int(np.searchsorted(-bounds, -least, "right")))
            if stop <= at:
                break
            rows = np.concatenate([self.members[self.starts[b] : self.stops[b]] for b in blocks[at:stop]])
            rows = np.unique(rows[~seen[rows]])
            seen[rows] = True
            at, step = stop, step * 2
            own = self.impacts[np.ix_(rows, terms)] @ weights
            good = own >= least
            scores, ids = np.concatenate([scores, own[good]]), np.concatenate([ids, self.doc_ids[rows[good]]])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
        return scores, ids


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 50 + (50 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _candidates(vectors: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, length: int, floors: np.ndarray, k: int) -> DataFrame:
    """item (number), doc_id, score: each task's best documents of each query."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, weights, floors))

    def search(batches):
        queries, weights, floors = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        held, size = [], int(np.clip(SHARD_CELLS // max(1, len(weights)), LEAST_SHARD, MOST_SHARD))

        def settle():
            ids, n, terms, tf, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            row = np.repeat(np.arange(len(ids)), sizes)
            present, column = np.unique(terms, return_inverse=True)
            impacts = np.zeros((len(ids), len(present)), np.int32)
            impacts[row, column] = impacts_of(tf.astype(np.int64), n[row], documents, length)
            shard = Shard(ids, impacts)
            where = np.full(len(weights), -1)
            where[present] = np.arange(len(present))
            for q, terms_q in enumerate(queries):
                own = terms_q[where[terms_q] >= 0]
                best[q] = shard.search(where[own], weights[own], best[q], int(floors[q]), k)

        for batch in batches:
            ids, n = int_column(batch, "doc_id"), int_column(batch, "n")
            sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column("terms")], np.int64)
            flat = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("terms", "tf")]
            at = np.concatenate([[0], np.cumsum(sizes)])
            i = 0
            while i < len(ids):
                j = min(len(ids), i + size - sum(len(x[0]) for x in held))
                held.append([ids[i:j], n[i:j], *(x[at[i] : at[j]] for x in flat), sizes[i:j]])
                i = j
                if sum(len(x[0]) for x in held) >= size:
                    settle()
                    held.clear()
        if held:
            settle()
        for a in range(0, len(best), 256):
            some = best[a : a + 256]
            item = np.repeat(np.arange(a, a + len(some), dtype=np.int32), [len(s) for s, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([d for _, d in some])), pa.array(np.concatenate([s for s, _ in some]))], ["item", "doc_id", "score"])

    # a term of weight 0 adds nothing, and rows without doc_id can't be named
    rows = vectors.where("doc_id is not null and length(terms) > 0").select("doc_id", "n", "terms", "tf")
    found = rows.mapInArrow(released(search), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of ``docs`` (doc_id, an integer, and text) with the highest positive
    scores for each row of ``queries`` (item_id, text), equal scores by ascending doc_id.

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null has none.  A
    query's terms count once each.  Rows that repeat a doc_id, and queries that repeat an item_id, are rows of their own.
    A document without doc_id counts in the corpus's statistics but isn't ranked.  Queries or documents without terms, and
    empty tables, give no rows.
    """
    spark = docs.sparkSession
    kind = queries.schema["item_id"].dataType

    def query_terms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([sorted(set(terms_of(x.as_py()))) for x in batch.column("text")], pa.list_(pa.binary()))], ["item_id", "terms"])

    asked = queries.select("item_id", "text")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // QUERY_ITEMS), -(-(size.bytes or 0) // QUERY_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = asked.where(block == b).mapInArrow(query_terms, f"item_id {kind.simpleString()}, terms array<binary>").where("size(terms) > 0").collect()
        if not rows:
            continue
        index = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
        vectors = written(term_vectors(docs, index).where("n > 0"))
        total = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        if not total.n:
            continue
        weights = np.array([weight(total.n, int(df)) for df in document_frequencies(vectors, len(index))], np.int64)
        items = [t[weights[t] > 0] for r in rows for t in [np.array([index[bytes(x)] for x in r.terms], np.int64)]]
        floors = np.zeros(len(items), np.int64)
        seeds = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0)
        for row in _candidates(seeds, items, weights, total.n, total.length, floors, k).where(F.col("rank") == k).collect():
            floors[row.item] = row.score
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
        best = _candidates(vectors, items, weights, total.n, total.length, floors, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
