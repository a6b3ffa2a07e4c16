"""Substring dedup of words by matching statistics on an FM-index for each shard.

Segments of documents meet in the shard of the least hash of the word runs in their windows (see ``segments``), so every
window's other places are in its own shard and no document is streamed through more than its own shards.  A shard indexes
the distinct segments that still share a hash: suffix array to the window's depth, Burrows-Wheeler transform, and a
wavelet tree of packed bit vectors with block ranks.  All windows are then streamed through a backward search in step; a
window whose interval shrinks to suffixes of one document leaves early.  The interval left after ``window`` words holds
the places of all equal windows, and the smallest document among them decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text
from .segments import WORDS, repeated_runs, with_runs


class WaveletTree:
    """Rank of a symbol before a position, for arrays of both; one packed bit vector a level, the highest bit first."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bit.dtype)]).astype(np.uint8), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)])[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            b, e = self._ones(level, begin), self._ones(level, at)
            begin = np.where(one, self.zeros[level] + b, begin - b)
            at = np.where(one, self.zeros[level] + e, at - e)
        return at - begin


class FMIndex:
    """Index of a text of numbers from 1 on, 0 separating; suffixes are ordered by their first ``depth`` numbers."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth:  # suffixes by 1, 2, 4 ... numbers, the last step to the depth itself
            step = min(span, depth - span)
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            _, rank = np.unique(rank * (n + 2) + after if rank.max(initial=0) < n else np.unique(rank, return_inverse=True)[1] * (n + 2) + after, return_inverse=True)
            span += step
        self.suffixes = np.argsort(rank, kind="stable")
        self.before = np.searchsorted(np.sort(text), np.arange(int(text.max(initial=0)) + 2))
        self.tree = WaveletTree(text[self.suffixes - 1].astype(np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more number before them."""
        return self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)


def fm_repeats(values: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that start at ``at`` equal one that belongs to a smaller document."""
    # the segments' words with a separator after each; a segment's windows are consecutive
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(group) != 0) | (np.diff(doc) != 0)]))
    end = np.append(begin[1:], len(at))
    length = at[end - 1] - at[begin] + window
    shift = np.concatenate([[0], np.cumsum(length + 1)])
    text = np.zeros(shift[-1] + window, np.int64)
    place = np.repeat(shift[:-1] - np.cumsum(length) + length, length) + np.arange(length.sum())
    source = np.repeat(at[begin] - np.cumsum(length) + length, length) + np.arange(length.sum())
    text[place] = np.unique(values[source], return_inverse=True)[1] + 1
    owner = np.full(len(text), np.iinfo(np.int64).max)
    owner[place] = np.repeat(doc[begin], length)
    start = np.repeat(shift[:-1] - at[begin], end - begin) + at

    index = FMIndex(text, window)
    in_order = owner[index.suffixes]
    changes = np.concatenate([[0], np.cumsum(np.diff(in_order) != 0)])  # equal at both ends of an interval of one document
    alive = np.arange(len(at))
    last = text[start + window - 1]
    low, high = index.before[last].astype(np.int64), index.before[last + 1].astype(np.int64)
    for depth in range(2, window + 1):
        low, high = index.extend(text[start[alive] + window - depth], low, high)
        several = changes[low] != changes[high - 1]
        alive, low, high = alive[several], low[several], high[several]
    hit = np.zeros(len(at), bool)
    if len(alive):
        least = np.minimum.reduceat(np.append(in_order, np.iinfo(np.int64).max), np.stack([low, high], 1).ravel())[::2]
        hit[alive] = doc[alive] > least
    return hit


def remove_repeated_words(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, spans (array of first, end word of removed runs) and kept (string, kept words joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Removes every word covered by a window of ``window`` words that also
    starts in a document with a smaller doc_id, as judged on the input.  Null and blank texts have no words; a text with
    fewer words than the window loses nothing; rows with one doc_id don't take from each other; a row without doc_id
    neither gives nor loses.
    """
    runs = repeated_runs(docs, WORDS, window, fm_repeats)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(batches):
        for batch in batches:
            buf, offsets = flat_text(batch.column("text"))
            runs = batch.column("runs").to_pylist()
            n_words, spans, kept = [], [], []
            for i, run in enumerate(runs):
                words = buf[offsets[i] : offsets[i + 1]].tobytes().split()
                pairs = np.frombuffer(run, np.int32).reshape(-1, 2).tolist() if run else []
                ends, starts = [0, *(b for _, b in pairs)], [*(a for a, _ in pairs), len(words)]
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in pairs])
                kept.append(b" ".join(words if not pairs else [w for a, b in zip(ends, starts, strict=True) for w in words[a:b]]))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "kept"])

    rows = with_runs(docs, runs).select("doc_id", "text", "runs")
    return rows.mapInArrow(remove, f"doc_id {kind}, n_words long, spans array<struct<start:int,end:int>>, kept string")


def removed_words_digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """remove_repeated_words() with the removed words counted and the kept words as a digest."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeated_words(docs, window).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
