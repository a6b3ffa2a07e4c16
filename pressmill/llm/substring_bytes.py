"""Suffix-array dedup of bytes: windows of ``window`` bytes, ordered by a radix sort limited to that depth.

The first digit of a suffix is the least hash of the 12-byte runs of its window (see ``segments``): it deals the suffixes
to buckets over the cluster, and segments with equal content collapse there.  Inside a bucket the next passes take eight
bytes at a time, the most significant first; a suffix alone in its group leaves after each pass, so only suffixes that
still share their prefix are read further, and none beyond the window.  The groups left at the end are exactly the
repeated windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import BYTES, repeated_runs, with_runs


def radix_repeats(values: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that start at ``at`` equal one of their group that belongs to a smaller document."""
    padded = np.concatenate([values.astype(np.uint8, copy=False), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(values),), ">u8", padded, strides=(1,))
    alive = np.arange(len(at))
    for depth in range(0, window, 8):
        digit = eight[at[alive] + depth].astype(np.uint64)
        if window - depth < 8:
            digit >>= np.uint64(8 * (8 - (window - depth)))
        order = np.lexsort((digit, group[alive]))
        alive, digit = alive[order], digit[order]
        own = group[alive]
        new = np.ones(len(alive), bool)
        new[1:] = (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        low, high = np.minimum.reduceat(doc[alive], start), np.maximum.reduceat(doc[alive], start)
        keep = (low != high)[number]  # a group of one document has no repeat
        group = group.copy()
        group[alive] = number
        alive = alive[keep]
        if not len(alive):
            break
    hit = np.zeros(len(at), bool)
    if len(alive):
        least = np.full(group[alive].max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group[alive], doc[alive])
        hit[alive] = doc[alive] > least[group[alive]]
    return hit


def remove_repeated_bytes(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end of removed runs) and kept (binary, what remains) for each row.

    Removes every byte of ``docs.text`` (UTF-8) covered by a window that also starts in a document with a smaller doc_id,
    as judged on the input; matches never cross documents.  Null is empty; a text shorter than the window loses nothing;
    rows with one doc_id don't take from each other; a row without doc_id neither gives nor loses.  kept may cut a
    character in two.
    """
    runs = repeated_runs(docs, BYTES, window, radix_repeats)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(batches):
        for batch in batches:
            size, spans, kept = [], [], []
            for text, run in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = text or b""
                pairs = np.frombuffer(run, np.int32).reshape(-1, 2).tolist() if run else []
                ends = [0, *(b for _, b in pairs)]
                starts = [*(a for a, _ in pairs), len(text)]
                size.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in pairs])
                kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)) if pairs else text)
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    rows = with_runs(docs, runs).select("doc_id", "text", "runs")
    return rows.mapInArrow(remove, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def removed_bytes_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """remove_repeated_bytes() with the spans counted and the kept bytes as a digest."""
    out = remove_repeated_bytes(docs, window)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
