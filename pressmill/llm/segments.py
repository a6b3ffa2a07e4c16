"""Repeated windows of a table of sequences: windows meet by the least hash of the short runs inside them.

A window of ``window`` symbols holds ``window - run + 1`` runs of ``run`` symbols.  Equal windows have equal least run
hashes, so consecutive windows of a document with one least hash travel together, as a segment of text, to the bucket of
that hash.  Tasks pack a bucket's segments into compressed blocks.  Before anything is sent, and again in the bucket,
segments with the same content collapse: the one of the smallest document stays, windows of the others are repeats.
A passage that a third of all rows share is thus one segment a block.  What is left to compare inside a bucket is
segments with the same least hash and different content; a ``solver`` finds their common windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, chunks, flat_text, int_column, join_checked, mix, released, rolling, same_words, shuffle_partitions, slice_hashes, word_bounds, word_hashes, written

#: Text that a task gathers before it packs blocks, text whose segments share a bucket, buckets of a partition, and parts
#: that a bucket is solved in.
FLUSH_BYTES, BUCKET_BYTES, PART_BUCKETS, PARTS = 12 << 20, 6 << 20, 4, 8


@dataclass
class Symbols:
    """Kinds of symbols: parse() gives, for texts laid end to end, symbols as numbers, hashes of runs of ``run`` of them,
    the number of symbols before each text, the bytes where each symbol starts and ends, and the bytes that tell contents
    apart.  exact() turns the numbers into ones that are equal for equal symbols alone."""

    parse: Callable
    run: int
    exact: Callable


def parse_bytes(buf: np.ndarray, offsets: np.ndarray):
    n = len(buf)
    at = np.arange(n)
    if n < 12:
        return buf, np.zeros(0, np.uint64), offsets, at, at + 1, buf
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    h = eight[: n - 11] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[4 : n - 7] >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return buf, h, offsets, at, at + 1, buf


def parse_words(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, first = word_bounds(buf, offsets, NOT_BLANK)
    words = word_hashes(buf, starts, ends)
    return words, rolling(words, 4), first, starts, ends, np.where(NOT_BLANK[buf], buf, np.uint8(0x20))


BYTES, WORDS = Symbols(parse_bytes, 12, lambda values, *_: values), Symbols(parse_words, 4, same_words)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, h
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


@dataclass
class Segments:
    """doc, key: whose it is; start, count: its first symbol in the document, and its symbols; least: its windows' least
    run hash; same: 128-bit hash of its content; first, last: its bytes in data."""

    doc: np.ndarray
    key: np.ndarray
    start: np.ndarray
    count: np.ndarray
    least: np.ndarray
    same: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        columns = [getattr(self, c)[which] for c in ("doc", "key", "start", "count", "least", "same", "first", "last")]
        return Segments(*columns, self.data)


def cut(symbols: Symbols, window: int, buf: np.ndarray, offsets: np.ndarray, doc: np.ndarray, key: np.ndarray) -> Segments:
    values, h, first, starts, ends, content = symbols.parse(buf, offsets)
    first = np.asarray(first, np.int64)
    n_windows = len(values) - window + 1
    if n_windows <= 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none.astype(np.uint64), np.zeros((0, 2), np.uint64), none, none, buf)
    least = sliding_min(h, window - symbols.run + 1)[:n_windows]
    edge = np.zeros(n_windows + 1, np.int8)  # of stretches of windows inside one text
    inside = np.flatnonzero(np.diff(first) >= window)
    np.add.at(edge, first[inside], 1)
    np.add.at(edge, first[inside + 1] - window + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    fresh = np.ones(n_windows, bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[first[inside]] = True
    fresh[1:] |= ~valid[:-1]
    begin = np.flatnonzero(fresh & valid)
    stop = np.zeros(n_windows, bool)
    stop[:-1] = fresh[1:] | ~valid[1:]
    stop[-1] = True
    count = np.flatnonzero(stop & valid) - begin + window
    text = np.searchsorted(first, begin, "right") - 1
    byte, stop = starts[begin], ends[begin + count - 1]
    return Segments(doc[text], key[text], begin - first[text], count, least[begin], slice_hashes(content, byte, stop), byte, stop, buf)


def collapse(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each segment by content, the smallest document of its class, and whether a smaller document has it."""
    if not len(s.doc):
        return np.zeros(0, np.int64), s.doc, np.zeros(0, bool)
    _, first, of = np.unique(s.same[:, 0], return_index=True, return_inverse=True)
    if (s.same[:, 1] != s.same[first[of], 1]).any():  # two contents with one half of their hashes
        _, of = np.unique(s.same, axis=0, return_inverse=True)
        of = of.ravel()
    least = np.full(of.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, s.doc)
    return of, least[of], s.doc > least[of]


def pack(s: Segments, repeats: np.ndarray) -> bytes:
    """A block, ordered by part: repeats travel as places alone, the others with their bytes."""
    part = (s.least >> np.uint64(40)) % np.uint64(PARTS)
    order = np.argsort(part, kind="stable")
    s, repeats = s.take(order), repeats[order]
    size = np.where(repeats, 0, s.last - s.first)
    at = np.repeat(s.first - np.cumsum(size) + size, size) + np.arange(size.sum())
    order = np.lexsort((s.start, s.key, s.doc))
    change = np.ones(len(order), bool)
    change[1:] = (np.diff(s.doc[order]) != 0) | (np.diff(s.key[order]) != 0)
    owner = np.empty(len(order), np.int32)
    owner[order] = np.cumsum(change) - 1
    own = order[change]
    head = np.array([len(s.doc), len(own), *np.bincount(part.astype(np.int64), minlength=PARTS)], np.int64)
    columns = [head, s.doc[own], s.key[own], owner, s.start.astype(np.int32), s.count.astype(np.int32), size.astype(np.int32)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in columns) + s.data[at].tobytes())


def unpack(symbols: Symbols, blocks: list[bytes], part: int) -> tuple[Segments, np.ndarray]:
    """A part's segments of some opened blocks with their bytes, and the places (rows of doc, key, start, count) of repeats."""
    columns, texts, repeats = [], [], []
    for raw in blocks:
        n, m, *sizes = np.frombuffer(raw, np.int64, 2 + PARTS).tolist()
        at = 8 * (2 + PARTS)
        own = np.frombuffer(raw, np.int64, 2 * m, at).reshape(2, m)
        at += 16 * m
        every = np.frombuffer(raw, np.int32, 4 * n, at).reshape(4, n)
        here = slice(sum(sizes[:part]), sum(sizes[: part + 1]))
        skip = int(every[3, : here.start].sum())
        owner, start, count, size = every[:, here]
        rows = np.stack([own[0][owner], own[1][owner], start, count])
        repeats.append(rows[:, size == 0])
        columns.append(np.concatenate([rows, size[None]])[:, size > 0])
        texts.append(np.frombuffer(raw, np.uint8, int(size.sum()), at + 16 * n + skip))
    doc, key, start, count, size = np.concatenate(columns, 1)
    data = np.concatenate(texts)
    offsets = np.concatenate([[0], np.cumsum(size)])
    values, h, first, starts, ends, content = symbols.parse(data, offsets)
    first = np.asarray(first, np.int64)
    same = slice_hashes(content, offsets[:-1], offsets[1:])
    # every run of a segment lies in one of its windows, so the least hash of its windows is the least of its runs
    bounds = np.stack([first[:-1], first[1:] - symbols.run + 1], 1).ravel()
    least = np.minimum.reduceat(np.concatenate([h, np.full(symbols.run + 1, np.iinfo(np.uint64).max, np.uint64)]), bounds)[::2] if len(doc) else np.zeros(0, np.uint64)
    segments = Segments(doc, key, start, count, least, same, offsets[:-1], offsets[1:], data)
    segments.values, segments.value_at = symbols.exact(values, data, starts, ends), first[:-1]
    return segments, np.concatenate(repeats, 1)


def solve(symbols: Symbols, window: int, blocks: list[bytes], part: int, solver: Callable) -> np.ndarray:
    """Places (rows of doc, key, start, count) of windows of a bucket's part that a smaller document has as well."""
    s, repeats = unpack(symbols, blocks, part)
    if not len(s.doc):
        return repeats
    of, least_doc, repeated = collapse(s)
    out = [repeats, np.stack([s.doc[repeated], s.key[repeated], s.start[repeated], s.count[repeated]])]
    keep = np.flatnonzero(~repeated)  # of each class the segments of its smallest document
    if len(keep):
        _, one, back = np.unique(of[keep], return_index=True, return_inverse=True)
        one = keep[one]
        _, group, size = np.unique(s.least[one], return_inverse=True, return_counts=True)
        several = size[group] > 1
        low, high = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), np.iinfo(np.int64).min)
        np.minimum.at(low, group, s.doc[one])
        np.maximum.at(high, group, s.doc[one])
        several &= (low != high)[group]
        if several.any():
            chosen = np.flatnonzero(several)
            n = s.count[one[chosen]] - window + 1
            which = np.repeat(np.arange(len(chosen)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            base = s.value_at[one[chosen]]
            hit = solver(s.values, base[which] + place, group[chosen][which], s.doc[one[chosen]][which], window)
            if hit.any():
                begin = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (np.diff(which) != 0)]))
                end = np.flatnonzero(hit & np.concatenate([~hit[1:] | (np.diff(which) != 0), [True]]))
                runs_class = chosen[which[begin]]
                members = np.argsort(back, kind="stable")
                member_first = np.searchsorted(back[members], np.arange(len(one) + 1))
                times = member_first[runs_class + 1] - member_first[runs_class]
                r = np.repeat(np.arange(len(begin)), times)
                m = keep[members[np.repeat(member_first[runs_class] - np.cumsum(times) + times, times) + np.arange(times.sum())]]
                out.append(np.stack([s.doc[m], s.key[m], s.start[m] + place[begin][r], (place[end] - place[begin])[r] + window]))
    return np.concatenate(out, 1)


def merged(pairs: np.ndarray) -> np.ndarray:
    """Disjoint ascending runs that cover the same places as (start, end) rows."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([pairs[begin, 0], reach[np.append(begin[1:], len(pairs)) - 1]], 1).astype(np.int32)


def repeated_runs(docs: DataFrame, symbols: Symbols, window: int, solver: Callable) -> DataFrame:
    """doc_id, row_key (xxhash64 of text) and runs (int32 pairs of first and end symbol) of rows of ``docs`` (doc_id,
    text) with a window that also starts in a document with a smaller doc_id; a written table, one row a document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(2 * shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    parts = max(shuffle_partitions(spark), -(-buckets // PART_BUCKETS))  # partitions grow in number with the input, not in size
    targets = max(shuffle_partitions(spark), parts // 16)

    def flush(pending):
        if not pending:
            return
        shift = np.cumsum([0] + [len(x.data) for x in pending[:-1]])
        fields = [np.concatenate([getattr(x, c) for x in pending]) for c in ("doc", "key", "start", "count", "least", "same")]
        places = [np.concatenate([getattr(x, c) + d for x, d in zip(pending, shift, strict=True)]) for c in ("first", "last")]
        s = Segments(*fields, *places, np.concatenate([x.data for x in pending]))
        _, _, repeats = collapse(s)
        bucket = (s.least % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        numbers, blocks = [], []
        for own in np.split(order, cuts):
            if len(own):
                numbers.append(int(bucket[own[0]]))
                blocks.append(pack(s.take(own), repeats[own]))
                if len(blocks) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])
                    numbers, blocks = [], []
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def send(batches):
        pending, held = [], 0
        for batch in batches:
            buf, offsets = flat_text(batch.column("text"))
            doc, key = int_column(batch, "doc_id"), int_column(batch, "row_key")
            for i, j in chunks(offsets):
                pending.append(cut(symbols, window, buf[offsets[i] : offsets[j]].copy(), offsets[i : j + 1] - offsets[i], doc[i:j], key[i:j]))
                held += offsets[j] - offsets[i]
                if held >= FLUSH_BYTES:
                    yield from flush(pending)
                    pending, held = [], 0
        yield from flush(pending)

    def together(batches, key: str):
        """(number, opened blocks) of each value of a key by which the rows are sorted."""
        number, blocks = None, []
        for batch in batches:
            for own, block in zip(batch.column(key).to_pylist(), batch.column("block"), strict=True):
                if own != number and blocks:
                    yield number, blocks
                    blocks = []
                number = own
                blocks.append(zstandard.ZstdDecompressor().decompress(block.as_buffer()))
        if blocks:
            yield number, blocks

    def receive(batches):
        for _, opened in together(batches, "bucket"):
            found = np.concatenate([solve(symbols, window, opened, part, solver).astype(np.int64) for part in range(PARTS)], 1)
            target = (mix(found[0].astype(np.uint64) ^ found[1].astype(np.uint64)) % np.uint64(targets)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            own = [x for x in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(x)]
            packed = [zstandard.ZstdCompressor(level=1).compress(found[:, x].tobytes()) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([target[x[0]] for x in own], pa.int32()), pa.array(packed, pa.binary())], ["target", "block"])

    def join_runs(batches):
        for _, opened in together(batches, "target"):
            doc, key, start, count = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in opened], 1)
            order = np.lexsort((key, doc))
            doc, key, pairs = doc[order], key[order], np.stack([start, start + count], 1)[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(key) != 0)]))
            end = np.append(first[1:], len(doc))
            for i in range(0, len(first), 5000):
                runs = [merged(pairs[a:b]).tobytes() for a, b in zip(first[i : i + 5000], end[i : i + 5000], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[first[i : i + 5000]]), pa.array(key[first[i : i + 5000]]), pa.array(runs, pa.binary())], ["doc_id", "row_key", "runs"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    sent = rows.mapInArrow(released(send), "bucket int, block binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(released(receive), "target int, block binary").repartition(targets, "target").sortWithinPartitions("target")
    return written(found.mapInArrow(released(join_runs), "doc_id long, row_key long, runs binary"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the runs of each row, null for none."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    total = runs.agg(F.count("*").alias("n"), F.sum(F.octet_length("runs")).alias("bytes")).first()
    return join_checked(rows, runs, ["doc_id", "row_key"], total.n, 60 + (total.bytes or 0) // max(1, total.n))
