"""Benchmark decontamination: a prefix-filtered join for exact containment of item-sized windows.

Every item gives its windows of ``window`` words (an item with fewer is one window).  A window's shingles are its word
pairs (its word, if it has one).  Containment must be total, so one shingle is a sufficient prefix, and the rarest is taken,
by counts of words over all documents.  One pass over the documents proposes the places of shingles that may be a prefix,
with the words around them; the places join the windows by shingle, a place must leave room for the window (positional and
length bounds), and then the words themselves must agree.  Nothing is collected but a table of counts and a bitmap of
prefixes, both of bounded size; a fuller bitmap only lets more places through to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS_DIGITS, LOWER, flat_text, mix, released, rolling, split_chunks, word_bounds, word_hashes, written

#: Slots of the counts of words (by the upper bits of their hashes), and bits of the bitmap: so many a prefix, between bounds.
SLOT_BITS, PREFIX_BITS, LEAST_BITS, MOST_BITS = 13, 1024, 1 << 20, 1 << 27
#: What is broadcast to a join at most; more joins by shuffle.
BROADCAST_BYTES = 32 << 20
SPOT = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())])


def _words(buf: np.ndarray, offsets: np.ndarray):
    """The texts' bytes in lower case with blanks for separators, bounds of their words, words before each text, hashes."""
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offsets, LETTERS_DIGITS)
    return np.where(LETTERS_DIGITS[buf], buf, np.uint8(0x20)), starts, ends, first, word_hashes(buf, starts, ends)


def _single(words: np.ndarray) -> np.ndarray:
    return mix(words + np.uint64(1))


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _word_counts(docs: DataFrame) -> np.ndarray:
    """How many words of all documents fall in each slot."""

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, buf, offsets in split_chunks(batch):
                total += np.bincount(_slot(_words(buf, offsets)[4]), minlength=len(total))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    for row in docs.select("text").mapInArrow(released(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row.slot] = row.n
    return out


def item_windows(benchmark: DataFrame, counts: np.ndarray, window: int) -> DataFrame:
    """item_id, window (its words, a blank between), n (their number), shingle (its prefix), at (where in it that stands)."""

    def build(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                buf, offsets = flat_text(pa.array([text.as_py()], pa.string()))
                clean, starts, ends, _, words = _words(buf, offsets)
                own = [clean[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                size = min(window, len(own))
                if not size:
                    continue
                shingles = rolling(words, 2) if size > 1 else _single(words)
                rarity = counts[_slot(words)]
                rarity = np.minimum(rarity[:-1], rarity[1:]) if size > 1 else rarity
                n = len(own) - size + 1
                width = max(1, size - 1)
                rank = np.empty(len(shingles), np.int64)  # ties by hash
                rank[np.lexsort((shingles, rarity))] = np.arange(len(shingles))
                at = np.lib.stride_tricks.sliding_window_view(rank, width)[:n].argmin(1)
                prefix = shingles[np.arange(n) + at].view(np.int64)
                texts = [" ".join(own[j : j + size]) for j in range(n)]
                columns = [pa.array([item] * n, pa.string()), pa.array(texts), pa.array([size] * n, pa.int32()), pa.array(prefix), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "window", "n", "shingle", "at"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return written(rows.mapInArrow(build, "item_id string, window string, n int, shingle long, at int"))


def _prefix_bitmap(heads: DataFrame) -> np.ndarray:
    """Packed bits, set at each prefix modulo their number."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PREFIX_BITS * max(1, heads.count()) - 1).bit_length()))
    place = F.pmod(F.col("shingle"), F.lit(bits))
    maps = heads.select(place.alias("place")).select((F.col("place") / 32768).cast("int").alias("part"), (F.col("place") % 32768).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect():  # 4096 of 4 kB at most
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.map, np.uint8)
    return out


def _scan(docs: DataFrame, bitmap: np.ndarray, window: int) -> DataFrame:
    """doc_id, row_key, n_words and spots: where a shingle may be a prefix, with the words that a window there can cover."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def maybe(shingles: np.ndarray) -> np.ndarray:
        place = shingles & np.uint64(8 * len(shared.value) - 1)  # a power of two, so as pmod of the signed number
        return np.flatnonzero(shared.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)

    def scan(batches):
        for batch in batches:
            n_words, per_doc, spots = [], [], []
            for _, buf, offsets in split_chunks(batch):
                clean, starts, ends, first, words = _words(buf, offsets)
                one, two = _single(words), rolling(words, 2)
                p = maybe(two)
                doc = np.searchsorted(first, p, "right") - 1
                p, doc = p[p + 1 < first[doc + 1]], doc[p + 1 < first[doc + 1]]
                q = maybe(one)
                begin = np.concatenate([np.maximum(first[doc], p - window + 2), q])
                stop = np.concatenate([np.minimum(first[doc + 1], p + window), q + 1])
                own = np.concatenate([doc, np.searchsorted(first, q, "right") - 1])
                at, shingle = np.concatenate([p, q]), np.concatenate([two[p], one[q]]).view(np.int64)
                order = np.argsort(own, kind="stable")
                begin, stop, own, at, shingle = begin[order], stop[order], own[order], at[order], shingle[order]
                around = [clean[a:b].tobytes().decode() for a, b in zip(starts[begin].tolist(), ends[stop - 1].tolist(), strict=True)]
                fields = [pa.array(shingle), pa.array((at - first[own]).astype(np.int32)), pa.array((begin - first[own]).astype(np.int32)), pa.array(around, pa.string())]
                spots.append(pa.StructArray.from_arrays(fields, fields=list(SPOT)))
                per_doc.append(np.bincount(own, minlength=len(offsets) - 1))
                n_words += np.diff(first).tolist()
            ends_of = np.concatenate([[0], np.cumsum(np.concatenate(per_doc))]) if per_doc else np.zeros(1)
            every = pa.concat_arrays(spots) if spots else pa.array([], SPOT)
            lists = pa.ListArray.from_arrays(pa.array(ends_of.astype(np.int32)), every)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(n_words, pa.int64()), lists], ["doc_id", "row_key", "n_words", "spots"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    schema = f"doc_id {kind}, row_key long, n_words long, spots array<struct<shingle:long,at:int,first:int,around:string>>"
    return written(rows.mapInArrow(released(scan), schema))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, hits (disjoint runs of hit words: start, end), items, n_hit, n_items, contaminated for each row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  A document is contaminated when words are hit and
    ``share`` times their number reaches its number of words.  Null or wordless texts have no words, hits or items; an
    item without words has no window; an item without item_id is skipped; items with one text all count; an empty
    benchmark hits nothing.  Rows are independent: each row returns one row, and repeated rows repeat their result.
    """
    windows = item_windows(benchmark, _word_counts(docs), window)
    heads = written(windows.select("window", "n", F.col("shingle").alias("head"), F.col("at").alias("offset")).distinct())
    found = _scan(docs, _prefix_bitmap(heads.select(F.col("head").alias("shingle"))), window)

    spots = found.where("size(spots) > 0").select("doc_id", "row_key", F.inline("spots"))
    small = heads.count() * 40 * window <= BROADCAST_BYTES
    met = spots.join(heads.hint("broadcast" if small else "merge"), F.col("shingle") == F.col("head"))
    words = F.array_remove(F.split("around", " "), "")
    start = F.col("at") - F.col("offset")
    fits = met.withColumns({"start": start, "from": start - F.col("first"), "words": words}).where("from >= 0 and from + n <= size(words)")
    same = fits.where(F.array_join(F.slice("words", F.col("from") + 1, F.col("n")), " ") == F.col("window"))
    hits = written(same.select("doc_id", "row_key", "start", (F.col("start") + F.col("n")).alias("end"), "window").distinct())

    spans = hits.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    of = windows.select("window", "item_id").distinct()
    items = hits.select("doc_id", "row_key", "window").join(of, "window").groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    key = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("row_key") == F.col("_row_key"))
    hit = spans.join(items.withColumnsRenamed({"doc_id": "_doc_id", "row_key": "_row_key"}), key).drop("_doc_id", "_row_key")

    # spans that overlap or touch become one run
    none = F.array().cast("array<struct<start:int,end:int>>")
    runs = F.aggregate("spans", none, lambda out, s: F.when(
        (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]),
        F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(out, F.array(s))))
    hit = written(hit.select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_row_key"), runs.alias("hits"), "items"))
    total = hit.agg(F.count("*").alias("n"), F.sum(F.size("hits") + 4 * F.size("items")).alias("parts")).first()
    joined = found.drop("spots").join(hit.hint("broadcast" if 16 * (2 * total.n + (total.parts or 0)) <= BROADCAST_BYTES else "shuffle_hash"), key, "left").drop("_doc_id", "_row_key", "row_key")
    out = joined.withColumns({"hits": F.coalesce("hits", none), "items": F.coalesce("items", F.array().cast("array<string>"))})
    out = out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with the items as one digest."""
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), "contaminated")
