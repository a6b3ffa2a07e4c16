"""Cross-tokenizer alignment by diagonal run skipping, and corpus-wide counts of linked token pairs.

1. A task encodes whole texts with both vocabularies (parts between spaces through a bounded cache, as no token of either
   crosses from a part into the space before the next) and lays out the tokens' ends in bytes.
2. ``align`` walks both end arrays at an index shift.  While slices of doubling length are equal at the shift, tokens pair
   one to one and are jumped; where they differ, tokens are taken from whichever array is behind until the ends meet
   (an irregular group), which changes the shift.
3. Links become pair ids.  A block of documents, of bounded text, reports each distinct pair once with its count, and keeps
   its documents' links as places in that list, packed.  Counts are added up by pair, the highest of each B id is found, and
   both go back to the blocks that hold the pair; there each document's links are summed up.  So nothing is broadcast that
   grows, and what moves is a block's distinct pairs, not links.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, shuffle_partitions, written

#: Text of a block of documents and of what is encoded at once; parts that a task's cache holds, the characters of the longest.
BLOCK_BYTES, PIECE_CHARS, CACHE_SIZE, CACHE_KEY_CHARS = 16 << 20, 1 << 18, 300_000, 48
#: Bits of a pair id for B's ids.
B_BITS = 16

_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens of A, and of B, that end where no token of the other ends; a and b are ascending ends with a common last one."""
    inner_a, inner_b = [], []
    i = j = 0
    n = len(a)
    while i < n:
        step = 4
        while a[i : i + step] == b[j : j + step]:  # one to one at this shift
            i += step
            j += step
            if i >= n:
                return inner_a, inner_b
            step += step
        x, y = a[i], b[j]
        while x == y:
            i += 1
            j += 1
            if i >= n:
                return inner_a, inner_b
            x, y = a[i], b[j]
        while x != y:  # an irregular group
            if x < y:
                inner_a.append(i)
                i += 1
                x = a[i]
            else:
                inner_b.append(j)
                j += 1
                y = b[j]
        i += 1
        j += 1
    return inner_a, inner_b


class Vocabularies:
    """Both tokenizers: pieces of texts to ids, and lengths of tokens.

    A is a byte-level vocabulary as ranks, encoded by the library for ranks: its ids are those of the same vocabulary as JSON
    under that library (tested on every code point and every token), at a third of the time.
    """

    def __init__(self, file_a: str, file_b: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(file_a), "rb") as lines:
            ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file_b))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        names = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in names]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # how ids are written inside a group's side, those of A before those of B, and then at its end
        sides = len(self.bytes_a), len(self.bytes_b)
        self.written = [b"%d" % i + mark for marks in (b",,", b"|;") for n, mark in zip(sides, (marks[:1], marks[1:]), strict=True) for i in range(n)]
        assert max(sides) <= 1 << B_BITS
        self.forget()
        self.space_b = self.b.piece_to_id("▁")

    def parts(self, piece: str) -> list[str]:
        """Cuts space+piece before spaces that follow no blank; each part without its leading space."""
        if piece[-1:] != " " and piece[:1] != " " and "  " not in piece and not _SPACED.search(piece):
            return piece.split(" ")
        return [x[1:] for x in _CUT.split(" " + piece)]

    def learn(self, parts: list[str]):
        """Adds the ids of A and B of parts to the cache; notes parts whose bytes they don't give back."""
        found = [self.a(" " + x) for x in parts], [x or [self.space_b] for x in self.b.encode(parts, num_threads=1)]
        whole = "".join([" " + x for x in parts]).encode()
        for side, (ids, bytes_of) in enumerate(zip(found, (self.bytes_a, self.bytes_b), strict=True)):
            if b"".join(map(bytes_of.__getitem__, chain.from_iterable(ids))) != whole:
                self.broken.update(x for x, own in zip(parts, ids, strict=True) if b"".join(map(bytes_of.__getitem__, own)) != b" " + x.encode())
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.size[side] = np.concatenate([self.size[side], size])
            self.flat[side] = np.concatenate([self.flat[side], np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.place.update(zip(parts, range(len(self.size[0]) - len(parts), len(self.size[0]))))

    def forget(self):
        self.place: dict[str, int] = {}  # of a part among the cached ones
        self.size = [np.zeros(0, np.int64)] * 2  # tokens of each cached part, and all of them, for A and B
        self.flat = [np.zeros(0, np.int32)] * 2
        self.broken: set[str] = set()

    def encode(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each piece; none where the joined bytes differ from space+piece."""
        cut = [self.parts(x) for x in pieces]
        missing = set(chain.from_iterable(cut)).difference(self.place)
        if len(self.size[0]) + len(missing) > CACHE_SIZE:
            self.forget()
            missing = set(chain.from_iterable(cut))
        if missing:
            self.learn(list(missing))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        sides = []
        for size, flat in zip(self.size, self.flat, strict=True):
            own, upto = size[place], np.cumsum(size[place])
            ids = flat[np.repeat((np.cumsum(size) - size)[place] - upto + own, own) + np.arange(int(own.sum()))]
            sides.append(np.split(ids, upto[np.cumsum(n) - 1][:-1]))
        out = list(zip(*sides, strict=True))
        if self.broken:
            out = [x if self.broken.isdisjoint(parts) else (ids[:0], ids[:0]) for x, parts in zip(out, cut, strict=True)]
        for x in missing:
            if len(x) > CACHE_KEY_CHARS:  # its ids stay until the next forget()
                del self.place[x]
                self.broken.discard(x)
        return out


def pieces(text: str):
    """Pieces of a text of about PIECE_CHARS, cut where parts are and without the space before them."""
    start = 0
    while len(text) - start > PIECE_CHARS and (m := _CUT.search(text, start + PIECE_CHARS)):
        yield text[start : m.start()]
        start = m.start() + 1
    yield text[start:]


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(file_a: str, file_b: str) -> Vocabularies:
    """The worker's tokenizers, loaded once."""
    if (file_a, file_b) not in _loaded:
        _loaded[file_a, file_b] = Vocabularies(file_a, file_b)
    return _loaded[file_a, file_b]


def aligned(v: Vocabularies, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """Number of groups, pair ids of all links, and the groups as text."""
    end_a, end_b = np.cumsum(v.length_a[a]), np.cumsum(v.length_b[b])
    inner_a, inner_b = (np.array(x, np.int64) for x in align(end_a.tolist(), end_b.tolist()))
    # a token links as often as ends of the other side's tokens fall inside it, and once more
    times_a = np.bincount(np.searchsorted(end_a, end_b[inner_b]), minlength=len(a)) + 1
    times_b = np.bincount(np.searchsorted(end_b, end_a[inner_a]), minlength=len(b)) + 1
    links = (np.repeat(a, times_a).astype(np.uint32) << np.uint32(B_BITS)) | np.repeat(b, times_b).astype(np.uint32)
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
    last_a[inner_a] = False
    last_b[inner_b] = False
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to the end of each group
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a] = a + len(v.written) // 2 * last_a
    code[place_b] = b + len(v.bytes_a) + len(v.written) // 2 * last_b
    return len(upto_a), links, b"".join(map(v.written.__getitem__, code.tolist()))[:-1]


class Alignment:
    """A document's counts, its distinct pairs with how often it links them, and its groups' digest."""

    def __init__(self):
        self.whole, self.counts, self.pairs, self.digest = True, [0, 0, 0, 0], [], None

    def add(self, v: Vocabularies, a: np.ndarray, b: np.ndarray):
        if not len(a) or not self.whole:
            self.whole, self.counts, self.pairs, self.digest = False, [0, 0, 0, 0], [], None
            return
        groups, links, text = aligned(v, a, b)
        self.counts = [x + y for x, y in zip(self.counts, (len(a), len(b), groups, len(links)), strict=True)]
        if self.digest is None:
            self.digest = hashlib.sha256(text)
        else:
            self.digest.update(b";" + text)
        self.pairs.append(np.unique(links, return_counts=True))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        if not self.pairs:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pairs, place = np.unique(np.concatenate([x for x, _ in self.pairs]), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate([n for _, n in self.pairs])).astype(np.int64)


def align_texts(v: Vocabularies, texts: list[str | None]) -> list[Alignment]:
    out, held, chars = [Alignment() for _ in texts], [], 0

    def settle():
        for (i, _), ids in zip(held, v.encode([x for _, x in held]), strict=True):
            out[i].add(v, *ids)

    for i, text in enumerate(texts):
        for x in pieces(text) if text else ():
            held.append((i, x))
            chars += len(x)
            if chars >= PIECE_CHARS:
                settle()
                held, chars = [], 0
    if held:
        settle()
    return out


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of numbers below 2**32, a plane a byte, compressed."""
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T) for x in columns]
    head = np.array([len(x) for x in columns], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(x.tobytes() for x in planes))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8 * columns, []
    for n in np.frombuffer(raw, "<i8", columns).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return out


def _block_rows(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The distinct pairs of a block's documents with their counts, the commonest first, and the documents' links packed:
    places in that list as ascending steps, how often each, and how many a document has."""
    distinct = np.array([len(x) for x, _ in own])
    every, times = np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own])
    pairs = np.unique(every)
    place = np.searchsorted(pairs, every)
    count = np.bincount(place, times, len(pairs)).astype(np.int64)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = (np.repeat(np.arange(len(own)), distinct) << 32) | rank[place]
    sort = np.argsort(place)
    place, times = place[sort] & 0xFFFFFFFF, times[sort]
    steps = np.diff(place, prepend=0)
    first = (np.cumsum(distinct) - distinct)[distinct > 0]
    steps[first] = place[first]
    return pairs[order].astype(np.int64), count[order], pack([steps, times, distinct])


def token_alignment(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs`` (doc_id, text).

    A (ranks of a byte-level vocabulary) encodes space+text, B the text, both without special tokens.  Texts that are null, empty or that either side's joined
    tokens don't give back have no tokens: zeros and an empty digest.  n_best counts links of a pair whose corpus-wide count
    is the highest of its B id, count_sum adds up the counts of all links.  Rows are aligned each for itself, repeated rows
    count each, and a null doc_id stays null.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "kind", "at", "pair", "n", "links", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = f"block long, kind int, at int, pair long, n long, links binary, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"

    def encode(batches):
        v = vocabularies(a, b)
        number, own, held, at, id_type = TaskContext.get().partitionId() << 24, [], 0, 0, None

        def rows(step: int, size: int, start: int, **columns) -> pa.RecordBatch:
            types = {"links": pa.binary(), "doc_id": id_type, "groups_sha256": pa.string()}
            given = {"block": np.full(size, number), "kind": np.full(size, step, np.int32), "at": np.arange(start, start + size, dtype=np.int32), **columns}
            arrays = [given.get(c) if c in given else pa.nulls(size, types.get(c, pa.int64())) for c in names]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names)

        def flush():
            pairs, counts, packed = _block_rows(own)
            for i in range(0, len(pairs), 50_000):
                yield rows(0, len(pairs[i : i + 50_000]), i, pair=pairs[i : i + 50_000], n=counts[i : i + 50_000])
            yield rows(1, 1, 0, links=pa.array([packed], pa.binary()))

        for batch in batches:
            ids = batch.column("doc_id")
            id_type = ids.type
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), PIECE_CHARS)) + i)
                found = align_texts(v, batch.column("text")[i:j].to_pylist())
                columns = dict(zip(names[7:11], np.array([f.counts for f in found], np.int64).T, strict=True))
                digests = pa.array([f.digest.hexdigest() if f.digest else "" for f in found])
                yield rows(2, len(found), at, doc_id=ids[i:j], groups_sha256=digests, **columns)
                own += [f.distinct() for f in found]
                held += int(sizes[i:j].sum())
                at, i = at + len(found), j
                if held >= block_bytes:
                    yield from flush()
                    number, own, held, at = number + 1, [], 0, 0
        if own:
            yield from flush()

    rows = written(docs.select("doc_id", "text").mapInArrow(released(encode, lambda: vocabularies(a, b).forget()), schema))
    totals = rows.where("kind = 0").groupBy("pair").agg(F.sum("n").alias("total"))
    totals = written(totals)
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))  # one row an id of the vocabulary
    totals = totals.withColumn("b", b_id).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    pairs = rows.where("kind = 0").select("block", "kind", "at", "pair").join(totals, "pair").drop("pair")
    met = rows.where("kind > 0").drop("pair", "n").unionByName(pairs, allowMissingColumns=True)
    met = met.repartition(2 * shuffle_partitions(spark), "block").sortWithinPartitions("block", "kind", "at")

    def finish(batches):
        block, totals, bests, best_sum, total_sum = None, [], [], None, None
        for batch in batches:
            number, step = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(step) != 0)) + 1).tolist(), len(number)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                own = batch.slice(i, j - i)
                if number[i] != block:
                    block, totals, bests = number[i], [], []
                if step[i] == 0:
                    totals.append(own.column("total").to_numpy(zero_copy_only=False))
                    bests.append(own.column("best").to_numpy(zero_copy_only=False))
                elif step[i] == 1:
                    steps, times, distinct = unpack(own.column("links")[0].as_py(), 3)
                    total, best = np.concatenate([np.zeros(0, np.int64), *totals]), np.concatenate([np.zeros(0, bool), *bests])
                    first = np.cumsum(distinct) - distinct
                    place = np.cumsum(steps)  # steps start anew with each document
                    place -= np.repeat(np.concatenate([[0], place])[first], distinct)
                    added = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(np.stack([times * best[place], times * total[place]]), 1)], 1)
                    best_sum, total_sum = added[:, first + distinct] - added[:, first]
                else:
                    at = own.column("at").to_numpy(zero_copy_only=False)
                    columns = [own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(best_sum[at]), pa.array(total_sum[at]), own.column("groups_sha256")]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return met.mapInArrow(released(finish), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
