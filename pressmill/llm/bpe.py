"""Byte-level BPE by a two-tier lookup: a minimal perfect hash over the vocabulary, then merging with a heap.

A pre-token that is a vocabulary entry is found with one probe of a minimal perfect hash.  Any other is merged on a
doubly linked list of its bytes, the pairs waiting in a heap by (rank, place), so a pre-token of n bytes takes
O(n log n) steps.  A worker keeps the vocabulary, and a task the ids of short pre-tokens as packed bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released

#: A worker's cache: pre-tokens that it holds, and the characters of the longest. With their ids that is some 80 MB.
CACHE_SIZE, CACHE_KEY_CHARS = 400_000, 48


class PerfectHash:
    """Minimal perfect hash by hash and displace: a bucket's displacement is the first that puts its keys on free slots."""

    def __init__(self, keys: list[bytes], values: list[int]):
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.shift = [0] * self.buckets
        groups: dict[int, list[int]] = {}
        hashes = [self._hash(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        free = bytearray(b"\x01") * n
        order = sorted(groups.items(), key=lambda x: -len(x[1]))
        singles = [g for g in order if len(g[1]) == 1]
        for bucket, members in order[: len(order) - len(singles)]:
            d = 0
            while True:
                spots = {self._slot(hashes[i], d) for i in members}
                if len(spots) == len(members) and all(free[s] for s in spots):
                    break
                d += 1
            self.shift[bucket] = d
            for i in members:
                s = self._slot(hashes[i], d)
                free[s], self.slots[s], self.values[s] = 0, keys[i], values[i]
        left = (s for s in range(n) if free[s])
        for (bucket, (i,)), s in zip(singles, left, strict=False):  # a bucket of one key names its slot outright
            self.shift[bucket] = -1 - s
            self.slots[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) + d * ((h >> 7) | 1) + d * d) % self.n

    def get(self, key: bytes) -> int | None:
        """The key's value, if it is one of the keys."""
        h = self._hash(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.values[s] if self.slots[s] == key else None


def merge(piece: bytes, rank_of) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank merges first, of equal ones the leftmost.

    rank_of gives the rank of a byte string, or None. A pair waits as rank, place and the place where it stops.
    """
    n = len(piece)
    after, before, end = list(range(1, n + 2)), list(range(-1, n)), list(range(1, n + 2))
    heap = []
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]  # 0 once i has merged into the one before it
        if not j or j >= n or end[j] != stop:  # one of the two has since merged
            continue
        end[i], end[j] = stop, 0
        k, h = after[j], before[i]
        after[i], before[k] = k, i
        if k < n and (r := rank_of(piece[i : end[k]])) is not None:
            heapq.heappush(heap, (r, i, end[k]))
        if h >= 0 and (r := rank_of(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(rank_of(piece[i : end[i]]))
        i = after[i]
    return out


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; also decodes ids to bytes."""

    def __init__(self, file: str):
        import public_tokenizers
        import regex

        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, open(file, "rb")))
        keys = [k for _, k in pairs]
        self.hash = PerfectHash(keys, [r for r, _ in pairs])
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.bytes_of = dict(pairs)  # these hold the table's bytes, not copies
        self.rank_of = {k: r for r, k in pairs}.get

    def __missing__(self, part: str) -> bytes:
        raw = part.encode()
        i = self.hash.get(raw)
        ids = array("I", [i] if i is not None else merge(raw, self.rank_of)).tobytes()
        if len(part) <= CACHE_KEY_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The worker's codec for a rank file, made once."""
    if name not in _codecs:
        import public_tokenizers

        _codecs[name] = Codec(public_tokenizers.path(name))
    return _codecs[name]


def bpe_encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and ``ids`` (binary, little-endian unsigned 32-bit) of each row's whole text; null and empty have no ids.

    Rows are independent: repeated rows repeat their ids, and a null doc_id stays null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        c = codec(ranks)
        for batch in batches:
            ids = [c.encode(x) if (x := text.as_py()) else b"" for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(released(encode, lambda: codec(ranks).clear()), f"doc_id {kind}, ids binary")


def bpe_decode(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and ``decoded`` (binary) of rows with ids as bpe_encode gives them; null ids decode to nothing."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        c = codec(ranks)
        for batch in batches:
            raw = [c.decode(x) if (x := ids.as_py()) else b"" for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(released(decode, lambda: codec(ranks).clear()), f"doc_id {kind}, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes whole texts, then decodes the ids, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def both(batches):
        c = codec(ranks)
        for batch in batches:
            n, one, two = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(released(both, lambda: codec(ranks).clear()), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
