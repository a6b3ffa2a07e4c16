"""Shared pieces: table access, written intermediates, and byte-level helpers for Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text is taken in chunks of about this many bytes inside a task; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new path under the cluster's shared checkpoint folder; a temporary folder only in a local session without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("pressmill.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("pressmill.scratch", base)
    return f"{base.rstrip('/')}/pressmill-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to shared storage and reads it back: later steps neither recompute it nor depend on executors."""
    path, conf = scratch_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")  # what was shuffled for this write isn't read again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_checked(big: DataFrame, small: DataFrame, key: list[str], small_rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Left join with a written side of known row count: broadcast up to ``limit`` bytes, a shuffled hash join beyond."""
    hint = "broadcast" if small_rows * row_bytes <= limit else "shuffle_hash"
    return big.join(small.hint(hint), key, "left")


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and each text's offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int | None = None):
    """(first, last) text numbers of runs of texts of at most about ``limit`` bytes, CHUNK_BYTES by default."""
    n, i, limit = len(offsets) - 1, 0, limit or CHUNK_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def split_chunks(batch: pa.RecordBatch, text: str = "text"):
    """Yields (rows of the chunk, bytes, offsets) of a batch's text column."""
    buf, offsets = flat_text(batch.column(text))
    for i, j in chunks(offsets):
        yield slice(i, j), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Word bytes under [^\x20\x09-\x0D]+, and under [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
NOT_BLANK = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
LETTERS_DIGITS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words before each text. No word crosses texts."""
    is_word = kind[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes, as two columns, of the bytes between starts and ends."""
    import xxhash

    digest, view = xxhash.xxh3_128_digest, memoryview(data.view(np.uint8))
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def first_eight(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice as a number, zeros for bytes that it lacks."""
    eight = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    lacking = (8 - np.minimum(ends - starts, 8)).astype(np.uint64) * np.uint64(8)
    return (eight[starts] << lacking) >> lacking


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, of two halves that are independent: equal words have equal hashes, and what depends on the
    reverse compares bytes (see same_words)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    own = first_eight(buf, starts, ends) ^ (size.astype(np.uint64) << np.uint64(56))
    halves = np.stack([mix(own), mix(own * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))], 1)
    long = np.flatnonzero(size > 8)
    if len(long):
        halves[long] = slice_hashes(np.ascontiguousarray(buf), starts[long], ends[long])
    return mix(halves[:, 0] * np.uint64(0xC2B2AE3D27D4EB4F) + halves[:, 1])


def same_words(hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for words of equal bytes alone: by hash, then compared byte by byte with the first."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    other, size, head = first[number], ends - starts, first_eight(buf, starts, ends)
    differ = (size != size[other]) | (head != head[other])
    if not differ.any():
        long = np.flatnonzero(size > 8)
        rest = size[long] - 8
        step = np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest)
        differ = buf[np.repeat(starts[long] + 8, rest) + step] != buf[np.repeat(starts[other[long]] + 8, rest) + step]
    if differ.any():  # two words with one hash
        seen: dict[bytes, int] = {}
        view = memoryview(np.ascontiguousarray(buf))
        return np.array([seen.setdefault(bytes(view[a:b]), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return number


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; empty where there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += h[j : len(h) - k + 1 + j]
    return mix(out)


def released(work, forget=None):
    """A task's work on batches that, at its end, gives memory back to the system, as workers outlive their tasks; forget()
    is called first."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            if forget:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library has it
            if trim:
                trim(0)

    return run


def least_by_hash(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """Of each value of ``group`` the rows (doc_id, group) with the least (unsigned) hashes of doc_id, ``limit`` of them at most.

    Counts come first, so that only rows below each value's threshold, somewhat more than the limit, are ranked.
    """
    size = rows.groupBy(group).agg(F.count("*").alias("size"))
    share = F.lit(limit + 8 * limit**0.5 + 16) / F.col("size")
    position = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    below = rows.join(F.broadcast(size), group).where(position < share).select("doc_id", group)
    order = Window.partitionBy(group).orderBy(position, "doc_id")
    return below.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def crc_mod(column: str, mod: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod
