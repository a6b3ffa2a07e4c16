"""An exact similarity self-join of distinct word sets by agreeing cells, confirmed in tiles.

Two sets of nx and ny words with a Jaccard similarity above num/den differ in fewer than (den - num) / (den + num) * (nx + ny)
words.  So if words are dealt over more cells than that by their hash, some cell holds the same words in both; sets meet on
whole cells, of about five words, and not on single words, which a larger corpus has more of.  Sizes fall into groups of
ratio num/den; a pair is sought in the group of its smaller set, so each set enters its own group and the one below.

Some cells more than needed are taken, so that a set may leave out as many cells of fewer than two words (weak ones): then some
agreeing cell isn't weak.  A set with more of these enters with all its cells, so that two such sets meet too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Cells beyond the necessary ones, as a share, and preceding cells that tell whether a pair has met before.
SLACK, BEFORE = 0.15, 4
#: Numbers of a sketch of parities that are columns (the rest is an array), and sets on a tile's side.
SKETCH, TILE = 8, 512


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def size_groups(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest size in each group, and the most words in which two similar sets of the group (the smaller in it) differ."""
    last, low = [], 1
    while low < 1 << 26:
        last.append(low * den // num)
        low = last[-1] + 1
    last = np.array(last, np.int64)
    return last, np.maximum(((den - num) * (last + last * den // num) - 1) // (den + num), 0)


def cells(hashes: np.ndarray, n: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For sets' word hashes laid end to end: (set, key, digests of the BEFORE preceding cells of the set) of each cell entered.

    A key is group, cell and a digest of the cell's words; a digest is never 0, which stands for a cell that isn't entered.
    """
    last, most = size_groups(num, den)
    group, own = np.searchsorted(last, n), np.repeat(np.arange(len(n)), n)
    slack = (SLACK * (most + 1)).astype(np.int64)
    mixed, upper = _mix(hashes), hashes >> np.uint64(32)
    for g in (group, group - 1):
        count = np.where((g >= 0) & (most[g] > 0), most[g] + 1 + slack[g], 0)
        start = np.cumsum(count) - count
        in_use = count[own] > 0
        at = (start[own] + (upper * count[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64))[in_use]
        total = int(count.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, at, mixed[in_use])
        of = np.repeat(np.arange(len(n)), count)
        weak = np.bincount(at, minlength=total) < 2
        spare = np.bincount(of[weak], minlength=len(n)) <= slack[g]
        entered = ~(weak & spare[of])
        digest = np.where(entered, np.maximum(_mix(sums) >> np.uint64(32), np.uint64(1)), np.uint64(0)).astype(np.int64)
        place = np.arange(total) - start[of]
        before = np.zeros((total, BEFORE), np.int64)
        for j in range(1, BEFORE + 1):
            before[j:, j - 1] = np.where(place[j:] >= j, digest[:-j], 0)
        yield of[entered], ((g[of] << 56) | (place << 32) | digest)[entered], before[entered]


def sketches(hashes: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """For each set the parities of its hashes' counts in 64 * words bins, in ``words`` numbers (SKETCH at least)."""
    own, bins = np.repeat(np.arange(len(n)), n), (_mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * words)).astype(np.int64)
    odd = np.zeros((len(n), max(SKETCH, words) * 64), np.uint8)
    np.bitwise_xor.at(odd, (own, bins), np.uint8(1))
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def sketch_words(most: np.ndarray) -> np.ndarray:
    """Numbers in the sketches of a group: a bin for each quarter of a word that may differ, so that unlike sets exceed them."""
    return np.maximum(2, -(-most // 16))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch laid end to end, and each set's number of them."""
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.diff(col.offsets.to_numpy())


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each run of equal values."""
    heads = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return zip(heads, [*heads[1:], len(values)][: len(heads)], strict=True)


def _parts(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most about so many words; a larger set is a run of its own."""
    ends = np.cumsum(np.diff(batch.column("h").offsets.to_numpy()))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def _proposed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """na < nb of the sets (no, w) that share a cell and pass filters on their sizes and parities; a written table."""

    def enter(batches):
        for batch in (x for b in batches for x in _parts(b)):
            no, (hashes, n) = batch.column("no").to_numpy(), _flat(batch, "h")
            for of, key, _ in cells(hashes, n, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(no[of])], ["key", "no"])

    hashed = sets.select("no", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    entered = hashed.mapInArrow(enter, "key long, no long")
    # most cells are in one set alone: short rows tell which, and only the others come again with what the filters need
    shared = entered.alias("x").join(entered.alias("y"), F.expr("x.key = y.key and x.no != y.no"), "left_semi")
    shared = stored(shared.groupBy("no").agg(F.collect_list("key").alias("keys")))

    fields = [*(f"p{j}" for j in range(BEFORE)), *(f"s{j}" for j in range(SKETCH))]
    width = sketch_words(size_groups(num, den)[1])

    def again(batches):
        for batch in (x for b in batches for x in _parts(b)):
            no, (hashes, n) = batch.column("no").to_numpy(), _flat(batch, "h")
            wanted, many = _flat(batch, "keys")
            pairs = np.stack([np.repeat(np.arange(len(n)), many), wanted.view(np.int64)], 1)
            pairs = np.unique(np.ascontiguousarray(pairs).view([("of", np.int64), ("key", np.int64)]).ravel())
            for of, key, before in cells(hashes, n, num, den):
                entries = np.ascontiguousarray(np.stack([of, key], 1)).view([("of", np.int64), ("key", np.int64)]).ravel()
                keep = np.isin(entries, pairs)
                of, key, before = of[keep], key[keep], before[keep]
                order = np.argsort(key >> 56, kind="stable")
                of, key, before = of[order], key[order], before[order]
                for i, j in _runs(key >> 56):  # a group has a width of sketch of its own
                    chosen, place = np.unique(of[i:j], return_inverse=True)
                    member = np.repeat(np.isin(np.arange(len(n)), chosen), n)
                    sketch = sketches(hashes[member], n[chosen], int(width[key[i] >> 56]))
                    more = pa.array(list(sketch[:, SKETCH:]), pa.list_(pa.int64())).take(pa.array(place))
                    columns = [key[i:j], no[of[i:j]], n[of[i:j]].astype(np.int64), *before[i:j].T, *sketch[place, :SKETCH].T]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), more], ["key", "no", "n", *fields, "more"])

    rows = hashed.join(shared, "no").mapInArrow(again, f"key long, no long, n long, {', '.join(f'{f} long' for f in fields)}, more array<long>")
    x, y = rows.alias("x"), rows.alias("y")
    met_before = " or ".join(f"(x.p{j} = y.p{j} and x.p{j} != 0)" for j in range(BEFORE))
    differ = " + ".join(f"bit_count(x.s{j} ^ y.s{j})" for j in range(SKETCH))
    rest = "if(size(x.more) = 0, 0, aggregate(zip_with(x.more, y.more, (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b))"
    near = f"x.n * {den} >= y.n * {num} and y.n * {den} >= x.n * {num} and ({differ}) * {num + den} < {den - num} * (x.n + y.n) and ({differ} + {rest}) * {num + den} < {den - num} * (x.n + y.n)"
    return stored(x.join(y, F.expr(f"x.key = y.key and x.no < y.no and not ({met_before}) and {near}")).select(F.col("x.no").alias("na"), F.col("y.no").alias("nb")).distinct())


def _confirmed(pairs: pd.DataFrame, sets: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """The pairs (na, nb) of a tile that are similar, with intersection and union of their words."""
    n = sets["w"].map(len).to_numpy(np.int64)
    code, _ = pd.factorize(np.concatenate([*sets["w"], np.zeros(0, object)]))
    start = np.cumsum(n) - n
    row = pd.Series(np.arange(len(sets)), sets["no"].to_numpy())
    pairs = pairs.sort_values("na", ignore_index=True)
    a, b = row[pairs["na"]].to_numpy(), row[pairs["nb"]].to_numpy()
    both, mark = np.zeros(len(pairs), np.int64), np.zeros(len(code) + 1, bool)
    for i, j in _runs(a):
        own = code[start[a[i]] : start[a[i]] + n[a[i]]]
        mark[own] = True
        for k in range(i, j):
            both[k] = np.count_nonzero(mark[code[start[b[k]] : start[b[k]] + n[b[k]]]])
        mark[own] = False
    out = pd.DataFrame({"na": pairs["na"], "nb": pairs["nb"], "intersection": both, "union": n[a] + n[b] - both})
    return out[out["intersection"] * den > out["union"] * num]


def similar_sets(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """na < nb, intersection, union of all pairs of different sets with a Jaccard similarity above the share.

    ``sets``: no (long) and w (distinct words), a written table, whose sets differ.  Candidates of one hub, the least set they
    are proposed with, are confirmed together, in tiles of TILE sets a side, so a set's words travel once a tile and not once a pair.
    """
    num, den = share
    spark = sets.sparkSession
    pairs = _proposed(sets, num, den)
    hubs = pairs.groupBy(F.col("nb").alias("na")).agg(F.min("na").alias("hub"))
    pairs = stored(pairs.join(hubs, "na", "left").select("na", "nb", F.coalesce("hub", "na").alias("hub")))
    members = pairs.select("hub", F.explode(F.array("na", "nb")).alias("no")).distinct().groupBy("hub").agg(F.count("*").alias("members"))
    buckets = F.lit(max(1, pairs.count() // TILE))
    sides = members.select("hub", F.expr(f"(members - 1) div {TILE} + 1").alias("sides"))
    part = lambda x: F.when(F.col("sides") > 1, F.pmod(F.xxhash64(F.lit(7), x), F.col("sides"))).otherwise(0)
    # small hubs share a tile
    place = F.when(F.col("sides") > 1, F.col("hub")).otherwise(-1 - F.pmod(F.xxhash64(F.lit(8), "hub"), buckets))
    tiled = stored(pairs.join(sides, "hub").select(place.alias("tile"), part("na").alias("ta"), part("nb").alias("tb"), "na", "nb"))
    needed = tiled.select("tile", "ta", "tb", F.explode(F.array("na", "nb")).alias("no")).distinct().join(sets.select("no", "w"), "no").select("tile", "ta", "tb", "no", "w")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one, two = tiled.toDF("t", "a", "b", "na", "nb"), needed.toDF("t2", "a2", "b2", "no", "w")
    one, two = (x.repartition(parts, *x.columns[:3]).groupBy(*x.columns[:3]) for x in (one, two))
    confirm = lambda left, right: _confirmed(left, right, num, den)
    return one.cogroup(two).applyInPandas(confirm, "na long, nb long, intersection long, `union` long").withColumns({c: F.col(f"`{c}`").cast("int") for c in ("intersection", "union")})
