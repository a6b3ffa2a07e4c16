"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets and star-shaped candidates.

1. A pass over the texts hashes each set of word shingles once into ``BANDS * ROWS`` bins; an empty bin copies the bin that
   its own random probe sequence reaches first.  Rows with equal sets are one class from here on.
2. Each band is a bucket key.  A bucket proposes its smallest member to every other member (a star, not all pairs).
   A sketch of parities bounds the symmetric difference of two sets from below, so a pair it rejects is no link.
3. The rest are confirmed on full sets, texts meeting at the star's hub, a hot hub split by salt: first one hub for each
   member, then its other hubs where they are in another component.
4. Links merge into components (alternating large and small stars, on written tables).  A star may miss a link between
   two members that the hub isn't linked with; so buckets that still hold several components propose, in further rounds,
   pairs of members of different components, the likeliest first, until none is left.

A pair with a similarity of 0.8 shares a bucket with a probability of 1 - 3e-6, a closer one with a higher.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_BLANK, int_column, join_checked, mix, released, rolling, shuffle_partitions, split_chunks, word_bounds, word_hashes, written

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
#: Bits of the parity sketch.
PARITIES = 2048
#: Members that a salted part of a hot hub gets.
HUB_PART = 2000
#: Members of a bucket that are compared with as many others at a time.
TILE = 2048

_PROBES = np.random.default_rng(11).integers(0, BINS, (512, BINS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bins of an ascending set of hashes: the least hash of each, empty ones filled from the first full one they probe."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    head = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
    full = np.zeros(BINS, bool)
    full[bins[head]] = True
    out = np.zeros(BINS, np.uint64)
    out[bins[head]] = shingles[head]
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[: 24 if 2 * len(empty) < BINS else 512]
        reach = full[probes[:, empty]]
        at = reach.argmax(0)
        found = reach[at, np.arange(len(empty))]
        source = probes[at, empty]
        for i in np.flatnonzero(~found):  # beyond the table: the next full bin
            source[i] = bins[head][np.searchsorted(bins[head], empty[i]) % len(head)]
        out[empty] = mix(out[source])  # a filled bin differs from the bin it copies
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in bins.reshape(BANDS, ROWS).T:
        h = mix(h ^ row)
    return h


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles of ``size`` lower-cased words; with fewer words, of them all."""
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offsets, NOT_BLANK)
    words = word_hashes(buf, starts, ends)
    h = rolling(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(h[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(mix(rolling(words[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def word_shingles(text: str, size: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as the words themselves."""
    words = text.encode().translate(LOWER.tobytes()).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (hash of the set), bits (parity sketch of the set) and bands of each row."""

    def sign(batches):
        for batch in batches:
            n, keys, bits, bands = [], [], [], []
            for _, buf, offsets in split_chunks(batch):
                for own in shingle_sets(buf, offsets, size):
                    n.append(len(own))
                    if len(own):
                        keys.append((np.bitwise_xor.reduce(mix(own)), own.sum(dtype=np.uint64)))
                    else:
                        keys.append((np.uint64(0), np.uint64(0)))
                    if len(own) * 5 // 4 > len(own):  # a smaller set is near to equal ones alone
                        bins = signature(own)
                        parity = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                        bits.append(np.packbits(parity.astype(np.uint8)).view("<i8"))
                        bands.append(band_keys(bins).view(np.int64))
                    else:
                        bits.append(None)
                        bands.append(None)
            keys = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            longs = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bits, longs), pa.array(bands, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set1", "set2", "bits", "bands"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(sign), "doc_id long, n_shingles long, set1 long, set2 long, bits array<long>, bands array<long>")


def _apart(a: str, b: str) -> Column:
    """A lower bound of the number of shingles in one of two sets alone."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, PARITIES // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _possible(a: str, b: str, n_a: str, n_b: str) -> Column:
    """Whether a pair may have 100 * intersection >= 80 * union: no more than a ninth of both sizes is apart."""
    return (100 * F.least(n_a, n_b) >= 80 * F.greatest(n_a, n_b)) & (9 * _apart(a, b) <= F.col(n_a) + F.col(n_b))


def _similar(pairs: DataFrame, slim: DataFrame, n_slim: int) -> DataFrame:
    """Pairs (a, b) that may be links, with ``apart``."""
    for side in ("a", "b"):
        own = slim.select(F.col("doc_id").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n_shingles").alias(f"n_{side}"))
        pairs = join_checked(pairs, own, [side], n_slim, PARITIES // 8 + 32)
    return pairs.where(_possible("bits_a", "bits_b", "n_a", "n_b")).select("a", "b", _apart("bits_a", "bits_b").alias("apart"))


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of a written table with 100 * intersection >= 80 * union on full sets; a is a star's hub."""
    parts = shuffle_partitions(docs.sparkSession)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("member"))
    hubs = salts.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = written(members.unionByName(hubs))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # of rows that repeat a doc_id one stands for it, as in the rest of the operator
    met = join_checked(texts, wanted, ["doc_id"], wanted.count(), 40).where("hub is not null")
    met = met.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "member")

    def linked(x, y) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True)) if isinstance(x, np.ndarray) else len(x & y)
        return 100 * both >= 80 * (len(x) + len(y) - both)

    def compare(batches):
        hub, own, words = None, None, None
        for batch in batches:
            a, b = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "doc_id", "member")), batch.column("text"), strict=True)
            sets = [s for _, buf, offsets in split_chunks(batch) for s in shingle_sets(buf, offsets, size)]
            for (h, doc, member, text), shingles in zip(rows, sets, strict=True):
                if not member:
                    hub, own, words = h, shingles, text
                elif h == hub and linked(own, shingles):  # by hashes, which are only ever equal too often; then by words
                    if not isinstance(words, set):
                        words = word_shingles(words.as_py(), size)
                    if linked(words, word_shingles(text.as_py(), size)):
                        a.append(h)
                        b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return written(met.mapInArrow(released(compare), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, root (least node reachable) for every node of ``links`` (a, b); a written table.

    Alternates the large-star and small-star steps until the links are stars; every step is an aggregate and a join on
    written links, so no node's links meet in one task.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = written(small.select("x.a", "x.b").where("a > b").distinct())
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose members are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links; each node's link to its root stands for its earlier links."""
    if roots is not None:
        links = links.unionByName(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return written(components(links))


def _across(placed: DataFrame) -> DataFrame:
    """a, b, apart of possible links between members of a bucket in different components.

    Of two such members one at least is outside the bucket's main component, so these meet all members, in tiles of
    ``TILE`` by ``TILE`` rows.
    """
    parts = shuffle_partitions(placed.sparkSession)
    stray = F.col("root") != F.col("main")
    tiles = placed.groupBy("bucket").agg(F.ceil(F.count_if(stray) / TILE).cast("int").alias("across"), F.ceil(F.count("*") / TILE).cast("int").alias("down"))
    rows = placed.join(tiles, "bucket").withColumn("h", F.xxhash64("doc_id"))

    def side(name: int, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        some = rows.where(stray) if name == 0 else rows
        tiled = some.select("bucket", "doc_id", "root", "n_shingles", "bits", F.pmod("h", F.col(own)).cast("int").alias(own), every)
        return tiled.select("bucket", "across", "down", F.lit(name).alias("side"), "doc_id", "root", "n_shingles", "bits")

    met = side(0, "across", "down").unionByName(side(1, "down", "across"))
    met = met.repartition(parts, "bucket", "across", "down").sortWithinPartitions("bucket", "across", "down", "side")

    def compare(x, y):
        out = []
        for i in range(0, len(x[0]), 32):
            doc, root, n, bits = (c[i : i + 32] for c in x)
            apart = np.bitwise_count(bits[:, None, :] ^ y[3][None]).sum(2, dtype=np.int64)
            small, large = np.minimum(n[:, None], y[2][None]), np.maximum(n[:, None], y[2][None])
            p, q = np.nonzero((root[:, None] != y[1][None]) & (100 * small >= 80 * large) & (9 * apart <= small + large))
            out.append(np.stack([np.minimum(doc[p], y[0][q]), np.maximum(doc[p], y[0][q]), apart[p, q]]))
        return np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)

    def tile_pairs(batches):
        held, key = [], None

        def settle():
            table = [np.concatenate(c) for c in zip(*held, strict=True)]
            x = table[0] == 0
            a, b, apart = np.unique(compare([c[x] for c in table[1:]], [c[~x] for c in table[1:]]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart)], ["a", "b", "apart"])

        for batch in batches:
            keys = np.stack([int_column(batch, c) for c in ("bucket", "across", "down")], 1)
            columns = [int_column(batch, c) for c in ("side", "doc_id", "root", "n_shingles")]
            columns.append(batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, PARITIES // 64))
            start = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1]) if len(keys) else []
            for i, j in zip(start, [*start[1:], len(keys)], strict=True):
                if held and tuple(keys[i]) != key:
                    yield settle()
                    held = []
                key = tuple(keys[i])
                held.append([c[i:j] for c in columns])
        if held:
            yield settle()

    return met.mapInArrow(tile_pairs, "a long, b long, apart long")


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept for each row.

    ``docs`` has doc_id (an integer) and text.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer
    words than a shingle is one shingle.  Documents are linked when 100 * intersection >= 80 * union of their sets.  A null
    or wordless text has an empty set, is linked with nothing and kept.  Rows that repeat a doc_id get the same component.
    A row without doc_id is linked with nothing: component_id null, kept.
    """
    signed = written(_signed(docs, shingle))
    classes = signed.where("n_shingles > 0").groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = written(classes)
    members = signed.where("bands is not null").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set1", "set2", "n_shingles"], "left_semi")
    members = members.dropDuplicates(["doc_id"])
    keyed = members.select("doc_id", F.explode("bands").alias("bucket"))
    stars = keyed.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(keyed.join(stars, "bucket"))  # members of buckets of several
    slim = written(members.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "bits"))
    n_slim = slim.count()
    proposed = written(_similar(shared.where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), slim, n_slim))

    roots, most = None, 1
    while True:  # a member's smallest hub, then four of those in other components, then sixteen ...
        crossing = proposed if roots is None else _crossing(proposed, roots)
        rank = F.row_number().over(Window.partitionBy("b").orderBy("a" if roots is None else F.col("apart"), "a"))
        chosen = written(crossing.withColumn("rank", rank).where(f"rank <= {most}").select("a", "b"))
        if chosen.isEmpty():
            break
        roots = _merged(roots, _confirmed(docs, chosen, shingle))
        proposed = written(proposed.join(chosen, ["a", "b"], "left_anti"))
        most *= 4

    tested, most = None, 4
    while roots is not None:
        label = F.coalesce("root", "doc_id").alias("root")
        placed = shared.select("bucket", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", label)
        sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        placed = written(placed.join(main, "bucket").join(slim, "doc_id"))
        near = _across(placed).distinct()
        if tested is not None:
            near = near.join(tested, ["a", "b"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("x").orderBy("apart", "a", "b"))
        chosen = written(near.select("*", F.explode(F.array("a", "b")).alias("x")).withColumn("rank", rank).where(f"rank <= {most}").select("a", "b").distinct())
        if chosen.isEmpty():
            break
        tested = chosen if tested is None else tested.unionByName(chosen)
        roots = _merged(roots, _confirmed(docs, chosen, shingle))
        most *= 8
    if roots is None:
        roots = signed.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")).limit(0)

    named = signed.select("doc_id", "n_shingles", "set1", "set2").join(classes, ["set1", "set2", "n_shingles"], "left")
    named = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    out = named.select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
    rest = _signed(docs.where("doc_id is null").select(F.lit(0).alias("doc_id"), "text"), shingle)
    nulls = rest.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nulls).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

