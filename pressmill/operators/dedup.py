"""Exact dedup against stored mentions, keyed dedup, upserts and similarity joins between mentions."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_text, words
from ..sources.stored import stored, unused
from .similar_sets import similar_sets


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each value of the keys, the first in a total order. Null keys equal one another.

    A key is its digest, so that rows don't travel under whole texts, and each task keeps one row a key before any does.
    """
    kinds = dict(df.dtypes)
    named = [F.when(F.col(k).isNull(), "n").otherwise(F.concat(F.lit("v"), F.sha2(F.col(k).cast("string"), 256))) if kinds[k] == "string" else F.col(k) for k in keys]
    rank = F.row_number().over(Window.partitionBy(*named).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedup_auto(df: DataFrame, order: list[str]) -> DataFrame:
    """By url where there is that column, else by text and the first date column present."""
    if "url" in df.columns:
        return keep_first(df, ["url"], order)
    dates = [c for c in ("published_at", "published_date", "date", "created_at") if c in df.columns]
    return keep_first(df, ["text", *dates[:1]], order)


def _keyed(df: DataFrame, text: str) -> DataFrame:
    normal = normalize_text(F.col(text))
    return df.withColumn("_norm", normal).withColumn("_key", F.sha2(normal, 256))


def match_existing(new: DataFrame, old: DataFrame, tenant: str = "user_id", text: str = "text", key: str = "entry_id") -> DataFrame:
    """entry_id of each new row and existing_ids, ascending, of the tenant's stored rows with an equal normalised text."""
    stored = _keyed(old, text).where("_norm != ''").groupBy(tenant, "_key").agg(F.sort_array(F.collect_set(key)).alias("existing_ids"))
    return _keyed(new, text).where("_norm != ''").join(stored, [tenant, "_key"]).select(key, "existing_ids")


def least_existing(new: DataFrame, old: DataFrame, tenant: str = "user_id", text: str = "text", key: str = "entry_id") -> DataFrame:
    """entry_id of each new row, existing_id, the least of the tenant's stored rows with an equal normalised text, and existing_count:
    match_existing() for texts that any number of stored rows may have.  Their ids are text_members() of the row's class."""
    stored_rows = text_members(old, tenant, text, key).groupBy(tenant, "text_class").agg(F.min(key).alias("existing_id"), F.count("*").alias("existing_count"))
    return text_members(new, tenant, text, key).join(stored_rows, [tenant, "text_class"]).select(key, "text_class", "existing_id", "existing_count")


def text_members(df: DataFrame, tenant: str = "user_id", text: str = "text", key: str = "entry_id") -> DataFrame:
    """tenant, text_class (digest of the normalised text) and key of each row with a text: an id a row, not a list a text."""
    return _keyed(df, text).where("_norm != ''").select(tenant, F.col("_key").alias("text_class"), key)


def dedup_split(new: DataFrame, old: DataFrame, order: list[str], tenant: str = "user_id", text: str = "text") -> DataFrame:
    """The new rows with ``fate``: empty, external (stored already), internal (repeats a new row) or unique."""
    stored = _keyed(old, text).select(tenant, "_key").distinct().withColumn("_stored", F.lit(True))
    rank = F.row_number().over(Window.partitionBy(tenant, "_key").orderBy(*order))
    judged = _keyed(new, text).join(stored, [tenant, "_key"], "left").withColumn("_rank", rank)
    fate = F.when(F.col("_norm") == "", "empty").when(F.col("_stored"), "external").when(F.col("_rank") > 1, "internal").otherwise("unique")
    return judged.withColumn("fate", fate).drop("_norm", "_key", "_stored", "_rank")


def dedup_stats(judged: DataFrame) -> DataFrame:
    """One row: total, unique_rows, external_duplicates, internal_duplicates, empty_rows."""
    fates = {"unique_rows": "unique", "external_duplicates": "external", "internal_duplicates": "internal", "empty_rows": "empty"}
    return judged.agg(F.count("*").alias("total"), *[F.count_if(F.col("fate") == v).alias(k) for k, v in fates.items()])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], overwrite_with_null: bool = False) -> DataFrame:
    """Existing rows updated by incoming ones with the same keys, and the other incoming rows. Null updates nothing unless told."""
    rest = [c for c in existing.columns if c not in keys]
    left, right = existing.withColumn("_old", F.lit(True)), incoming.withColumn("_new", F.lit(True))
    both = left.alias("o").join(right.alias("n"), keys, "full_outer")

    def value(c: str):
        new = F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
        if overwrite_with_null and c in incoming.columns:
            return F.when(F.col("_new"), new).otherwise(F.col(f"o.{c}")).alias(c)
        return F.coalesce(new, F.col(f"o.{c}")).alias(c)

    return both.select(*keys, *map(value, rest))


def insert_if_absent(df: DataFrame, existing: DataFrame, key: str = "title") -> DataFrame:
    return df.join(existing.select(key).distinct(), key, "left_anti")


def _word_classes(df: DataFrame, share: tuple[int, int], key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their word set's digest (set); the distinct sets with a number (no), their first row (key, size) and their
    longest (size negated, key); na < nb, intersection, union of similar sets that differ.  The first two are written tables."""
    sets = df.select(key, F.length(text).alias("size"), F.array_sort(words(F.col(text))).alias("w")).where("size(w) > 0").withColumn("set", F.unhex(F.sha2(F.array_join("w", " "), 256)))
    sets = stored(sets)  # texts are taken apart once
    first, best = F.struct(F.col(key).alias("key"), "size"), F.struct((-F.col("size")).alias("size"), F.col(key).alias("key"))
    classes = sets.groupBy("set").agg(F.first("w").alias("w"), F.min(first).alias("first"), F.min(best).alias("best"))
    classes = stored(classes.withColumn("no", F.monotonically_increasing_id()))
    return sets.select(key, "size", "set"), classes, similar_sets(classes, share)


def near_dup_classes(df: DataFrame, share: tuple[int, int] = (85, 100), key: str = "entry_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What near_dups_jaccard() says, without a pair of rows: ``key``, class_id, dropped of each row with words, and a, b
    (a < b), intersection, union of similar classes.

    A class is the rows of one word set, named by its first.  A row is dropped if a row of its class or of a similar one
    is longer, or as long and earlier.
    """
    sets, classes, met = _word_classes(df, share, key, text)
    met = stored(met)
    sides = met.select(F.col("na").alias("no"), F.col("nb").alias("other")).union(met.select("nb", "na"))
    others = sides.join(classes.select(F.col("no").alias("other"), "best"), "other").groupBy("no").agg(F.min("best").alias("near"))
    named = classes.select("no", "set", F.col("first.key").alias("class_id"), "best").join(others, "no", "left")
    members = sets.join(named.select("set", "class_id", F.least("best", "near").alias("_best")), "set").select(key, "class_id", (F.col("_best.key") != F.col(key)).alias("dropped"))
    name = classes.select("no", F.col("first.key").alias("name"))
    pairs = met.join(name.toDF("na", "ca"), "na").join(name.toDF("nb", "cb"), "nb")
    return members, pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "intersection", "union")


def near_dups_jaccard(df: DataFrame, share: tuple[int, int] = (85, 100), key: str = "entry_id", text: str = "text") -> DataFrame:
    """a, b, drop_id, intersection, union of similar pairs (a < b), the shorter text of a pair to go, of equal ones the later.

    Rows with equal word sets are paired with the first of them only, and different sets through their first rows, so n rows
    of one set give n - 1 pairs.  near_dup_classes() has the decision on every row.
    """
    sets, classes, met = _word_classes(df, share, key, text)
    own = sets.join(classes.select("set", "first", F.size("w").alias("n")), "set").where(F.col(key) != F.col("first.key"))
    same = own.select(F.col("first.key").alias("a"), F.col(key).alias("b"), F.col("first.size").alias("la"), F.col("size").alias("lb"), F.col("n").alias("intersection"), F.col("n").alias("union"))
    first = classes.select("no", "first")
    other = met.join(first.toDF("na", "x"), "na").join(first.toDF("nb", "y"), "nb")
    low, high = F.least("x", "y"), F.greatest("x", "y")  # by key, which comes first in them
    other = other.select(low["key"].alias("a"), high["key"].alias("b"), low["size"].alias("la"), high["size"].alias("lb"), "intersection", "union")
    drop = F.when(F.col("la") < F.col("lb"), F.col("a")).otherwise(F.col("b"))
    return same.unionByName(other).select("a", "b", drop.alias("drop_id"), "intersection", "union")


def least_matches(total: int, threshold: float) -> int:
    """The least number of matches that gives two texts of so many characters together a ratio of the threshold."""
    need = int(threshold * total / 2)
    while need > 0 and 2.0 * (need - 1) / total >= threshold:
        need -= 1
    while 2.0 * need < threshold * total and 2.0 * need / total < threshold:
        need += 1
    return need


#: Places that two texts' matcher is given as arrays at most.
MET = 1 << 20


class _Bounded(SequenceMatcher):
    def set_seq2(self, b: str):
        self.b, self.indexed = b, False
        codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}

    def reaches(self, threshold: float) -> bool:
        """Whether a common subsequence, which the blocks form, can be that long: bit-parallel, ended once what is left can't do.

        A match further on in b than the characters that b can spare, counted from its place in a, is in no long enough
        subsequence, so the bits of b enter as far as that alone.
        """
        n, m = len(self.b), len(self.a)
        need = least_matches(n + m, threshold)
        if need > min(n, m):
            return False
        step, v, width = m // 32 + 1, 0, 0  # as many zeros below a place as the longest common subsequence up to it
        places = self.places.get
        for j in range(0, m, step):
            done = min(m, j + step)
            wider = min(n, done + n - need)
            v |= ((1 << (wider - width)) - 1) << width
            width = wider
            for c in self.a[j:done]:
                u = v & places(c, 0)
                v = (v + u) | (v - u)
            v &= (1 << width) - 1
            below = min(n, max(0, n - m + done))  # the best place to go on from: both rests are as long
            if below - (v & ((1 << below) - 1)).bit_count() + min(n - below, m - done) < need:
                return False
        return True

    def ratio_from(self, threshold: float) -> float:
        """ratio() where it reaches the threshold, else some bound of it below the threshold.

        Each block found tells how much the ranges beside it can still match at most; the order of ranges changes no block.
        """
        if not self.indexed:  # most texts are never matched, only bounded
            b, self.b, self.indexed = self.b, None, True
            super().set_seq2(b)
        total = len(self.a) + len(self.b)
        bound = min(len(self.a), len(self.b))
        ranges = [(-bound, 0, len(self.a), 0, len(self.b), self._met())]
        while ranges and 2.0 * bound / total >= threshold:
            most, alo, ahi, blo, bhi, met = heapq.heappop(ranges)
            i, j, k = self.find_longest_match(alo, ahi, blo, bhi) if met is None else self._longest(alo, ahi, blo, bhi, met)
            bound += most + k
            if k:
                for beside in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                    if open_ := min(beside[1] - beside[0], beside[3] - beside[2]):
                        bound += open_
                        heapq.heappush(ranges, (-open_, *beside, None if met is None else _within(met, *beside)))
        return 2.0 * bound / total if total else 1.0

    def _met(self) -> np.ndarray | None:
        """Rows i, j, k: places of one character in both texts, which the matcher doesn't leave out, and how many such places
        in a row end there, in the order in which it meets them; None if they are too many."""
        places = [self.b2j.get(c) for c in self.a]
        if sum(len(x) for x in places if x) > MET:
            return None
        i = np.repeat(np.arange(len(places)), [len(x) if x else 0 for x in places])
        j = np.fromiter((y for x in places if x for y in x), np.int64, len(i))
        at = i * (len(self.b) + 1) + j
        before = at - len(self.b) - 2  # the place before in both texts
        found = np.searchsorted(at, before)
        heads = (at[np.minimum(found, len(at) - 1)] != before) | (j == 0) if len(at) else np.zeros(0, bool)
        k = np.ones(len(at), np.int64)
        open_ = np.flatnonzero(~heads)
        while len(open_):  # one further place in a row each time
            longer = k[found[open_]] + 1
            changed = longer != k[open_]
            k[open_[changed]] = longer[changed]
            open_ = open_[changed]
        return np.stack([i, j, k])

    def _longest(self, alo: int, ahi: int, blo: int, bhi: int, met: np.ndarray) -> tuple[int, int, int]:
        """find_longest_match() from the places met in these ranges."""
        a, b, i, j, k = self.a, self.b, alo, blo, 0
        if met.shape[1]:
            within = np.minimum(met[2], np.minimum(met[0] - alo, met[1] - blo) + 1)
            first = int(within.argmax())
            k = int(within[first])
            i, j = int(met[0, first]) - k + 1, int(met[1, first]) - k + 1
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return i, j, k


def _within(met: np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> np.ndarray:
    lo, hi = np.searchsorted(met[0], (alo, ahi))
    met = met[:, lo:hi]
    return met[:, (met[1] >= blo) & (met[1] < bhi)]


def seq_ratio(a: Column, b: Column, threshold: float) -> Column:
    """Ratio of matching characters of two texts, the earlier row's first; below the threshold some value below it."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a))
        matcher, a, b = None, a.to_numpy(), b.to_numpy()
        for i in sorted(np.flatnonzero(a != b), key=b.__getitem__):  # a text's index serves all pairs of the batch
            if matcher is None or matcher.b != b[i]:
                matcher = _Bounded(None, "", b[i])
            matcher.set_seq1(a[i])
            out[i] = matcher.ratio_from(threshold) if matcher.reaches(threshold) else -1
        return pd.Series(out)

    return ratio(a, b)


#: Classes that characters fall into for their counts; characters of a run, and classes that runs fall into, coarse and fine.
LETTERS = 64
RUN, COARSE, FINE = 4, 1 << 10, 1 << 12


def _seeds(codes: np.ndarray) -> int:
    """Characters of the matcher's second text from which it begins a block; of 200 or more it leaves out the frequent ones."""
    if len(codes) < 200:
        return len(codes)
    _, counts = np.unique(codes, return_counts=True)
    return int(counts[counts <= len(codes) // 100 + 1].sum())


def _runs(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of RUN characters, whose upper bits are its class."""
    out = np.zeros(max(0, len(codes) - RUN + 1), np.uint32)
    for d in range(RUN):
        out += codes[d : d + len(out)]
        out *= np.uint32(0x9E3779B1)
    return out


class _Runs:
    """Least numbers of runs that alike texts share.

    The matcher's blocks have a character between them that isn't matched, and each, but one at the start of both
    texts, holds a character it begins with.  So alike texts match in few blocks, of which each shares all runs inside it.
    """

    def __init__(self, codes: list[np.ndarray], threshold: float):
        self.codes, self.threshold, self.all = codes, threshold, {}
        self.n = np.array([len(c) for c in codes], np.int64)
        self.seeds = np.array([_seeds(c) for c in codes], np.int64)
        self.fine = np.stack([np.bincount(_runs(c) >> np.uint32(20), minlength=FINE) for c in codes]).astype(np.int32)
        self.coarse = self.fine.reshape(len(codes), FINE // COARSE, COARSE).sum(1, dtype=np.int32)

    def least(self, i: int, j: np.ndarray) -> np.ndarray:
        """Shared runs of text i and each later one in j, if these are alike."""
        total = self.n[i] + self.n[j]
        need = np.ceil(self.threshold * total / 2).astype(np.int64) - 1  # of matched characters; one less for rounding
        return need - (RUN - 1) * (1 + np.minimum(self.seeds[j], total - 2 * need))

    def may_be_alike(self, i: int, j: np.ndarray) -> np.ndarray:
        for counts in (self.coarse, self.fine):
            j = j[np.minimum(counts[i], counts[j]).sum(1) >= self.least(i, j)]
        if self.n[i] <= FINE or not len(j):
            return j
        # classes hold several runs of a long text each, so its runs themselves are counted
        return j[np.array([self.shared(i, int(x)) for x in j]) >= self.least(i, j)]

    def shared(self, i: int, j: int) -> int:
        for x in (i, j):
            if x not in self.all:
                self.all[x] = np.unique(_runs(self.codes[x]), return_counts=True)
        (one, many), (two, often) = self.all[i], self.all[j]
        _, x, y = np.intersect1d(one, two, assume_unique=True, return_indices=True)
        return int(np.minimum(many[x], often[y]).sum())


def _alike(texts: list[str], first: int, window: int, threshold: float):
    """(i, j, ratio) of alike texts, for each i before ``first`` and each j up to window - 1 after it."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    n = np.array([len(c) for c in codes], np.int64)
    letters = np.stack([np.bincount(c % LETTERS, minlength=LETTERS) for c in codes]).astype(np.int32)
    runs = _Runs(codes, threshold)
    found: dict[int, list[int]] = {}
    for i in range(first):
        j = np.arange(i + 1, min(len(texts), i + window))
        total = n[i] + n[j]
        j = j[2 * np.minimum(n[i], n[j]) >= threshold * total]  # no more characters match than the shorter has
        j = j[2 * np.minimum(letters[i], letters[j]).sum(1) >= threshold * (n[i] + n[j])]  # nor of any class
        for other in runs.may_be_alike(i, j).tolist():
            if texts[i] == texts[other]:
                yield i, other, 1.0
            elif min(n[i], n[other]) >= 10:
                found.setdefault(other, []).append(i)
    for j, earlier in found.items():  # a text's index serves all that it is compared with
        matcher = _Bounded(None, "", texts[j])
        for i in earlier:
            matcher.set_seq1(texts[i])
            if matcher.reaches(threshold) and (ratio := matcher.ratio_from(threshold)) >= threshold:
                yield i, j, ratio


def near_dups_seq(df: DataFrame, order: str = "entry_id", text: str = "text", threshold: float = 0.85, window: int = 1000, block: int = 500) -> DataFrame:
    """a, b, ratio, drop_id of rows at most ``window`` - 1 apart in order whose normalised texts are alike.

    Rows are numbered in order, and a block of rows meets the ``window`` rows behind it, in a group of bounded size.  Pairs
    are proposed by array operations: lengths and counts of characters must allow the ratio.  Equal texts need no matcher;
    others pass a bit-parallel bound on their longest common subsequence, which ends as soon as the ratio is out of reach, and
    then the matcher itself.  Texts under ten characters must be equal.
    """
    kind = df.schema[order].dataType.simpleString()
    rows = df.select(F.col(order).alias("k"), normalize_text(F.col(text)).alias("s"), F.length(text).alias("raw")).where("s != ''")
    rows = numbered(stored(rows), "k")  # else texts are normalised twice, as the bounds of ranges are sampled first
    span = (window - 2) // block + 1
    own = F.expr(f"seq div {block}")
    met = rows.withColumn("b", F.explode(F.sequence(F.greatest(own - span, F.lit(0)), own)))
    # little text is much work for the matcher, so that Spark's own sizes of partitions would be too large
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", ignore_index=True)
        first = int((group["seq"] // block == key[0]).sum())
        pairs = list(_alike(group["s"].tolist(), first, window, threshold)) if first else []
        i, j, ratio = zip(*pairs, strict=True) if pairs else ((), (), ())
        one, two = (group.iloc[list(x)].reset_index(drop=True) for x in (i, j))
        return pd.DataFrame({"a": one["k"], "b": two["k"], "ratio": np.round(np.array(ratio, np.float64), 6), "drop_id": one["k"].where(one["raw"] < two["raw"], two["k"])})

    return met.select("b", "seq", "k", "s", "raw").repartition(parts, "b").groupBy("b").applyInPandas(compare, f"a {kind}, b {kind}, ratio double, drop_id {kind}")


def numbered(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """Rows with ``seq``, their place from 0 in the order of a key; rows of equal keys in some order, the same for every use.

    Two phases over what is written in between: ranges of the key are sorted, each in its task, and written with their place in
    the range; then the ranges' sizes are added up and each range gets what lies before it.  Both phases read one
    division into ranges, which evaluating it twice wouldn't give, as bounds are sampled.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part, at = (unused(df, x) for x in ("_place", "_part", "_at"))
    # the upper bits of the id are the range, the lower 33 the place in it
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(place, F.monotonically_increasing_id())
    local = stored(ranged).withColumns({part: F.shiftright(place, 33), at: F.col(place).bitwiseAND((1 << 33) - 1)})
    sizes = local.groupBy(part).agg(F.max(at).alias("_last"))  # one row a range
    before = F.coalesce(F.sum(F.col("_last") + 1).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(part).alias("_range"), before.alias("_before"))
    return local.join(F.broadcast(starts), F.col(part) == F.col("_range")).withColumn("seq", F.col("_before") + F.col(at)).drop(place, part, at, "_range", "_before")


def corroborate(mentions: DataFrame, evidence: DataFrame, threshold: float = 0.3, least: int = 2) -> DataFrame:
    """entry_id, sources and verified: evidence rows (entry_id, url, text) alike enough, from ``least`` different URLs.

    Either side may have distinct ``words`` in place of its text, so that a text in several rows is taken apart once.  Rows
    meet with marks of 16 bits of their words, which bound what two sets share; only rows that may be alike meet with their words.
    """
    from ..functions.text import jaccard

    mentions, evidence = (x if "words" in x.columns else x.withColumn("words", words(F.col("text"))) for x in (mentions, evidence))
    said, proof = mentions.select("entry_id", "words"), evidence.where("url is not null").select("entry_id", "url", "words")
    marks = F.array_distinct(F.transform("words", lambda w: (F.pmod(F.hash(w), F.lit(1 << 16)) - (1 << 15)).cast("short")))

    def marked(df: DataFrame, side: str) -> DataFrame:
        rows = df.where("size(words) > 0").select(*(c for c in df.columns if c != "words"), F.size("words").alias(f"n{side}"), marks.alias(f"m{side}"))
        return rows.withColumn(f"over{side}", F.col(f"n{side}") - F.size(f"m{side}"))  # words that share a mark

    met = marked(said, "a").join(marked(proof, "b"), "entry_id")
    shared = met.withColumn("most", F.size(F.array_intersect("ma", "mb")) + F.least("overa", "overb"))
    near = stored(shared.where(F.try_divide("most", F.col("na") + F.col("nb") - F.col("most")) > threshold).select("entry_id", "url").distinct())
    own = said.join(near.select("entry_id").distinct(), "entry_id", "left_semi").select("entry_id", F.col("words").alias("m"))
    alike = proof.join(near, ["entry_id", "url"], "left_semi").join(own, "entry_id").where(jaccard(F.col("m"), F.col("words")) > threshold)
    found = alike.groupBy("entry_id").agg(F.count_distinct("url").alias("sources"))
    counted = said.select("entry_id").distinct().join(found, "entry_id", "left").select("entry_id", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"))
    return counted.withColumn("verified", F.col("sources") >= least)
