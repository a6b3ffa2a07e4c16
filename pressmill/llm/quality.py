"""Quality rules whose thresholds follow the corpus: quantile sketches for each language and source, then a joined filter.

1. One pass over the texts gives each document's counts; the base rules (too short, too repetitive) need nothing else.
2. A document's signals are ratios as integers.  A sketch counts a signal's values in buckets of a 32nd of their size (below
   32: one a value); sketches merge by adding counts, in any order and with one result, so partial sketches of tasks merge
   to those of each (language, source), and these to the sketches of a language, of a source and of the whole corpus.
3. A signal's fence lies ``SPREAD`` times as far from the median as its 95th (5th) percentile, and a margin further.
   Cutting at a percentile would drop a share of every group, however clean; the fence drops outliers alone.
4. Documents join the fences of the narrowest group that is large enough.  A group is if it has ``LEAST_DOCS`` documents and
   at least one of ``MOST_GROUPS`` equal shares of the corpus, so there are at most ``MOST_GROUPS`` groups of a kind and the
   joined side is of bounded size, whatever stands in the columns lang and source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, written

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Base rules: least words, and the most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents that a group needs for fences of its own, and the most groups of a kind that can have them.
LEAST_DOCS, MOST_GROUPS = 200, 4096
#: Of a signal: its numerator, denominator and scale, the margin of its fence, and whether it also has a lower one.
SIGNALS = {
    "word_length": ("word_chars", "n_words", 1000, 1000, True),
    "symbol_share": ("n_symbols", "n_words", 10000, 500, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 10000, 3000, False),
    "repeat_share": ("n_repeat_words", "n_words", 10000, 1000, False),
}
SPREAD = 3
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """How many of the words stand in a window of three words that is found twice or more among them."""
    n, seen = len(words), {}
    if n < 4:
        return 0
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:  # then the numbers of pairs, so that three words fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, size = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = size[window] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def document_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for a text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - blanks, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of each row of ``docs`` (doc_id, text, and lang and source, null where absent)."""
    present = {c.lower() for c in docs.columns}
    keys = [F.col(c).cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            rows = np.array([document_counts(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(x) for x in rows.T]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", *COUNTS])

    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = docs.select("doc_id", *keys, "text").mapInArrow(released(count), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def signal(name: str) -> Column:
    top, bottom, scale, _, _ = SIGNALS[name]
    return F.expr(f"({scale} * {top}) div greatest({bottom}, 1)")


def bucket_of(value: Column) -> Column:
    """The sketch's bucket of a value from 0: one a value below 32, then 32 for each power of two."""
    power = F.length(F.bin(value)) - 6
    return F.when(value < 32, value).otherwise(32 * power + F.call_function("shiftright", value, power.cast("int"))).cast("int")


def bucket_edges(bucket: Column) -> tuple[Column, Column]:
    """The least and the greatest value of a bucket."""
    power = F.floor(bucket / 32).cast("int") - 1
    low = F.when(bucket < 32, bucket.cast("long")).otherwise(F.call_function("shiftleft", (32 + bucket % 32).cast("long"), F.greatest(power, F.lit(0))))
    return low, low + F.when(bucket < 32, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(power, F.lit(0))) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, signal, bucket, n: the sketch of each signal for each (language, source), of rows that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), bucket_of(signal(s)).alias("bucket")) for s in SIGNALS))).alias("x")
    return rows.where("not base_failed").select("lang", "source", each).groupBy("lang", "source", "x.signal", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """level, lang, source, signal, bucket, n: sketches of (0) language and source, (1) language, (2) source, (3) all."""
    none = F.lit(None).cast("string")
    levels = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, F.col("source")), (3, none, none)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), a.alias("lang"), b.alias("source")) for i, a, b in levels))).alias("x")
    return sketch.select(each, "signal", "bucket", "n").groupBy("x.level", "x.lang", "x.source", "signal", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, percent: list[int]) -> DataFrame:
    """For each level, lang, source and signal of merged(): its size, and for each p the edges low_p and high_p of the bucket
    of the value of rank ceil(p * size / 100)."""
    group = Window.partitionBy("level", "lang", "source", "signal")
    low, high = bucket_edges(F.col("bucket"))
    ranked = sketch.withColumns({"size": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bucket")), "low": low, "high": high})
    found = [F.min(F.when(F.col("upto") >= F.expr(f"({p} * size + 99) div 100"), F.col(c))).alias(f"{c}_{p}") for p in percent for c in ("low", "high")]
    return ranked.groupBy("level", "lang", "source", "signal").agg(F.max("size").alias("size"), *found)


def fences(sketch: DataFrame, least_docs: int = LEAST_DOCS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """level, lang, source, and low_/high_ of each signal, for each group that is large enough; the whole corpus always is."""
    found = quantiles(merged(sketch), [5, 50, 95])
    total = found.where("level = 3").agg(F.max("size").alias("total"))
    found = found.join(F.broadcast(total), F.expr(f"level = 3 or (size >= {least_docs} and {most_groups} * size >= total)"))  # one row
    at = []
    for s, (_, _, _, margin, two_sided) in SIGNALS.items():
        high = F.col("high_50") + SPREAD * (F.col("high_95") - F.col("high_50")) + margin
        low = F.col("low_50") - SPREAD * (F.col("low_50") - F.col("low_5")) - margin if two_sided else F.lit(0)
        at += [F.max(F.when(F.col("signal") == s, low)).alias(f"low_{s}"), F.max(F.when(F.col("signal") == s, high)).alias(f"high_{s}")]
    return found.groupBy("level", "lang", "source").agg(*at)


def quality_rules(docs: DataFrame, least_docs: int = LEAST_DOCS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, level, failed (names of signals
    outside their fences) for each row of ``docs`` (doc_id, text, lang, source; the last two may be absent).

    Words are ``[^\\x20\\x09-\\x0D]+``.  A document is kept if it passes the base rules and all its signals lie within the
    fences of its group.  A null or empty text has no words and fails the base rules.  Null in lang or source is a value
    like another.  Rows are independent but for the fences: repeated rows count and are judged each, a null doc_id stays.
    An empty table gives an empty one.
    """
    rows = written(counted(docs))
    found = written(fences(sketches(rows), least_docs, most_groups))
    out = rows.withColumn("_3", F.lit(3))
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (2, ["source"]), (3, [])):
        side = F.broadcast(found.where(F.col("level") == level).select(F.struct(F.col("level"), *(f"{e}_{s}" for s in SIGNALS for e in ("low", "high"))).alias(f"f{level}"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.lit(3).alias("_level")))
        on = F.col("_3") == F.col("_level")
        for key in keys:
            on &= F.col(key).eqNullSafe(F.col(f"_{key}"))
        out = out.join(side, on, "left").drop("_lang", "_source", "_level")
    out = out.withColumn("f", F.coalesce("f0", "f1", "f2", "f3"))
    outside = F.array(*(F.when((signal(s) < F.col(f"f.low_{s}")) | (signal(s) > F.col(f"f.high_{s}")), F.lit(s)) for s in SIGNALS))
    out = out.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(outside)))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("f.level").alias("level"), "failed")
