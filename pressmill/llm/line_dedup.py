"""Line dedup by an exact set-similarity join over lines, in DataFrame functions only.

A line's tokens are the distinct lower-cased parts between its spaces.  Tokens are ordered by rarity: their counts over
all texts, kept in a table of fixed size by hash, give the upper bits of a token's number and its hash the lower bits, so
sorting numbers sorts by rarity and any two lines agree on the order.  Lines with equal sets become one set with its first
place.  Sets meet on the tokens of their prefixes, and a length, a positional and a parity filter choose those that may be
near to another; these alone meet again with all their tokens, and are confirmed by their Jaccard similarity.  A later line needs one witness, so all these joins are semi-joins: a group of near lines costs a row
for each of its lines, not for each pair.  Of similar lines the earlier, by doc_id and line number, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, written

#: Slots of the table of counts, a byte each whatever the input, and slots that are collected as one row.
SLOTS, ROW_SLOTS = 1 << 18, 1 << 10
#: Slots that are counted side by side in one row, so that a task's table of counts has a quarter of the rows.
LANES = 4
SET = ["set1", "set2", "n"]


def _tokens(line: Column) -> Column:
    trimmed = F.when(F.endswith(line, F.lit("\r")), F.rtrim(line, F.lit("\r"))).otherwise(line)  # a trim walks over all characters
    return F.array_remove(F.split(F.lower(trimmed), " "), "")


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(_tokens(line), lambda t: F.xxhash64(t)))


def _rarity(docs: DataFrame) -> Column:
    """For each slot of token hashes, four times the binary logarithm of its count over all texts, as an array of bytes."""
    words = docs.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("t"))
    slots = words.select(F.xxhash64("t").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"))
    lane = F.col("slot") % LANES
    counts = slots.groupBy(F.expr(f"slot div {LANES}").alias("at")).agg(*[F.count_if(lane == i).alias(f"n{i}") for i in range(LANES)])
    levels = [F.least(F.lit(120), (4 * F.log2(F.col(f"n{i}") + 1)).cast("int")).cast("string") for i in range(LANES)]
    entry = F.concat_ws(":", (F.col("at") * LANES % ROW_SLOTS).cast("string"), *levels)
    rows = counts.groupBy(F.expr(f"at * {LANES} div {ROW_SLOTS}").alias("row")).agg(F.array_join(F.collect_list(entry), ",").alias("levels"))
    table = ["0"] * SLOTS
    for row in rows.collect():
        for entry in row.levels.split(","):
            at, *found = entry.split(":")
            first = row.row * ROW_SLOTS + int(at)
            table[first : first + LANES] = found
    return F.split(F.lit(",".join(table)), ",").cast("array<tinyint>")  # folded to a constant


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, n, set1, set2 (hash of the set), parity (of the tokens in each of 64 bins) and prefix (hashes of the
    rarest tokens) of each line."""
    rarity = _rarity(docs)

    def number(x: Column) -> Column:
        level = F.coalesce(F.get(rarity, x.bitwiseAND(F.lit(SLOTS - 1)).cast("int")).cast("long"), F.lit(0).cast("long"))  # never null: sorted as longs
        return F.shiftleft(level, 56).bitwiseOR(x.bitwiseAND(F.lit((1 << 56) - 1)))

    # functions of a lambda are not compiled: a token is hashed once, and equal ones are numbered once
    lines = _lines(docs).select("doc_id", "line_no", F.sort_array(F.transform(_hashes(F.col("line")), number)).alias("k"))
    n = F.size("k")
    parity = F.expr("aggregate(k, 0L, (p, x) -> p ^ shiftleft(1L, hash(x)))")  # a shift is by the lower six bits of the hash
    # a second one for longer lines: of the tokens whose hash has an odd bit
    second = F.expr("if(size(k) <= 100, 0L, aggregate(k, 0L, (p, x) -> p ^ if(x & 67108864L = 0L, 0L, shiftleft(1L, hash(x)))))")
    return lines.select(
        "doc_id", "line_no", n.alias("n"), F.xxhash64("k").alias("set1"), F.xxhash64(F.lit(1), "k").alias("set2"), parity.alias("parity"), second.alias("second"),
        F.transform(F.slice("k", 1, n - F.ceil(n * 4 / 5).cast("int") + 1), lambda x: F.hash(x)).alias("prefix"),
    )


def _first(sets: DataFrame) -> DataFrame:
    """Each distinct set with its first place (doc, line) and its number of copies; a written table."""
    first = sets.groupBy(*SET).agg(F.min(F.struct("doc_id", "line_no", "parity", "second", "prefix")).alias("f"), F.count("*").alias("copies"))
    return written(first.select(*SET, "copies", F.col("f.doc_id").alias("doc"), F.col("f.line_no").alias("line"), "f.parity", "f.second", "f.prefix"))


def _may_be_near(x: str, y: str) -> str:
    """Whether two sets may be near: by lengths, by what is left behind the shared token, by parities."""
    nx, ny, ix, iy = f"({x}.n_i >> 32)", f"({y}.n_i >> 32)", f"({x}.n_i & 4294967295L)", f"({y}.n_i & 4294967295L)"
    return (
        # what is left from the shared token on must hold 4/9 of both, which bounds lengths and prefixes, too
        f"9 * least({nx} - {ix}, {ny} - {iy}) >= 4 * ({nx} + {ny})"
        # tokens in one of the two sets alone: those with the odd bit, and the others
        f" and 9 * if({x}.second = 0 or {y}.second = 0, bit_count({x}.parity ^ {y}.parity),"
        f" bit_count({x}.second ^ {y}.second) + bit_count({x}.parity ^ {y}.parity ^ {x}.second ^ {y}.second)) <= {nx} + {ny}"
        f" and ({x}.doc != {y}.doc or {x}.line != {y}.line)"
    )


def _keyed(first: DataFrame) -> DataFrame:
    """A row for each token of the prefixes; sets of three tokens or fewer are near to equal ones alone."""
    rows = first.where("n > 3").select("doc", "line", "n", "parity", "second", F.posexplode("prefix").alias("i", "token"))
    return rows.select("token", "doc", "line", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")).alias("n_i"), "parity", "second")


def _with_tokens(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """doc, line, token of a written table, with the line's token hashes k."""
    places = spots.groupBy("doc", "line").agg(F.collect_set("token").alias("tokens"))
    wanted = written(places.groupBy("doc").agg(F.collect_list(F.struct("line", "tokens")).alias("wanted")))
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.size("wanted")).alias("lines")).first()
    named = wanted.withColumnRenamed("doc", "doc_id")
    found = join_checked(docs.select("doc_id", "text"), named, ["doc_id"], size.n + (size.lines or 0), 64).where("wanted is not null")
    lines = found.select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    own = _hashes(F.get("lines", F.col("w.line")))
    return written(lines.select("doc", F.col("w.line").alias("line"), F.col("w.tokens").alias("tokens"), own.alias("k"))).select("doc", "line", "k", F.explode("tokens").alias("token"))


def _confirmed(lines: DataFrame) -> DataFrame:
    """doc, line of the rows of _with_tokens() that are near to an earlier one; both sides are one shuffle."""
    near = "x.token = y.token and (y.doc < x.doc or (y.doc = x.doc and y.line < x.line)) and 9 * size(array_intersect(x.k, y.k)) >= 4 * (size(x.k) + size(y.k))"
    return lines.alias("x").join(lines.alias("y"), F.expr(near), "left_semi").select("doc", "line")


def _later(docs: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, line_no of the first places of sets that an earlier one is near to; a written table."""
    keyed = _keyed(first)
    x, y = keyed.alias("x"), keyed.alias("y")
    partnered = written(x.join(y, F.expr(f"x.token = y.token and {_may_be_near('x', 'y')}"), "left_semi").select("token", "doc", "line"))
    return written(_confirmed(_with_tokens(docs, partnered)).distinct().toDF("doc_id", "line_no"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id and removed (array of line numbers, from 0) of documents with lines that an earlier line is near to."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    sets = written(_sets(docs)).where("n > 0")
    first = _first(sets)
    near = _later(docs, first).toDF("doc", "line").withColumn("near", F.lit(True))
    judged = join_checked(first, near, ["doc", "line"], near.count(), 16).where("copies > 1 or near").select(*SET, "doc", "line", "near")
    removed = sets.select("doc_id", "line_no", *SET).join(judged, SET).where("near or doc_id != doc or line_no != line")
    return written(removed.select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.collect_list("line_no").alias("removed")))


def lines_left(text: Column, removed: Column) -> Column:
    """The lines of a text without those of the given numbers."""

    def left(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.get(lines, i)), "\n")

    # the lines are a variable of the outer function, so that a text is split once and not for each of its lines
    return F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed (array of line numbers, from 0) and kept (the other lines, joined by line feeds).

    Lines of ``docs.text`` end at line feeds.  A line is removed if a line earlier in the order of doc_id and line number
    has a token set with a Jaccard similarity of 0.8 or more, as judged on the input.  Lines without tokens are never
    removed.  A null text has no lines and stays null; an empty text is one blank line.  Rows that repeat a doc_id count as one
    document.  A row without doc_id is passed through.  Other columns are not read.
    """
    found = repeated_lines(docs)
    total = found.agg(F.count("*").alias("n"), F.sum(F.size("removed")).alias("lines")).first()
    rows = join_checked(docs.select("doc_id", "text"), found, ["doc_id"], 4 * total.n + (total.lines or 0), 8)
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(lines_left(F.col("text"), F.col("removed")))
    return rows.select("doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), kept.alias("kept"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """line_dedup() with the removed lines counted and the kept text as a digest; a null text counts as empty."""
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
