"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

The filter is dealt into blocks by hash range, and grows with the rows: 16 bits a row.  Pass one hashes every text's digest to
a block and two bits in it, and keeps, as bitmaps, the bits that more than one row sets; what travels is a few bytes a row,
added up in each task first.  Pass two tests every row's bits: a row with a bit of its own is unique and passes straight
through; the rest, the repeated ones and some per cent of the others, are grouped by their SHA-256.  Bitmaps are broadcast up
to 32 MB (some 16 million rows); beyond that digests meet their block by a join, never texts.  Groups are counted with
map-side partial aggregates, so a group with a third of all rows costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, written

#: Bits of the filter for each row, and of a block.
ROW_BITS, BLOCK_BITS = 16, 32768


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hash(seed: int, mod: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("text_sha256")), F.lit(mod))


def _has_bit(bitmap: str, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation.  The smallest doc_id of a group stays; a null doc_id
    is larger than any other, and a group of nulls only has keep_id null and stays.  Rows that repeat the smallest doc_id
    are all marked kept and all counted.  Null and blank-only texts form groups like any other.  An empty table gives
    an empty table.
    """
    digests = written(docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")))
    blocks = -(-max(1, ROW_BITS * digests.count()) // BLOCK_BITS)
    placed = digests.withColumns({"block": _hash(1, blocks), "bit1": _hash(2, BLOCK_BITS), "bit2": _hash(3, BLOCK_BITS)})

    set_twice = placed.select("block", F.explode(F.array_distinct(F.array("bit1", "bit2"))).alias("bit")).groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    bitmaps = written(set_twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    tested = join_checked(placed, bitmaps, ["block"], bitmaps.count(), BLOCK_BITS // 8 + 64)
    possible = F.coalesce(_has_bit("bitmap", F.col("bit1")) & _has_bit("bitmap", F.col("bit2")), F.lit(False))
    tested = tested.select("doc_id", "text_sha256", possible.alias("possible"))
    if bitmaps.count() * BLOCK_BITS // 8 > 32 << 20:  # the join has moved the digests, and isn't done again
        tested = written(tested)

    groups = written(
        tested.where("possible").groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    )
    again = tested.where("possible").drop("possible")
    repeated = join_checked(again, groups, ["text_sha256"], groups.count(), 120)
    alone = tested.where("not possible").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    repeated = repeated.select(
        "doc_id", "text_sha256",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    return alone.unionByName(repeated).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
