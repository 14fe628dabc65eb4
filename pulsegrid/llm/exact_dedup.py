"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 counts how many rows set each bit of a Bloom filter and keeps the bits set at least twice. A digest's
bits all lie in one block of the filter, so the filter falls apart into ranges of blocks. Pass 2 goes
through the ranges: the rows of a range are tested against its part of the filter, which is broadcast. A
row with a bit that no other row set has a text that occurs once, and passes straight through. Only the
others (copies and a few false positives) are shuffled and grouped by their digest.

A range holds at most about ``range_words`` words of the filter that have bits, 16 bytes each; a larger input
has more ranges, and is otherwise treated alike: 30 GB of documents of 2 KB have some three ranges of the
default size. Each range reads the digests once more, so give it as many words as executors can hold.

Cases: null texts count as empty; equal texts are those identical after lower-casing A-Z; of rows
that repeat both text and id one stays; a null id is smaller than any other; a very long text is only
hashed; extra columns are not read unless named in ``carry``, and a carried one must not be named as a result
column (ValueError); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carrying import packed, unpacked
from .hot_keys import join_groups
from .native import ascii_lower
from .staging import stage

BLOCK_BITS = 12  # a block has 2 ** BLOCK_BITS words of 64 bits
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def places(digest: str, blocks: int, hashes: int) -> list[tuple[Column, Column]]:
    """Word of the filter and bit in it, for each hash; all in the digest's block."""
    block = F.pmod(F.xxhash64(F.lit(-1), digest), F.lit(blocks))
    out = []
    for i in range(hashes):
        h = F.xxhash64(F.lit(i), digest)
        word = F.shiftleft(block, BLOCK_BITS) + h.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        out.append((word, F.shiftrightunsigned(h, 58).cast("int")))
    return out


def repeated_bits(rows: DataFrame, digest: str, blocks: int, hashes: int) -> DataFrame:
    """The bits that at least two rows set: (word, mask), 64 bits a word.

    The counts are combined before the shuffle, so a text that fills a third of the table is one
    row from each task.
    """
    bits = F.explode(F.array(*[F.struct(word.alias("word"), bit.alias("bit")) for word, bit in places(digest, blocks, hashes)]))
    twice = rows.select(bits.alias("at")).groupBy("at.word", "at.bit").count().where("count > 1")
    return twice.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def suspected(rows: DataFrame, words: DataFrame, digest: str, blocks: int, hashes: int) -> DataFrame:
    """``rows`` with _maybe: whether all bits of the digest are in ``words``, which is broadcast."""
    tested = rows.withColumn("_maybe", F.lit(True))
    for word, bit in places(digest, blocks, hashes):
        found = F.broadcast(words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask")))
        tested = tested.withColumns({"_at": word, "_bit": bit}).join(found, F.col("_at") == F.col("_word"), "left")
        tested = tested.withColumn("_maybe", F.col("_maybe") & F.expr("coalesce(getbit(_mask, _bit), 0) = 1")).drop("_at", "_bit", "_word", "_mask")
    return tested


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    hashes: int = 2,
    bits_per_row: int = 16,
    range_words: int = 500_000,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 and the ``carry`` columns.

    Of equal texts the row with the largest id is kept. The filter has ``bits_per_row`` bits for each row.
    """
    if clash := {*carry} & {id_col, *RESULT}:
        raise ValueError(f"carried columns named as result columns: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(ascii_lower(text).cast("binary"), 256).alias("_sha"), F.monotonically_increasing_id().alias("_row"), packed(docs, carry).alias("_carried"))
    rows = stage(rows, "exact_rows")
    n = rows.count()
    blocks = 1 << max(0, (bits_per_row * n).bit_length() - BLOCK_BITS - 6)
    words = stage(repeated_bits(rows, "_sha", blocks, hashes), "exact_bits")
    ranges = min(blocks, -(-words.count() // range_words) or 1)
    block, parts = F.pmod(F.xxhash64(F.lit(-1), "_sha"), F.lit(blocks)), []
    for i in range(ranges):
        low, high = i * blocks // ranges, (i + 1) * blocks // ranges
        own = words.where((F.col("word") >= low << BLOCK_BITS) & (F.col("word") < high << BLOCK_BITS))
        parts.append(suspected(rows.where((block >= low) & (block < high)), own, "_sha", blocks, hashes))
    tested = reduce(DataFrame.unionByName, parts)
    kept = unpacked("_carried", carry)
    once = tested.where("not _maybe").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"), *kept)
    suspects = stage(tested.where("_maybe").drop("_maybe"), "exact_suspects")
    groups = stage(suspects.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")), "exact_groups")
    again = join_groups(suspects, groups, ["_sha"], F.col("group_size"), n)
    again = again.select(F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), F.col("_sha").alias("text_sha256"), *kept)
    return once.unionByName(again)
