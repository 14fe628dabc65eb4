"""Phrase collocations by level-wise counting with hashed buckets.

Pass k over the texts counts phrases of k words exactly and, in the same reading, throws every phrase of k + 1
words into one of 2 ** ``width`` buckets. A phrase is counted in pass k + 1 only where both its
parts of k words were frequent (Apriori) and its bucket was (PCY); words that can not begin or end a frequent phrase are not
thrown into buckets either (DHP). Both tests are bitmaps of fixed size which tasks get with their code; they only ever let
too much through, so what is counted is exact whatever the width. A width of 22 suits some billions of words;
for far more give up to 26 (64 MB of counters in a task, 8 MB of bitmap), or more phrases than needed are counted.

A task counts each chunk of texts by numbers given to its distinct words, so that one row for each distinct phrase
leaves it; the counts of a bucket end at the least support, beyond which they say no more, and leave a task as
one byte each.

Cases: a null text has no words, a null language is ``und``; a text is cut at punctuation and line ends, so no phrase
crosses them; A-Z count as a-z; repeated rows count each time; ties are broken down to the phrase itself; columns besides
language and text are not read; a very long text is a chunk of its own; a table without a frequent phrase gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bitmaps import bitmap
from .hot_keys import join_groups
from .staging import stage
from .textbytes import LOWER, Chunk, chunks, mix, span_hashes, words

BREAKS = np.zeros(256, bool)  # bytes that end a piece
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
IN_WORD = ~BREAKS
IN_WORD[list(b" \t")] = False

BLOCK = 14  # a row of bucket counts has 2 ** BLOCK of them
CHUNK = 8 << 20
COUNTED = "lang string, phrase string, n long, block int, counts binary"

Batches = Iterator[pa.RecordBatch]


@dataclass
class Read:
    """The words of a chunk in order: text, piece, hash, and number and hash of their language."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray
    lang: np.ndarray
    lang_hashes: np.ndarray

    def whole(self, k: int) -> np.ndarray:
        """Where ``k`` words follow each other in one piece."""
        n = len(self.piece) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def grams(self, k: int) -> np.ndarray:
        """A hash of language and ``k`` words from each word on; what crosses pieces means nothing."""
        n = max(0, len(self.hashes) - k + 1)
        found = self.lang_hashes[self.lang[:n]]
        for j in range(k):
            found = mix(found * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : j + n] + np.uint64(j + 1))
        return found


def read(chunk: Chunk, lang: np.ndarray, lang_hashes: np.ndarray) -> Read:
    """``lang``: number of each document's language; ``lang_hashes``: hash of each number."""
    chunk = Chunk(chunk.first, chunk.last, LOWER[chunk.data], chunk.offsets)
    starts, ends, docs = words(chunk, IN_WORD)
    breaks = np.searchsorted(np.flatnonzero(BREAKS[chunk.data]), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (docs[1:] != docs[:-1])
    return Read(chunk, starts, ends, np.cumsum(new), span_hashes(chunk.data, starts, ends), lang[docs], lang_hashes)


def reads(batch: pa.RecordBatch) -> Iterator[tuple[Read, pa.Array]]:
    """Chunks of a batch of (lang, text), and the languages by number."""
    coded = batch.column(0).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    for chunk in chunks(batch.column(1), CHUNK):
        yield read(chunk, numbers[chunk.first : chunk.last], hashes), coded.dictionary


def marked(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes >> np.uint64(64 - width)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1


@dataclass(frozen=True)
class Level:
    """What pass ``k`` needs: the parts of k - 1 words that were frequent, the buckets of k words that were."""

    k: int
    longest: int
    least: int
    width: int
    parts: np.ndarray | None = None
    buckets: np.ndarray | None = None

    def candidates(self, text: Read) -> np.ndarray:
        """Whether the ``k`` words from each word on may be frequent."""
        may = text.whole(self.k)
        if self.parts is not None and may.any():
            parts = marked(self.parts, text.grams(self.k - 1), self.width)
            may &= parts[:-1] & parts[1:]
            at = np.flatnonzero(may)
            may[at] = marked(self.buckets, text.grams(self.k)[at], self.width)
        return may


def distinct(text: Read, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases of ``k`` words from ``at`` on, told apart by their words: first place and count of each,
    and all words with a blank after each, with the begin of each."""
    lengths = text.ends - text.starts
    inside = text.chunk.data[IN_WORD[text.chunk.data]]
    begins = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    narrow = np.int32 if begins[-1] < 1 << 31 else np.int64
    spaced = np.full(begins[-1], 32, np.uint8)
    spaced[np.arange(len(inside), dtype=narrow) + np.repeat(np.arange(len(lengths), dtype=narrow), lengths)] = inside
    coded = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(begins), pa.py_buffer(spaced)).dictionary_encode()
    numbers, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    key, top = text.lang[at], int(text.lang.max(initial=0)) + 1
    for j in range(k):
        if top * n >= 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            top = len(known)
        key, top = key * n + numbers[at + j], top * n
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return at[first], counts, spaced, begins


def phrases(first: np.ndarray, k: int, spaced: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The words from each of ``first`` on, joined by blanks."""
    low, lengths = begins[first], begins[first + k] - 1 - begins[first]
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    found = spaced[np.repeat(low - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(found)).cast(pa.string())


def rows(lang: pa.Array, phrase: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
    size = len(lang)
    nothing = [pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
    return pa.record_batch([lang.cast(pa.string()), pa.nulls(size, pa.string()) if phrase is None else phrase, pa.array(n, pa.int64()), *nothing], names=["lang", "phrase", "n", "block", "counts"])


def counted(level: Level) -> Callable[[Batches], Batches]:
    """Pass ``level.k``: counts of phrases by chunk (a null phrase: all words), counts of the next level's buckets by task."""
    kind = np.uint8 if level.least < 256 else np.uint32

    def run(batches: Batches) -> Batches:
        k, more = level.k, level.k < level.longest
        buckets = np.zeros(1 << level.width, np.int32) if more else None
        for batch in batches:
            for text, langs in reads(batch):
                if k == 1 and len(text.lang):
                    total = np.bincount(text.lang, minlength=len(langs))
                    some = np.flatnonzero(total)
                    yield rows(langs.take(pa.array(some)), None, total[some])
                may = level.candidates(text)
                at = np.flatnonzero(may)
                if not len(at):
                    continue
                first, n, spaced, begins = distinct(text, at, k)
                yield rows(langs.take(pa.array(text.lang[first])), phrases(first, k, spaced, begins), n)
                if more:
                    both = np.flatnonzero(text.whole(k + 1) & may[:-1] & may[1:])
                    np.add.at(buckets, (text.grams(k + 1)[both] >> np.uint64(64 - level.width)).astype(np.int64), 1)
        if more:
            for block, own in enumerate(buckets.reshape(-1, min(1 << BLOCK, len(buckets)))):
                if own.any():
                    held = np.minimum(own, level.least).astype(kind).tobytes()
                    none = pa.nulls(1, pa.string())
                    yield pa.record_batch([none, none, pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([held], pa.binary())], names=["lang", "phrase", "n", "block", "counts"])

    return run


def frequent_buckets(counts: DataFrame, level: Level) -> np.ndarray:
    """The bitmap of buckets with ``level.least`` phrases or more; 2 ** (width - 3) bytes reach the driver."""
    kind, least, size = np.uint8 if level.least < 256 else np.uint32, level.least, min(1 << BLOCK, 1 << level.width)

    def run(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = np.minimum(sums.get(block, 0) + np.frombuffer(held.as_buffer(), kind).astype(np.int64), least)
        yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())], names=["block", "bits"])

    found = counts.where("block is not null").select("block", "counts").repartition("block").mapInArrow(run, "block int, bits binary")
    bits = np.zeros(1 << level.width - 3, np.uint8)
    for row in found.toLocalIterator():
        bits[row["block"] * size // 8 : (row["block"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits.view(np.int64)


def part_bits(frequent: DataFrame, k: int, width: int) -> np.ndarray:
    """The bitmap of phrases of ``k`` words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for text, _ in reads(batch):
                own = np.flatnonzero(text.whole(k)) if k > 1 else np.arange(len(text.starts))
                yield pa.record_batch([pa.array((text.grams(k)[own] >> np.uint64(64 - width)).astype(np.int64))], names=["bit"])

    return bitmap(frequent.select("lang", "phrase").mapInArrow(run, "bit long"), width)


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    level, levels, totals = Level(1, longest, least, width), [], None
    while True:
        counts = stage(texts.mapInArrow(counted(level), COUNTED), f"phrases_{level.k}")
        sums = counts.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found = stage(sums.where((F.col("f") >= least) | F.col("phrase").isNull()).select("lang", "phrase", F.lit(level.k).alias("k"), "f"), f"frequent_{level.k}")
        if level.k == 1:
            totals = found.where("phrase is null").select("lang", F.col("f").alias("n"))
            found = found.where("phrase is not null")
        levels.append(found)
        if level.k == longest or found.isEmpty():
            break
        level = Level(level.k + 1, longest, least, width, part_bits(found, level.k, width), frequent_buckets(counts, level))
    every = levels[0]
    for other in levels[1:]:
        every = every.unionByName(other)
    return every, totals


def with_frequency(rows_: DataFrame, every: DataFrame, part: str, name: str, n_rows: int) -> DataFrame:
    """``rows_`` with the count of the phrase in column ``part`` as ``name``."""
    uses = rows_.groupBy("lang", part).agg(F.count(F.lit(1)).alias("uses"))
    groups = stage(every.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(uses, ["lang", part]), "parts")
    return join_groups(rows_, groups, ["lang", part], F.col("uses"), n_rows).drop("uses")


def words_between(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def scored(every: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of all phrases of two words or more; the cut with the least score counts."""
    whole = F.col("f").cast("decimal(38,0)")
    several = every.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    n_phrases = several.count()
    langs = several.groupBy("lang").agg(F.count(F.lit(1)).alias("uses")).join(totals, "lang")
    several = join_groups(several, stage(langs, "langs"), ["lang"], F.col("uses"), n_phrases).drop("uses")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "n", "cut", words_between(F.lit(1), F.col("cut")).alias("left"), words_between(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = stage(cuts, "cuts")
    n_cuts = cuts.count()
    cuts = with_frequency(with_frequency(cuts, every, "left", "l", n_cuts), every, "right", "r", n_cuts)
    exact = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(exact.alias("score"), "cut", "l", "r", "n", "a", "k")).alias("best")
    return cuts.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "best.*")


def inside_longer(every: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, most): how often the most frequent longer phrase occurs that holds the words of ``phrase``."""
    longer = every.where("k > 2").select("lang", "f", "k", F.split("phrase", " ").alias("words"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: words_between(i, size))))
    return longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = 5,
    least: int = 100,
    top: int = 2_000,
    share: int = 100,
    width: int = 22,
    rows_per_shard: int = 50_000,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``score``: floor(1000 a n / (l r)) at the cut where it is least. A phrase is dropped if a longer one that holds it
    occurs at least ``share`` in 100 times as often. Each language's phrases are ranked in shards first, so no task ranks them all.
    """
    every, totals = frequent_phrases(docs, lang_col, text_col, longest, least, width)
    found = stage(scored(every, totals), "scored")
    held = inside_longer(every, share)
    stays = found.join(held, ["lang", "phrase"], "left").where(f"most is null or 100 * cast(most as decimal(38,0)) < {share} * cast(a as decimal(38,0))")
    shards = max(1, found.count() // rows_per_shard)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shard = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shards))).orderBy(*order)
    near = stays.withColumn("at", F.row_number().over(shard)).where(F.col("at") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
