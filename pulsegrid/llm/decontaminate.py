"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` neighbouring k-gram hashes of a text the least is a fingerprint, so any
span of ``window`` words that two texts share has a fingerprint in common. Fingerprints of training
and test texts are joined, and each hit is extended word by word within its surroundings: only runs
of at least ``window`` equal words count. Test items shorter than the window are winnowed with k as
their own length, so that every run of that length is a fingerprint.

Training fingerprints pass a bitmap of the test fingerprints first. It has a fixed number of bits; a
very large benchmark only fills it, and then more fingerprints reach the join.

Cases: a null text has no words and no hits; an item without words matches nothing; repeated rows
and items are each judged, an item id is counted once; an item without an id still marks words; null
document ids are carried, as are any ``keep`` columns but n_words, n_hit, item_ids and contaminated (ValueError); a very long
text takes some 50 bytes for each of its words; an empty table of either kind is fine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap
from .carrying import packed, quoted, unpacked
from .staging import stage
from .textbytes import LOWER, Chunk, by_doc, chunks, grams, span_hashes, window_minima, words

#: Bytes of words: digits, letters, and everything that is not ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

MAP_BITS = 22
FOUND = pa.list_(pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("at", pa.list_(pa.int32())), ("before", pa.int32()), ("near", pa.string())]))
FOUND_SQL = "array<struct<length:int,hash:bigint,at:array<int>,before:int,near:string>>"
RESULT = ("n_words", "n_hit", "item_ids", "contaminated")


class Words:
    """The words of a chunk's documents."""

    def __init__(self, chunk: Chunk):
        self.data = LOWER[chunk.data]
        self.starts, self.ends, self.docs = words(Chunk(chunk.first, chunk.last, self.data, chunk.offsets), WORD)
        self.begin = by_doc(self.docs, chunk.last - chunk.first)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def fingerprints(self, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and word indexes of the fingerprints that find shared spans of ``length`` words."""
        hashes, at = grams(self.hashes, self.docs, k)
        chosen = np.zeros(0, np.int64)
        if len(at):
            begin = by_doc(self.docs[at], len(self.begin) - 1)
            if length == k:
                chosen = np.arange(len(at))
            else:
                chosen = np.concatenate([b + window_minima(hashes[b:e], length - k + 1) for b, e in zip(begin[:-1], begin[1:]) if e > b])
        return hashes[chosen], at[chosen]

    def near(self, at: int, length: int, k: int) -> tuple[int, str]:
        """The words that a span of ``length`` words over the k-gram at ``at`` can hold, and how many precede it."""
        doc = self.docs[at]
        first, last = max(self.begin[doc], at - (length - k)), min(self.begin[doc + 1], at + length)
        return at - first, b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, last)).decode("utf-8", "replace")

    def rows(self, hashes: np.ndarray, at: np.ndarray, length: int, k: int) -> Iterator[tuple[int, dict]]:
        """(document, fingerprint) for each; one that is all of a short item's words is a row for all its places in a document."""
        if length > k:
            groups = [[i] for i in at.tolist()]
        else:
            order = np.lexsort((at, hashes, self.docs[at]))
            hashes, at = hashes[order], at[order]
            groups = np.split(at, np.flatnonzero((hashes[1:] != hashes[:-1]) | (self.docs[at][1:] != self.docs[at][:-1])) + 1) if len(at) else []
            hashes = hashes[np.cumsum([0, *map(len, groups)])[:-1]]
        for h, places in zip(hashes.view(np.int64).tolist(), groups):
            doc = int(self.docs[places[0]])
            before, near = self.near(int(places[0]), length, k)
            yield doc, {"length": length, "hash": h, "at": [int(i - self.begin[doc]) for i in places], "before": before, "near": near}


def item_fingerprints(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """(length, hash, before, near, ids) of every test fingerprint; equal surroundings are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for chunk in chunks(batch.column("_text")):
                w = Words(chunk)
                sizes = np.diff(w.begin)
                for n in range(1, window + 1):
                    own = sizes >= window if n == window else sizes == n
                    if own.any():
                        hashes, at = w.fingerprints(n, k if n == window else n)
                        mine = own[w.docs[at]]
                        for doc, row in w.rows(hashes[mine], at[mine], n, k if n == window else n):
                            found[chunk.first + doc].append(row)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, FOUND)], names=["_id", "found"])

    rows = items.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id string, found {FOUND_SQL}")
    return rows.select("_id", F.inline("found")).drop("at").groupBy("length", "hash", "before", "near").agg(F.collect_set("_id").alias("ids"))


def doc_fingerprints(docs: DataFrame, lengths: Sequence[int], packed_bits: np.ndarray, window: int, k: int) -> DataFrame:
    """A row for each document: kept, row, n_words, and the fingerprints that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            sizes = [np.zeros(0, np.int64)]
            for chunk in chunks(batch.column("text")):
                w = Words(chunk)
                sizes.append(np.diff(w.begin))
                for n in lengths:
                    kk = k if n == window else n
                    hashes, at = w.fingerprints(n, kk)
                    bit = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    mine = (packed_bits[bit >> 6] >> (bit & 63)) & 1 == 1
                    for doc, row in w.rows(hashes[mine], at[mine], n, kk):
                        found[chunk.first + doc].append(row)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("row"), pa.array(np.concatenate(sizes), pa.int64()), pa.array(found, FOUND)], names=["kept", "row", "n_words", "found"])

    return docs.mapInArrow(run, f"kept {docs.schema['kept'].dataType.simpleString()}, row bigint, n_words bigint, found {FOUND_SQL}")


def extended(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """Hits whose surroundings agree in a run of enough words over the fingerprint: first and last word."""
    for batch in batches:
        source, first, last = [], [], []
        for i, (length, at, b1, near1, b2, near2) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("length", "at", "before", "near", "item_before", "item_near")])):
            x, y = near1.split(" "), near2.split(" ")
            width = k if length == window else length
            if x[b1 : b1 + width] != y[b2 : b2 + width]:
                continue
            left = right = 0
            if length == window:  # a short item is all of its fingerprint
                while left < min(b1, b2) and x[b1 - left - 1] == y[b2 - left - 1]:
                    left += 1
                end1, end2 = b1 + width, b2 + width
                while right < min(len(x) - end1, len(y) - end2) and x[end1 + right] == y[end2 + right]:
                    right += 1
            if left + width + right >= length:
                source += [i] * len(at)
                first += [p - left for p in at]
                last += [p + width + right - 1 for p in at]
        take = pa.array(source, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row").take(take), pa.array(first, pa.int32()), pa.array(last, pa.int32()), batch.column("ids").take(take)], names=["row", "first", "last", "ids"])


def covered(spans: Column) -> Column:
    """How many words lie in at least one of the spans (structs of first and last)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))

    def step(state: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["last"] - F.greatest(x["first"] - 1, state["end"]))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["end"], x["last"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    k: int = 5,
) -> DataFrame:
    """One row per document: ``keep``, n_words, n_hit, item_ids (sorted as strings) and contaminated.

    A word is hit if it lies in an occurrence of an item's window: ``window`` consecutive words of the
    item, or all of a shorter one. A document is contaminated if a twentieth of its words or more is hit.
    """
    if clash := {*keep} & {*RESULT}:
        raise ValueError(f"kept columns named as result columns: {sorted(clash)}")
    tests = stage(item_fingerprints(items, item_id, item_text, window, k), "test_fingerprints")
    lengths = sorted(r[0] for r in tests.select("length").distinct().collect())  # at most ``window``
    numbered = docs.select(packed(docs, keep).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col(quoted(text_col)).alias("text"))
    rows = stage(doc_fingerprints(numbered, lengths, bitmap(tests.select(F.shiftrightunsigned("hash", 64 - MAP_BITS).alias("bit")), MAP_BITS), window, k), "fingerprints")
    candidates = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    pairs = candidates.join(tests.withColumnsRenamed({"before": "item_before", "near": "item_near"}), ["length", "hash"])
    hits = pairs.select("row", "length", "at", "before", "near", "item_before", "item_near", "ids").mapInArrow(lambda batches: extended(batches, k, window), "row bigint, first int, last int, ids array<string>")
    by_row = hits.groupBy("row").agg(covered(F.collect_set(F.struct("first", "last"))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    found = rows.drop("found").join(by_row, "row", "left")
    n_hit: Column = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.expr("cast(array() as array<string>)")
    return found.select(*unpacked("kept", keep), "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
