"""Whole texts as arrays of UTF-8 bytes: words and n-grams of many documents at once.

For use inside ``mapInArrow``. A chunk is a run of whole documents of an Arrow batch. A very long
document is a chunk of its own: it takes some bytes for each of its characters and some numbers for each
of its words; the 8-byte numbers for each character are made for ``BLOCK`` characters at a time, or for
the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BLOCK = 1 << 17

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Chunk:
    """Documents first..last-1 of a batch: their bytes, and where each begins (one more entry)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more entry); nothing is copied unless null entries have bytes."""
    n = len(texts)
    wide = texts.type == pa.large_string()
    _, offs, data = texts.buffers()
    if offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if texts.null_count and (np.diff(offsets)[texts.is_null().to_numpy(zero_copy_only=False)] > 0).any():
        return utf8(pc.fill_null(texts, ""))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(texts: pa.Array, max_bytes: int = 1 << 18) -> Iterator[Chunk]:
    """Runs of whole documents of about ``max_bytes``; a null text is an empty one."""
    n = len(texts)
    if not n:
        return
    data, offsets = utf8(texts)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(2)
def _table(base: int) -> np.ndarray:
    return _powers(base, BLOCK + 1)


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0..n of ``base``; only the table for a block is kept."""
    return _table(base)[: n + 1] if n <= BLOCK else _powers(base, n + 1)


def words(chunk: Chunk, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of word bytes (``is_word``: 256 booleans)."""
    inside = is_word[chunk.data]
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    new = np.zeros(n + 1, bool)
    new[chunk.offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | new[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | new[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(chunk.offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from a running polynomial; spans are in order and do not overlap.

    Blocks are cut between spans, and the powers count from the block's begin.
    """
    out, i, n = np.zeros(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(BASE, high - low)[:-1], out=total[1:])
        at = starts[i:j] - low
        out[i:j] = (total[ends[i:j] - low] - total[at]) * powers(INVERSE, high - low)[at]
        i = j
    return mix(out)


def grams(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of one document, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    return mix(out[at] + np.uint64(k)), at


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: out[i] is min(h[i : i + width])."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the elements that are the least of some ``width`` neighbours (all, if fewer)."""
    width = min(width, len(h))
    if width <= 1:
        return np.arange(len(h))
    low = sliding_min(h, width)
    pad = np.zeros(width - 1, h.dtype)
    reach = ~sliding_min(~np.concatenate([pad, low, pad]), width)  # the greatest minimum of a window over i
    return np.flatnonzero(reach == h)


def by_doc(docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's entries begin in an array ordered by document (one more entry)."""
    return np.searchsorted(docs, np.arange(n_docs + 1))
