"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into overlapping windows of bytes. The character n-grams of the window's words (with
word boundaries) are hashed to rows of an embedding table; their mean goes through a linear softmax.
A document's score is its most toxic window's, so long texts are not diluted. Training alternates
between choosing each document's highest-scoring window and fitting embeddings and softmax together.
Only n-grams whose share of documents differs clearly between the labels get an embedding; the others
are zero, so a clean text's rare n-grams can't add up to a score.

For scoring, embedding row and softmax weight are multiplied once, so each n-gram is one number and
whole texts are scored by running sums over bytes.

Cases: a null or empty text has no n-grams and gets the score of the bias alone; without labels of
both kinds every score is 0; repeated rows get equal scores; a very long text takes some 60 bytes for each of its own
while it is scored; extra columns are carried whatever their names, but a column score is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carrying import quoted, with_kept
from .language_id import FOLDED
from .staging import stage
from .textbytes import chunks

SIZES = (3, 4, 5)

#: As for languages, but digits stand for letters in misspellings.
CHARS = FOLDED.copy()
CHARS[48:58] = np.arange(48, 58)


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n-grams within words of a chunk: (size x position) bucket, valid, and the document of each position.

    A word's n-grams take in the blank on either side, so prefixes and suffixes differ from middles.
    """
    n_docs = len(offsets) - 1
    x = np.full(len(data) + n_docs + 1, 32, np.uint8)  # a blank before each document and at the end
    docs = np.repeat(np.arange(n_docs), np.diff(offsets) + 1)
    x[np.arange(len(data)) + np.repeat(np.arange(1, n_docs + 1), np.diff(offsets))] = CHARS[data]
    docs = np.append(docs, max(0, n_docs - 1))
    n, shift = len(x), np.uint32(33 - buckets.bit_length())
    blanks = np.zeros(n + 1, np.int32)
    np.cumsum(x == 32, out=blanks[1:])
    code, found, valid = np.zeros(n, np.uint32), [], []
    for size in range(1, max(SIZES) + 1):
        code[: n - size + 1] = (code[: n - size + 1] * np.uint32(0x01000193)) ^ x[size - 1 :]
        if size in SIZES:
            inner = np.zeros(n, bool)
            if n >= size:  # no blank but at the ends
                at = np.arange(n - size + 1)
                inner[: n - size + 1] = blanks[at + size - 1] == blanks[at + 1]
            h = (code + np.uint32(size)) * np.uint32(2654435769)
            h ^= h >> np.uint32(15)
            found.append(((h * np.uint32(0x85EBCA6B)) >> shift).astype(np.int32))
            valid.append(inner)
    return np.array(found), np.array(valid), docs


def windows(docs: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last position (exclusive) and document of windows of ``width`` bytes, half overlapping, and of shorter texts."""
    begin = np.searchsorted(docs, np.arange(n_docs + 1))
    sizes = np.diff(begin)
    count = np.maximum(1, -(-(sizes - width) // (width // 2)) + 1)
    doc = np.repeat(np.arange(n_docs), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = begin[doc] + nth * (width // 2)
    return first, np.minimum(first + width, begin[doc + 1]), doc


@dataclass
class ToxicityModel:
    """The weight of every n-gram bucket (embedding times softmax), and the bias."""

    weights: np.ndarray
    bias: float
    width: int

    def window_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, and its document."""
        bucket, valid, docs = ngrams(data, offsets, len(self.weights))
        total = np.zeros((2, len(docs) + 1))
        np.cumsum(np.where(valid, self.weights[bucket], 0).sum(axis=0), out=total[0, 1:])
        np.cumsum(valid.sum(axis=0), out=total[1, 1:])
        first, last, doc = windows(docs, len(offsets) - 1, self.width)
        s, n = total[:, last] - total[:, first]
        return s / np.maximum(n, 1) + self.bias, doc

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of every document, 0 to 1."""
        out = np.full(len(offsets) - 1, -np.inf)
        logit, doc = self.window_scores(data, offsets)
        np.maximum.at(out, doc, logit)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def presence(texts: pa.Array, labels: np.ndarray, buckets: int) -> np.ndarray:
    """How many documents of either label hold each bucket (2 x buckets)."""
    df = np.zeros((2, buckets))
    for chunk in chunks(texts):
        bucket, valid, docs = ngrams(chunk.data, chunk.offsets, buckets)
        key = np.unique(np.concatenate([docs[v] * buckets + b[v] for b, v in zip(bucket, valid)]))
        label = labels[chunk.first + key // buckets]
        for y in (0, 1):
            df[y] += np.bincount(key[label == y] % buckets, minlength=buckets)
    return df


def telling(df: np.ndarray, n: np.ndarray, z: float, least: int) -> np.ndarray:
    """Buckets whose share of documents differs between the labels by ``z`` standard errors."""
    p = df.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())
    return np.flatnonzero((np.abs(df[1] / n[1] - df[0] / n[0]) > z * error) & (df.max(axis=0) >= least))


def train(texts: pa.Array, labels: np.ndarray, buckets: int = 1 << 18, dim: int = 8, width: int = 128, z: float = 5.0, least: int = 5, rounds: int = 12, steps: int = 25, rate: float = 0.2, decay: float = 1e-4, seed: int = 7, shares: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """Fit the embeddings of telling n-grams and the softmax together, by Adam.

    Without telling n-grams the bias alone is fitted, the log odds of the labels. ``shares`` are the parts
    of clean and toxic labels that were sampled; their log ratio is taken from the bias after. Each document stands for the window that scores highest so far; the windows are chosen anew
    ``rounds`` times, with ``steps`` steps between. Other n-grams have no embedding and only count in
    the mean.
    """
    rng = np.random.default_rng(seed)
    n = np.bincount(labels, minlength=2)[:2].astype(float)
    chosen = telling(presence(texts, labels, buckets), n, z, least)
    number = np.full(buckets, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    owner, size, win, feature, have = [], [], [], [], 0
    for chunk in chunks(texts):
        bucket, valid, docs = ngrams(chunk.data, chunk.offsets, buckets)
        first, last, doc = windows(docs, chunk.last - chunk.first, width)
        total = np.concatenate([[0], np.cumsum(valid.sum(axis=0))])
        opening = np.searchsorted(doc, np.arange(chunk.last - chunk.first + 1))
        begin = np.searchsorted(docs, np.arange(chunk.last - chunk.first))
        which, at = np.nonzero(valid & (number[bucket] >= 0))
        for back in (0, 1):  # a position lies in two windows at most
            nth = (at - begin[docs[at]]) // (width // 2) - back
            inside = (nth >= 0) & (nth < np.diff(opening)[docs[at]])
            win.append(have + opening[docs[at[inside]]] + nth[inside])
            feature.append(number[bucket[which[inside], at[inside]]])
        owner.append(chunk.first + doc)
        size.append(total[last] - total[first])
        have += len(doc)
    owner, size, win, feature = map(np.concatenate, (owner, size, win, feature))
    size = np.maximum(size, 1)
    opening = np.searchsorted(owner, np.arange(len(labels)))
    emb, out, bias = rng.normal(0, 0.1, (len(chosen), dim)), rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    scale = float(np.median(size)) / 8  # so that a few n-grams of a window matter at the first steps
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, out, bias)]
    clock, order = 0, np.argsort(win, kind="stable")
    win, feature = win[order], feature[order]
    for _ in range(rounds if len(chosen) else 0):
        weight = emb @ (out[:, 1] - out[:, 0])
        z_all = scale * np.bincount(win, weight[feature], len(owner)) / size + 1e-9 * np.bincount(win, minlength=len(owner))
        top = np.maximum.reduceat(z_all, opening)
        best = np.full(len(labels), len(owner))
        np.minimum.at(best, owner, np.where(z_all >= top[owner], np.arange(len(owner)), len(owner)))
        row = np.full(len(owner) + 1, -1)
        row[best] = np.arange(len(labels))
        mine = row[win] >= 0
        bag, own, share = row[win[mine]], feature[mine], scale / size[best]
        for _ in range(steps):
            mean = np.stack([np.bincount(bag, emb[own, j], len(labels)) for j in range(dim)], axis=1) * share[:, None]
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(labels)), labels] -= 1
            p /= len(labels)
            spread = (p @ out.T) * share[:, None]
            slope = np.stack([np.bincount(own, spread[bag, j], len(chosen)) for j in range(dim)], axis=1) + decay * emb
            clock += 1
            for param, grad, (m, v) in zip((emb, out, bias), (slope, mean.T @ p, p.sum(axis=0)), moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**clock)) / (np.sqrt(v / (1 - 0.99**clock)) + 1e-8)
    weights = np.zeros(buckets, np.float32)
    weights[chosen] = scale * (emb @ (out[:, 1] - out[:, 0]))
    fitted = bias[1] - bias[0] if len(chosen) else np.log(n[1] / n[0])
    return ToxicityModel(weights, float(fitted - np.log(shares[1] / shares[0])), width)


def sampled(labels: DataFrame, id_col: str, label_col: str, max_rows: int, max_toxic: int) -> tuple[DataFrame, tuple[float, float]] | None:
    """About ``max_rows`` labels at most, up to ``max_toxic`` of them toxic, chosen by a hash of the id, and the shares of clean and toxic ones; None unless both kinds are there."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    shares = min(1.0, (max_rows - max_toxic) / sizes[0]), min(1.0, max_toxic / sizes[1])
    share = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    return known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30)), shares


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 9_000, max_toxic: int = 2_500, max_bytes: int = 1 << 26) -> ToxicityModel | None:
    """Train on the whole texts of a bounded sample of labelled rows.

    The sampled labels, about ``max_rows`` ids at most, are broadcast, so the texts of ``docs`` don't
    move; the sample's texts are the only ones that reach the driver. If they have more than ``max_bytes``, or
    repeated ids make them more than ``max_rows``, an even part of them is taken; texts of a sixteenth of ``max_bytes`` are not learned from.
    """
    chosen = sampled(labels, id_col, label_col, max_rows, max_toxic)
    if chosen is None:
        return None
    chosen, shares = chosen
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.join(F.broadcast(chosen), id_col).select(text.alias("text"), "label", F.octet_length(text).alias("bytes"), F.rand(1).alias("at")).where(F.col("bytes") < max_bytes // 16)
    sample = stage(sample, "labelled")
    rows, size = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    part = min(1.0, 1.1 * max_rows / max(1, rows), max_bytes / max(1, size))
    taken = sample.where(F.col("at") < part).select("text", "label").orderBy(F.xxhash64("text")).toArrow()
    found = taken.column("label").to_numpy()
    return train(taken.column("text").combine_chunks(), found, shares=shares) if len(set(found)) == 2 else None


def score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with score (0 to 1)."""
    others = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(c.data, c.offsets) if model else np.zeros(c.last - c.first) for c in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())], names=["kept", "score"])

    return with_kept(docs, others, {"text": F.col(quoted(text_col))}, run, "score double")


def score_corpus(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from the labelled rows outside the held-out fold (crc32 of the id as text, modulo 5, is 0); score every row."""
    learned = labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    texts = docs.select(id_col, text_col)
    return score(texts, fit(texts, learned, id_col, text_col, label_col), text_col)
