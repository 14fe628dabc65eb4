"""Language identification with a mixture of languages in each document.

Byte trigrams of whole texts (A-Z lower-cased, runs of other ASCII non-letters as one blank) are
hashed to buckets. Each language has a smoothed bucket distribution, learned from labelled rows.
Expectation-maximisation estimates the proportions of the languages in a document; the set of
languages is the one with the best log-likelihood less a penalty for each language, tried from the
strongest languages of the full mixture downwards.

Cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every
document is ``und``; ties go to the language first in alphabetical order; repeated rows are scored
alike; a very long text is counted block by block; extra columns are carried whatever their names, but columns named
as a result are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carrying import quoted, with_kept
from .textbytes import chunks

UNKNOWN = "und"

#: Letters in lower case, bytes over 127 as they are, everything else a blank.
FOLDED = np.full(256, 32, np.uint8)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


def bucket_counts(data: np.ndarray, offsets: np.ndarray, buckets: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the trigrams of each document, in order of document and bucket."""
    n_docs = len(offsets) - 1
    folded = FOLDED[data]
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    shift = np.uint32(32 - (buckets.bit_length() - 1))

    def codes(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint32)
        return (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435769) >> shift).astype(np.int64)

    if n_docs == 1:  # a long text is counted block by block
        x, total = folded[keep], np.zeros(buckets, np.int64)
        for at in range(0, max(0, len(x) - 2), block):
            total += np.bincount(codes(x[at : at + block + 2]), minlength=buckets)
        found = np.flatnonzero(total)
        return np.zeros(len(found), np.int64), found, total[found]
    docs, x = np.repeat(np.arange(n_docs), np.diff(offsets))[keep], folded[keep]
    if len(x) < 3:
        return (np.zeros(0, np.int64),) * 3
    same = docs[:-2] == docs[2:]
    key, count = np.unique(docs[:-2][same] * buckets + codes(x)[same], return_counts=True)
    return key // buckets, key % buckets, count


@dataclass
class LanguageModel:
    """Bucket probabilities of each language."""

    languages: list[str]
    probs: np.ndarray  # buckets x languages
    penalty: float = 8.0
    rounds: int = 12

    def mixture(self, p: np.ndarray, count: np.ndarray, start: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of documents whose entries begin at ``start``; zeros of ``pi`` stay zero."""
        sizes = np.diff(np.append(start, len(count)))
        total, joint = np.add.reduceat(count, start)[:, None], np.empty_like(p)
        for _ in range(self.rounds):
            np.multiply(p, np.repeat(pi.astype(p.dtype), sizes, axis=0), out=joint)
            joint *= (count / joint.sum(axis=1))[:, None]
            pi = np.add.reduceat(joint, start, axis=0, dtype=np.float64) / total
        np.multiply(p, np.repeat(pi.astype(p.dtype), sizes, axis=0), out=joint)
        return pi, np.add.reduceat(count * np.log(joint.sum(axis=1, dtype=np.float64)), start)

    def identify(self, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
        """Proportions of the languages (documents x languages) under the chosen set; 0 without entries."""
        out = np.zeros((n_docs, len(self.languages)))
        if not len(doc):
            return out
        p, count = self.probs[bucket], count.astype(np.float64)
        known, start = np.unique(doc, return_index=True)
        n, sizes = len(self.languages), np.diff(np.append(start, len(doc)))
        alone = np.add.reduceat(np.log(p) * count[:, None], start, axis=0, dtype=np.float64)
        best = np.zeros((len(known), n))
        best[np.arange(len(known)), alone.argmax(axis=1)] = 1
        score = alone.max(axis=1) - self.penalty
        full, fit = self.mixture(p, count, start, np.full((len(known), n), 1 / n))
        # no set beats one language if even all together gain less than the penalty of a second one
        open_ = np.flatnonzero(fit - 2 * self.penalty > score)
        if len(open_):
            rows = np.concatenate([np.arange(start[i], start[i] + sizes[i]) for i in open_])
            begin = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
            rank = (-full[open_]).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            for k in range(2, n + 1):
                pi = np.where(rank < k, full[open_], 0) + np.where(rank < k, 1e-6, 0)
                pi, fit = self.mixture(p[rows], count[rows], begin, pi / pi.sum(axis=1, keepdims=True))
                better = fit - k * self.penalty > score[open_]
                best[open_[better]], score[open_[better]] = pi[better], fit[better] - k * self.penalty
        out[known] = best
        return out


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", max_rows: int = 8_000, buckets: int = 1 << 14, smoothing: float = 0.5, penalty: float = 8.0) -> LanguageModel:
    """Learn from whole texts of about ``max_rows`` labelled rows at most, chosen by a hash of the text.

    The tasks count; the driver receives a table of at most ``buckets`` rows for each language.
    """
    known = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for chunk in chunks(batch.column("text")):
                doc, bucket, count = bucket_counts(chunk.data, chunk.offsets, buckets)
                names = np.array(labels[chunk.first : chunk.last], object)[doc]
                for name in set(names):
                    own = names == name
                    total[name] = total.get(name, 0) + np.bincount(bucket[own], count[own], buckets)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], names=["label", "bucket", "n"])

    table = known.mapInArrow(count_batches, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["label"].unique())
    probs = np.full((buckets, len(languages)), smoothing)
    for j, name in enumerate(languages):
        own = table[table["label"] == name]
        probs[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    return LanguageModel(languages, (probs / probs.sum(axis=0)).astype(np.float32), penalty)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the share of that language) and langs (the chosen set with shares).

    ``text_col`` itself is not returned; carry the columns that are wanted besides it.
    """
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "langs")]
    names = np.array([*model.languages, UNKNOWN], object)
    kind = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            pred, score, sets = [], [], []
            for chunk in chunks(texts):
                n_docs = chunk.last - chunk.first
                share = model.identify(*bucket_counts(chunk.data, chunk.offsets, model.probs.shape[0]), n_docs) if model.languages else np.zeros((n_docs, 0))
                # a text of under three bytes has no trigram: its languages are as likely as before
                blank = share.sum(axis=1) == 0 if model.languages else np.ones(n_docs, bool)
                letters = np.zeros(len(chunk.data) + 1, np.int32)
                np.cumsum((FOLDED[chunk.data] > 96) & (chunk.data < 128), out=letters[1:])
                sure = letters[chunk.offsets[1:]] > letters[chunk.offsets[:-1]]
                for i in np.flatnonzero(blank | ~sure):
                    if not sure[i] and not has_letter(texts[chunk.first + int(i)].as_py() or ""):
                        share[i] = 0
                        blank[i] = True
                    elif blank[i] and model.languages:
                        share[i] = 1 / len(model.languages)
                        blank[i] = False
                top = np.where(blank, len(model.languages), share.argmax(axis=1) if model.languages else 0)
                pred += names[top].tolist()
                score += np.where(blank, 0.0, share.max(axis=1) if model.languages else 0.0).tolist()
                sets += [[(model.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in share]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], names=["kept", "lang_pred", "score", "langs"])

    return with_kept(docs, others, {"text": F.col(quoted(text_col))}, run, "lang_pred string, score double, langs map<string,double>")


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learn on the labelled rows outside the held-out fold, then identify every row."""
    model = fit(docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2), text_col, label_col)
    return identify(docs.select(id_col, text_col), model, text_col)
