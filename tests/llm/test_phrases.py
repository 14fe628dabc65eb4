"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, block int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2_000, share=100):
    n, often = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            often.update((lang, tuple(own[i : i + k])) for k in range(1, longest + 1) for i in range(len(own) - k + 1))
    often = {p: f for p, f in often.items() if f >= least}
    rest = lambda p: ((p[i : i + k]) for k in range(2, len(p)) for i in range(len(p) - k + 1))
    held = Counter()
    for (lang, p), f in often.items():
        for inner in rest(p):
            held[lang, inner] = max(held[lang, inner], f)
    found = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and not (held[lang, p] and 100 * held[lang, p] >= share * a):
            cuts = [(often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, t, lang, "s", 0, "clash", 1) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["a", "b", "the", "New", "york", "été", "ß", "x y", "c\td", "of", "tail", " ", "𝄞z", "a b", "B a b A b"]
    out = [(rng.choice(["en", "en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    out += [("en", "in the city of new york today")] * 9 + [("xx", "one two three four five six")] * 9 + [("und", "a b a b"), ("", "a b c " * 20), ("fr", None), ("fr", ""), ("fr", " .\n"), (None, "a b " * 5_000)]
    return out


@pytest.mark.parametrize("width", [22, 8, 16])
def test_matches_plain(spark, rows, width):
    """Also with so few buckets that nearly all are frequent."""
    got = mined(spark, rows, least=9, width=width)
    assert got == plain(rows, 9) and len({lang for lang, *_ in got}) > 3


def test_small_chunks_tops_and_shares(spark, rows, monkeypatch):
    assert mined(spark, rows, least=5, top=7, rows_per_shard=10) == plain(rows, 5, top=7)
    assert mined(spark, rows, least=5, share=60, longest=3) == plain(rows, 5, share=60, longest=3)
    assert mined(spark, rows, least=300) == plain(rows, 300)


def test_chunks_change_nothing(rows):
    """Phrases do not cross documents, wherever a chunk ends."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array([lang or "und" for lang, _ in rows]), pa.array([t or "" for _, t in rows])], names=["lang", "text"])
    whole = Counter()
    for size in (1, 300, 1 << 23):
        old, phrases.CHUNK = phrases.CHUNK, size
        found = Counter()
        for text, langs in phrases.reads(batch):
            at = np.flatnonzero(text.whole(2))
            if len(at):
                first, n, spaced, begins = phrases.distinct(text, at, 2)
                for i, p, c in zip(text.lang[first], phrases.phrases(first, 2, spaced, begins).to_pylist(), n):
                    found[langs[int(i)].as_py(), p] += int(c)
        phrases.CHUNK = old
        whole = whole or found
        assert found == whole


def test_exact_beyond_64_bits(spark):
    """1000 a n and l r pass 64 bits; the floor is that of the integers."""
    rng = random.Random(8)
    want, rows, totals = {}, [], []
    for i in range(200):
        n = rng.randint(10**12, 10**14)
        left, right = rng.randint(10**10, n // 10), rng.randint(10**10, n // 10)
        a = rng.choice([rng.randint(100, min(left, right)), left * right // n + rng.randint(-1, 1), min(left, right)])
        totals.append((f"l{i}", n))
        rows += [(f"l{i}", "a", 1, left), (f"l{i}", "b", 1, right), (f"l{i}", "a b", 2, a)]
        want[f"l{i}"] = 1000 * a * n // (left * right)
    every = spark.createDataFrame(rows, "lang string, phrase string, k int, f long")
    found = phrases.scored(every, spark.createDataFrame(totals, "lang string, n long"))
    assert {r["lang"]: r["score"] for r in found.collect()} == want


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None)]) == []


def test_pruning_counts_little(spark):
    """Of phrases whose words are all frequent, those in rare buckets are not counted."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(100)]
    level = phrases.Level(1, 3, 20, 22)
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    counts = df.mapInArrow(phrases.counted(level), phrases.COUNTED).cache()
    frequent = counts.where("block is null and phrase is not null").groupBy("lang", "phrase").sum("n").where("`sum(n)` >= 20")
    assert frequent.count() > 290
    after = phrases.Level(2, 3, 20, 22, phrases.part_bits(frequent, 1, 22), phrases.frequent_buckets(counts, level))
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    pairs = Counter()
    for text, _ in phrases.reads(batch):
        pairs["all"] += int(text.whole(2).sum())
        pairs["counted"] += int(after.candidates(text).sum())
    assert pairs["counted"] < pairs["all"] / 50
