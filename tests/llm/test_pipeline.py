"""The pipeline against a brute-force version of its stages, on a table with copies, near copies, common lines and test passages."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, digest string, _digest int, id int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    syllables = {"en": ["the", "ing", "wh", "ou", "th", "ea"], "de": ["sch", "ein", "ung", "ö", "keit", "ver"]}

    def prose(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(2, 3))) for _ in range(n))

    out, passages = [], [prose("en", 30), prose("de", 14), prose("en", 5)]
    common = ["A line that many documents share, " + prose("en", 3), "noch eine solche Zeile mit " + prose("de", 4)]
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = "\n".join(prose(lang, rng.randint(10, 40)) for _ in range(rng.randint(1, 4)))
        if i % 7 == 0:
            text += "\n" + rng.choice(["", " ", "\t"]) + common[lang == "de"].upper()[: None if lang == "en" else 40]
        if i % 11 == 0:
            text += " " + passages[lang == "de"] + " " + prose(lang, 8)
        out.append((text, lang))
    for i in range(20):  # copies and near copies
        words = out[i % 6][0].split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = prose(out[i % 6][1], 1)
        out.append((" ".join(words), out[i % 6][1]))
    out += [("123 456 ... 789", "en"), ("", "en"), (None, "de"), (passages[2], "en"), (prose("en", 3_000), "en")]
    docs = [(100 + i, t, lang if i % 5 else None, "s", 0, i, "x", 1, 2) for i, (t, lang) in enumerate(out)]
    docs += [docs[3], (None, docs[8][1], "en", None, None, None, None, None, None)]
    return docs, list(enumerate(passages))


def kept_lines(rows):
    holders = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in text.split("\n"):
                holders[line.strip(BLANK).translate(AZ)].add(i)
    lost = lambda i, k: i is not None and len(k) >= 20 and len(holders[k]) >= 3 and i < max(holders[k])
    return [(i, "\n".join(x for x in text.split("\n") if not lost(i, x.strip(BLANK).translate(AZ)))) for i, text in rows]


def one_of_similar(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(AZ))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [(i, shingles(t)) for i, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[top(a)] = min(least.get(top(a), i), i)
    return [(i, t) for a, (i, t) in enumerate(rows) if i is None or i == least[top(a)]]


def clean(rows, passages):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ))

    windows = set()
    for _, p in passages:
        w = words(p)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for i, text in rows:
        w, hit = words(text), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, text))
    return out


def pieces(rows):
    out = Counter()
    for i, text in rows:
        n = len(re.findall(r"\S+", text))
        out.update((i, k, 2048 * k, min(2048, n - 2048 * k)) for k in range(max(1, -(-n // 2048))))
    return out


def test_every_stage_by_brute_force(spark, tmp_path, rows):
    docs, passages = rows
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # texts without a letter go, and nothing else: each text is of one language
    want = [[(d[0], d[1]) for d in docs if re.search(r"[^\W\d_]", d[1] or "")]]
    want += [kept_lines(want[0])]
    want += [one_of_similar(want[1])]
    want += [clean(want[2], passages)]
    assert len(want[0]) > len(want[2]) > len(want[3]) > 10 and want[0] != want[1]
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, given, str(tmp_path))
        assert found.columns == corpus_pipeline.COLUMNS
        found.write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        assert Counter((r["doc_id"], r["text"]) for r in given.collect()) == Counter(want[k]), name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["n_tokens"]) for r in packed.collect()) == pieces(want[3])


def test_each_stage_with_extra_and_clashing_columns(spark, tmp_path, rows):
    docs, passages = rows
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        given = spark.createDataFrame(docs[:30], SCHEMA).where(F.lit(not empty))
        for name, stage in corpus_pipeline.STAGES:
            assert (stage(spark, given, str(tmp_path)).count() == 0) == empty, name
