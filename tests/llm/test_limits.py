"""Clashing names, malformed pages, hot keys, very long texts, and models against plain versions."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, exact_dedup, hot_keys, html_text, jaccard_join, language_id, line_dedup, secret_scan, substring_dedup, textbytes, toxicity

from .test_operators import prose

#: Names that operators use inside, or give to results.
NAMES = "_of _lines _doc _html _text _row _id text2 kept id digest drops lines n_lines n_dropped score lang_pred langs base added _tokens n_words hash word whole_hex html row".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + "\nthis line is in all of the documents", *[f"{n}{i}" for n in NAMES]) for i in range(6)]
    return spark.createDataFrame(rows, ["doc_id", "text", *NAMES])


def unchanged(found, but=()):
    rows = found.orderBy("doc_id").collect()
    assert len(rows) == 6
    for i, r in enumerate(rows):
        for n in NAMES:
            if n not in but:
                assert r[n] == f"{n}{i}", n
    return rows


def test_clashing_names(spark, clashing):
    rows = unchanged(line_dedup.dedup_lines(clashing), ["n_lines", "n_dropped"])
    assert [r.n_dropped for r in rows] == [1] * 5 + [0] and [r.n_lines for r in rows] == [2] * 6
    model = language_id.fit(clashing.withColumn("lang", F.lit("aa")))
    rows = unchanged(language_id.identify(clashing, model), ["lang_pred", "score", "langs"])
    assert {r.lang_pred for r in rows} == {"aa"}
    assert {r.score for r in unchanged(toxicity.score(clashing, None), ["score"])} == {0.0}
    assert {tuple(r.added) for r in unchanged(secret_scan.scan(clashing, None), ["base", "added"])} == {()}
    pages = clashing.withColumn("page", F.concat(F.lit("<p>"), "doc_id"))
    assert [r.text for r in unchanged(html_text.extract(pages, "page"))] == [str(i) for i in range(6)]
    keep = [n for n in NAMES if n != "n_words"]
    bench = spark.createDataFrame([(1, "this line is in all of the documents")], "item_id int, text string")
    found = decontaminate.decontaminate(clashing, bench, keep=["doc_id", *keep])
    assert {r.n_hit for r in unchanged(found, ["n_words"])} == {8}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(clashing, bench, keep=["n_words"])
    assert {r.group_size for r in unchanged(exact_dedup.exact_dedup(clashing, carry=[n for n in NAMES if n != "kept"]), ["kept"])} == {1}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(clashing.withColumn("kept", F.lit(1)), carry=["kept"])


def test_malformed_pages_take_no_time():
    pages = {
        "names": "<a" * 100_000,
        "open": "<div>" * 100_000,
        "paragraphs": "<p><button>" + "<div>" * 50_000,
        "quotes": "<a \">\"" * 20_000,
        "odd quotes": "<a '" * 50_000 + ">",
        "comments": "<!--" * 50_000,
        "inline": "x<b>y</b>" * 40_000,
        "lists": "<ul><li>" * 20_000,
        "spans": "<table>" + "<tr><td colspan=1000 rowspan=9999>x" * 2_000,
        "tables": "<table><tr><td>" * 3_000,
        "columns": "<table><tr>" + "<td>x" * 5_000 + "<tr><td>y" * 5_000,
    }
    for name, page in pages.items():
        start = time.process_time()
        html_text.render(page)
        assert time.process_time() - start < 2, name
    assert html_text.render("<p>a<b") == "a<b" and html_text.render("a<!-->b<!-- c --") == "ab"


def test_wide_cells_stay_aligned():
    words = " ".join(["word"] * 30)
    rows = html_text.render(f"<table><tr><td>{words}<td>b<td>c<tr><td>a<td>{'x' * 90}<td>{words}</table>").split("\n")
    assert len({line.index("b") for line in rows if "b" in line}) == 1
    assert rows[0].index("c") == rows[-1].index("word") and rows[-1].endswith(words)
    assert rows[0].index("b") == rows[-1].index("x")


def test_only_suspects_are_shuffled(spark):
    """One range or many: rows of texts that occur once are in no exchange with their digest."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = []
    keep = exact_dedup.stage

    def counted(df, name):
        out = keep(df, name)
        if name == "exact_suspects":
            sizes.append(out.count())
        return out

    exact_dedup.stage = counted
    try:
        for words in (500_000, 20):
            found = exact_dedup.exact_dedup(rows, range_words=words)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" not in plan and "Python" not in plan
            sums = found.agg(F.count(F.lit(1)), F.count_if("kept"), F.max("group_size")).first()
            assert tuple(sums) == (30_000, 29_701, 300)
    finally:
        exact_dedup.stage = keep
    assert all(300 <= n < 1_500 for n in sizes) and len(sizes) == 2


def test_join_groups(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") < 3_000, 0).otherwise(F.col("id") % 700).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k % 3 = 0")
    found = hot_keys.join_groups(rows, groups, ["k"], F.col("n"), 5_000, least=10)
    want = rows.join(groups, "k").select("id", "k", "n", "top")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_families_and_chains_of_near_copies(spark):
    """Components against all pairs, with groups so small that most sets ask several."""
    rng = random.Random(17)
    texts = []
    for _ in range(3):
        base = prose(rng, 120).split()
        for _ in range(40):
            base[rng.randrange(len(base))] = f"w{rng.randint(0, 999)}"  # a chain: each is like the one before
            texts.append(" ".join(base))
    footer = " " + prose(rng, 12)
    texts += [prose(rng, 60) + footer for _ in range(30)] + [texts[5], texts[50]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in zip(order, texts) for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(list(zip(order, texts)), "doc_id long, text string").repartition(3)
    for size in (2, 256):
        found = jaccard_join.jaccard_components(df, group_size=size, queries_per_task=4)
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: find(i) for i in sets}


def test_hashes_in_blocks():
    rng = random.Random(5)
    texts = ["x" * 5_000 + " " + prose(rng, 3_000), "", prose(rng, 10), "y" * 4_000]
    import pyarrow as pa

    is_word = np.ones(256, bool)
    is_word[32] = False
    found, block = [], textbytes.BLOCK
    try:
        for textbytes.BLOCK in (1 << 17, 1_000):
            textbytes._table.cache_clear()
            for size in (1 << 18, 50):
                out = []
                for c in textbytes.chunks(pa.array(texts), size):
                    starts, ends, docs = textbytes.words(c, is_word)
                    out += zip((docs + c.first).tolist(), textbytes.span_hashes(c.data, starts, ends).tolist())
                found.append(out)
    finally:
        textbytes.BLOCK = block
        textbytes._table.cache_clear()
    assert all(x == found[0] for x in found) and len(set(found[0])) > 2_000


def test_trigrams_in_blocks():
    data = np.frombuffer(prose(random.Random(6), 3_000).encode() + " ende é".encode(), np.uint8)
    whole, parts = (language_id.bucket_counts(data, np.array([0, len(data)]), 1 << 14, block) for block in (1 << 18, 777))
    two = language_id.bucket_counts(np.concatenate([data, data[:50]]), np.array([0, len(data), len(data) + 50]), 1 << 14)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert np.array_equal(two[1][two[0] == 0], whole[1]) and np.array_equal(two[2][two[0] == 0], whole[2])


def test_mixture_against_plain_em():
    rng = np.random.default_rng(3)
    probs = rng.dirichlet(np.ones(40) * 0.3, 3).T + 1e-4
    model = language_id.LanguageModel(["a", "b", "c"], (probs / probs.sum(axis=0)).astype(np.float32))
    buckets = [np.sort(rng.choice(40, 15, replace=False)) for _ in range(4)]
    counts = [rng.integers(1, 9, 15).astype(float) for _ in range(4)]
    flat = np.concatenate(buckets)
    got, fit = model.mixture(model.probs[flat], np.concatenate(counts), np.arange(0, 60, 15), np.full((4, 3), 1 / 3))
    for d in range(4):
        pi = [1 / 3] * 3
        for _ in range(model.rounds):
            total = [0.0] * 3
            for b, n in zip(buckets[d], counts[d]):
                joint = [p * float(model.probs[b, j]) for j, p in enumerate(pi)]
                for j in range(3):
                    total[j] += n * joint[j] / sum(joint)
            pi = [t / sum(counts[d]) for t in total]
        assert got[d] == pytest.approx(pi, abs=1e-4)
        assert fit[d] == pytest.approx(sum(n * math.log(sum(p * float(model.probs[b, j]) for j, p in enumerate(pi))) for b, n in zip(buckets[d], counts[d])), rel=1e-5)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_corpus(docs).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97


def test_toxicity_scores_against_plain_windows():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(rng.normal(size=1 << 10).astype(np.float32), -0.3, 32)
    import pyarrow as pa

    texts = [prose(random.Random(i), n) for i, n in enumerate((1, 4, 30, 200))] + ["", "ab é x9"]
    got = []
    for chunk in textbytes.chunks(pa.array(texts)):
        got += model.scores(chunk.data, chunk.offsets).tolist()
    for text, score in zip(texts, got):
        x = bytes([32]) + bytes(toxicity.CHARS[np.frombuffer(text.encode(), np.uint8)])
        y = x + b" "
        n = len(x)
        begins = range(0, max(1, n - 32 + 16), 16)
        best = -math.inf
        for begin in begins:
            total = count = 0
            for at in range(begin, min(begin + 32, n)):
                for size in toxicity.SIZES:
                    gram = y[at : at + size]
                    if len(gram) == size and 32 not in gram[1:-1]:
                        code = 0
                        for c in gram:
                            code = (code * 0x01000193 & 0xFFFFFFFF) ^ c
                        h = (code + size) * 2654435769 & 0xFFFFFFFF
                        h ^= h >> 15
                        total += float(model.weights[(h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - 10)])
                        count += 1
            best = max(best, total / max(1, count) + model.bias)
        assert score == pytest.approx(1 / (1 + math.exp(-best)), abs=1e-5), text[:20]


def test_random_tokens_are_found_and_names_are_not(spark):
    """Recall and precision of the likelihood ratio on labelled tokens, and its value against a plain version."""
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["user", "account", "session", "request", "handler", "manager", "factory", "default", "connection", "string", "value", "create", "update", "internal", "message", "number"]
    name = lambda: "".join(rng.choice(words).title() for _ in range(4)) if rng.random() < 0.5 else "_".join(rng.choice(words) for _ in range(4))
    secret = lambda: "".join(rng.choice(letters) for _ in range(32))
    rows, wanted, clean = [], set(), set()
    for i in range(400):
        own, s = [name() for _ in range(6)], secret()
        text = " ".join([*own[:3], s if i % 4 == 0 else "plain", *own[3:], "token=" + secret()])
        rows.append((i, text))
        wanted |= {(i, s)} if i % 4 == 0 else set()
        clean |= {(i, n) for n in own}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.fit(df)
    found = {(r.doc_id, s["value"]) for r in secret_scan.scan(df, model).collect() for s in r.added}
    assert len(found & wanted) >= 0.98 * len(wanted) and len(found - wanted) <= 0.02 * len(clean)

    def ratio(token):
        codes = [secret_scan.ALPHABET.find(c) + 1 for c in token]
        return sum(model[a * secret_scan.CLASSES + b] for a, b in zip(codes, codes[1:])) / (len(token) - 1)

    assert found == {(i, t) for i, text in rows for t in re.findall(secret_scan.TOKEN, text) if not text.endswith("token=" + t) and t != text.split("token=")[1] and ratio(t) > 1.0 and "token=" not in t}


def test_long_shared_passage(spark):
    """Two texts of over 200,000 words that share most: the passage is as long as it is."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"w{n}" for n in rng.integers(0, 10**6, 200_000))
    head, tail = (" ".join(f"{c}{n}" for n in rng.integers(0, 10**6, 300)) for c in "xy")
    df = spark.createDataFrame([(1, f"{head} {shared}"), (2, f"{shared} {tail}")], "doc_id long, text string")
    found = substring_dedup.repeated_passages(df).collect()
    words = sorted((r.start, r.n_words, r.other_start, r.other_words) for r in found)
    covered = np.zeros(200_000, bool)
    for start, n, _, _ in words:
        covered[start : start + n] = True
    assert len(words) <= 2 and covered.all()


def test_all_repeated_passages_by_brute_force(spark):
    """Every pair of documents with an equal run of 50 words, and none without a similar one."""
    rng = random.Random(23)
    pool = [prose(rng, rng.randint(50, 90)) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randint(5, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(1, rng.choice(pool))
        if i % 5 == 0:
            parts.insert(2, rng.choice(pool))
        rows.append((i, " ".join(parts)))
    runs = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            runs[tuple(w[j : j + 50])].add(i)
    want = Counter((a, b) for own in runs.values() for a in own for b in own if a < b)
    link = {i: i for i, _ in rows}

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in want:
        link[find(b)] = find(a)
    got = {i: i for i, _ in rows}

    def seek(x):
        while got[x] != x:
            x = got[x]
        return x

    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        assert (min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) in want
        got[seek(r.other_id)] = seek(r.doc_id)
    same = lambda f: {frozenset(i for i, _ in rows if f(i) == k) for k in {f(i) for i, _ in rows}}
    assert same(find) == same(seek)


def test_a_text_with_very_many_secrets(spark):
    """200,000 tokens in one text: parts of matches are put together, not one list that grows by each."""
    rng = random.Random(1)
    words = ["%032x" % rng.getrandbits(128) if i % 2 else "Word%d_x%s" % (i, "".join(rng.choice("ABCdefGHIjkl0123") for _ in range(20))) for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "none")], "doc_id long, text string")
    begun = time.perf_counter()
    found = {r["doc_id"]: r for r in secret_scan.scan(df, [0.1] * secret_scan.CLASSES**2, threshold=0.01).collect()}
    assert time.perf_counter() - begun < 30
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    assert [(s["start"], s["end"]) for s in found[1]["base"]] == [(s, s + 32) for s, w in zip(starts, words) if len(w) == 32 and w[0] != "W"]
    assert [s["start"] for s in found[1]["added"]] == [s for s, w in zip(starts, words) if w[0] == "W"]
    assert found[2]["base"] == found[3]["base"] == found[2]["added"] == []


def test_tags_of_very_many_quoted_values():
    """However many there are, what is in quotes ends no tag; pages made to be scanned again and again take no longer."""
    for n in (1, 199, 200, 250, 5_000):
        values = " ".join(f"a{i}={q}x>{i}{q}" for i, q in zip(range(n), "'\"" * n))
        assert html_text.render(f"<p {values}>seen <b {values}>too</b></p>") == "seen too", n
        assert html_text.render(f"<p {values} b='open>seen</p>") == html_text.render(f"<p {values.split('>')[0]}>" + values.split(">", 1)[1] + " b='open>seen</p>"), n
    begun = time.perf_counter()
    for piece in ("<a b=\"x' ", "<a 'x\" ", "<a b=\"c\" d='e ", "<a ", "<a b='>\" "):
        for tail in ("", ">", "'>", "\">", "\"'>"):
            html_text.render(piece * 20_000 + tail)
    assert time.perf_counter() - begun < 60


def test_end_of_a_tag_by_brute_force():
    """``Quotes.end`` against a walk over the characters, asked for every place of one page in any order."""
    rng = random.Random(4)
    for _ in range(300):
        page = "".join(rng.choice("<a \"'>") for _ in range(rng.randint(0, 60)))

        def plain(at):
            quote = None
            for i in range(at, len(page)):
                if quote is None and page[i] == ">":
                    return i
                if quote is None and page[i] in "\"'":
                    quote = page[i]
                elif page[i] == quote:
                    quote = None
            return None

        quotes, places = html_text.Quotes(page), list(range(len(page) + 1))
        rng.shuffle(places)
        assert [quotes.end(at) for at in places] == [plain(at) for at in places]
