"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, exact_dedup, html_text, jaccard_join, language_id, line_dedup, packing, phrases, secret_scan, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", secret_scan.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(every).alias("spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_corpus(table(spark, sf_dir, "documents"))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.format_chats(table(spark, sf_dir, "conversations").select(probe.columns).union(probe)))
    return found.withColumnRenamed("conversation", "conv_id")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_text": op9_html_text,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_chat_format": op12_chat_format,
    "op13_centroids": op13_centroids,
}

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def lloyd_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """All rounds of op13 written out, one pair of common table expressions each."""
    squares = f"list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) for i in range(1, {dims} + 1)])"
    steps = []
    for i in range(rounds + 1):
        nearest = f"SELECT v.row, c.cluster, {squares} AS far FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY far, c.cluster) = 1"
        steps.append(f"a{i} AS MATERIALIZED ({nearest})")
        floor = "((s - ((s % n) + n) % n) // n)"
        moved = f"""SELECT cluster, list({floor} ORDER BY pos) AS q FROM (
            SELECT a.cluster, pos, CAST(count(*) AS HUGEINT) AS n, CAST(sum(v.q[pos]) AS HUGEINT) AS s FROM a{i} a JOIN v USING (row), range(1, {dims} + 1) r(pos) GROUP BY ALL) GROUP BY cluster"""
        steps.append(f"m{i} AS MATERIALIZED ({moved}), c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    usable = f"len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings WHERE {usable}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, q FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k}),
        {", ".join(steps)}
        SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.far AS BIGINT) AS distance, CAST(sum(a.far) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c USING (cluster)"""


ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (SELECT *, {ASCII_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM line),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id < keeper AS lost FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({ASCII_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_collocations": rf"""
        WITH low AS (SELECT coalesce(lang, 'und') AS lang, {ASCII_LOWER.format("coalesce(text, '')")} AS text FROM documents),
        piece AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM low),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
        size AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
        spans AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM worded),
        occurs AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM spans),
        often AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, CAST(count(*) AS HUGEINT) AS f FROM occurs GROUP BY lang, phrase HAVING count(*) >= 100),
        cuts AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
        valued AS (SELECT c.lang, c.phrase, c.k, c.a, l.f AS l, r.f AS r, CAST(s.n AS HUGEINT) AS n, (1000 * c.a * s.n) // (l.f * r.f) AS score, c.cut
            FROM cuts c JOIN size s USING (lang) JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ')
            JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
        best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        stays AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.lang = b.lang AND o.k > b.k AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= 100 * b.a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
    "op12_chat_format": rf"""
        WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE}'),
        marked AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g') AS shown FROM said)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(shown) + CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op13_centroids": lloyd_sql(),
}
