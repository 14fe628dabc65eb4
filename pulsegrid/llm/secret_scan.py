"""Secrets in whole texts, in DataFrame functions only.

Base rules find assigned values, access keys and hex runs. The method adds tokens that a character
Markov model of random strings explains better than one of ordinary identifiers: the mean
log-likelihood ratio of their character pairs is over a threshold. Both models are trained from
labelled samples: values that the base rules found and base64 of digests are random strings, the
other long tokens of the same texts are ordinary ones.

Spark gives matched strings, not positions. A text split at a pattern gives what lies between the
matches, so the running lengths of pieces and matches are the code-point positions.

Cases: a null text is empty and has no spans; rows that repeat are scanned alike; without ordinary
tokens nothing is added; a very long text is one string in one task, with time in proportion to its matches up to some hundred thousands; ids are not read, extra columns are kept whatever
their names, but columns base and added are replaced by the results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carrying import packed, quoted, unpacked

#: The base rules, in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED_CHARS = 12

#: A token that may be a secret, and one that trains the model of ordinary identifiers.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CLASSES = len(ALPHABET) + 1  # any other character is class 0

RANKS = {"assign": 0, "access": 1, "hex": 2, "markov": 3}


PART = 512
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "markov": (TOKEN, 0)}


def matched(rows: DataFrame, text: str, kinds: Sequence[str]) -> DataFrame:
    """``rows`` with a column of spans for each kind: all leftmost non-overlapping matches.

    Each list of matches is a column of its own before it is used, so no pattern is searched twice; values and what
    lies between the matches are only looked for in texts with a match.
    """
    found = rows.withColumns({f"whole_{k}": F.regexp_extract_all(text, F.lit(PATTERNS[k][0]), F.lit(0)) for k in kinds})
    more = {}
    for k in kinds:
        pattern, group = PATTERNS[k]
        some = F.size(f"whole_{k}") > 0
        more[f"between_{k}"] = F.when(some, F.split(text, pattern))
        more[f"value_{k}"] = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col(f"whole_{k}")
    found = found.withColumns(more).withColumns({f"pieces_{k}": pieces(k) for k in kinds}).withColumns({f"parts_{k}": in_parts(f"pieces_{k}") for k in kinds})
    return found.withColumns({k: walked(k) for k in kinds}).drop(*[f"{c}_{k}" for c in ("whole", "between", "value", "pieces", "parts") for k in kinds])


def pieces(kind: str) -> Column:
    """Each match with what lies before it."""
    whole = F.col(f"whole_{kind}")
    return F.arrays_zip(F.slice(f"between_{kind}", F.lit(1), F.size(whole)).alias("between"), whole.alias("whole"), F.col(f"value_{kind}").alias("value"))


def in_parts(array: str) -> Column:
    """An array in parts of ``PART`` elements. Appending to an array copies it, so long ones are put together part by part."""
    n = F.size(array)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(PART)), lambda i: F.slice(array, i, PART)))


def walked(kind: str) -> Column:
    """The spans of one kind: where each part of the matches begins, and from there each match."""
    parts, empty = F.col(f"parts_{kind}"), F.expr(f"cast(array() as {SPANS})")

    def begin(state: Column, part: Column) -> Column:
        size = F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["between"]) + F.length(x["whole"]))
        return F.struct((state["at"] + size).alias("at"), F.concat(state["found"], F.array(state["at"])).alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["between"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(RANKS[kind]).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    begins = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("found")), begin, lambda s: s["found"])
    spans = F.zip_with(parts, begins, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("found")), step, lambda s: s["found"]))
    return F.coalesce(F.flatten(spans), empty)


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with base, the base rules' spans in order of start and rule."""
    found = matched(rows, text, ("assign", "access", "hex"))
    assign = F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGNED_CHARS)
    return found.withColumn("base", F.array_sort(F.concat(assign, "access", "hex"))).drop("assign", "access", "hex")


def classes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def pairs(token: Column) -> Column:
    """The pairs of neighbouring character classes of a token, each as one number."""
    codes, n = classes(token), F.length(token) - 1
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * CLASSES + b)


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 20_000, drawn: int = 4_000, smoothing: float = 0.5, backoff: float = 5.0) -> list[float] | None:
    """Log-likelihood ratio (random over ordinary) of each pair of character classes.

    Trained on the whole texts of about ``max_docs`` documents at most, chosen by a hash of the text, and
    on ``drawn`` strings of 43 random characters.
    The driver receives at most two counts for each of the 69 x 69 pairs.
    """
    n = docs.count()
    known = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))
    known = with_base(known, "_text")
    rest = F.col("_text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    sample = known.select(F.transform("base", lambda s: s["value"]).alias("random"), F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)).alias("ordinary"))
    tokens = sample.select(F.explode(F.create_map(F.lit("random"), "random", F.lit("ordinary"), "ordinary")).alias("label", "tokens")).select("label", F.explode("tokens").alias("token"))
    digest = F.base64(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)))
    tokens = tokens.union(docs.sparkSession.range(drawn).select(F.lit("random"), F.substring(digest, 1, 43)))
    counts = tokens.select("label", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("label", "pair").count().collect()
    table = {label: [0.0] * CLASSES**2 for label in ("random", "ordinary")}
    for row in counts:
        table[row["label"]][row["pair"]] += row["count"] - 1  # what was seen once may be the secret itself
    if not any(table["ordinary"]):
        return None
    logs = {}
    for label, values in table.items():
        after = [sum(values[b::CLASSES]) for b in range(CLASSES)]
        single = [(n + smoothing) / (sum(after) + smoothing * CLASSES) for n in after]
        before = [sum(values[a * CLASSES : (a + 1) * CLASSES]) for a in range(CLASSES)]
        # a character that rarely came before falls back to how often the next one comes at all
        logs[label] = [math.log((v + backoff * single[i % CLASSES]) / (before[i // CLASSES] + backoff)) for i, v in enumerate(values)]
    return [r - o for r, o in zip(logs["random"], logs["ordinary"])]


def scan(docs: DataFrame, model: list[float] | None, text_col: str = "text", threshold: float = 1.0) -> DataFrame:
    """``docs`` with base (array of spans) and added (tokens over the threshold outside base spans)."""
    keep = [c for c in docs.columns if c not in ("base", "added")]
    rows = docs.select(packed(docs, keep).alias("kept"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    found = with_base(rows, "text")
    if model is None:
        return found.select(*unpacked("kept", keep), "base", F.slice("base", 1, 0).alias("added"))
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")

    def random(s: Column, near: Column) -> Column:
        total = F.aggregate(pairs(s["value"]), F.lit(0.0), lambda t, p: t + F.get(ratios, p))
        outside = ~F.exists(near, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        return outside & (total > threshold * (F.length(s["value"]) - 1))

    def beside(part: Column) -> Column:
        """A part of the tokens with the base spans that it may touch."""
        low, high = F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"]
        return F.struct(part.alias("tokens"), F.filter("base", lambda b: (b["start"] < high) & (b["end"] > low)).alias("near"))

    tokens = matched(found, "text", ("markov",)).withColumn("parts", in_parts("markov"))
    added = F.flatten(F.transform(F.transform("parts", beside), lambda p: F.filter(p["tokens"], lambda s: random(s, p["near"]))))
    return tokens.select(*unpacked("kept", keep), "base", F.coalesce(added, F.slice("base", 1, 0)).alias("added"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_corpus(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Train on ``docs``, then scan every row of it."""
    return scan(docs, fit(docs, text_col), text_col)
