"""What a user plugs in: transforms by type, a guard on any source, and a judge (the deterministic one only)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import SESSION_CAP

CACHE_CAP, DELTA_CAP = 10_000_000_000, 500_000_000
#: What each remainder of a seed stands for.
OUTCOMES = ("completed", "completed", "completed", "partial", "abandoned")
JUDGED_MODES = ("leverage", "leverage", "leverage", "leverage", "debugging", "debugging", "learning", "exploratory", "dependent", "dependent")
#: How far each capability's bits are shifted.
CAPABILITY_SHIFTS = {"cap_problem": 11, "cap_context": 17, "cap_debug": 23, "cap_tool": 29, "cap_self": 31}


def routed(df: DataFrame, column: str, transforms: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row through the transform of its type; types are compared in lower case, others' rows are left out."""
    parts = [transform(df.where(F.lower(column) == kind.lower())) for kind, transform in transforms.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def guarded(df: DataFrame, totals: Sequence[str] = (), cache_totals: Sequence[str] = (), deltas: Sequence[str] = (), previous: dict[str, str] | None = None) -> DataFrame:
    """ST-13 on what any source gives: totals out of bounds become the value before (a column named in ``previous``) or 0, deltas become 0."""
    out = {}
    for names, cap in ((totals, SESSION_CAP), (cache_totals, CACHE_CAP), (deltas, DELTA_CAP)):
        for name in names:
            before = F.coalesce(F.col(previous[name]), F.lit(0)) if previous and name in previous and names is not deltas else F.lit(0)
            out[name] = F.when(F.col(name).isNull() | F.col(name).between(0, cap), F.col(name)).otherwise(before)
    return df.withColumns(out) if out else df


def text_code(text: str) -> int:
    """The sum of a text's UTF-16 units times powers of 31, as a signed 32-bit number."""
    units = text.encode("utf-16-be")
    code = 0
    for i in range(0, len(units), 2):
        code = (31 * code + int.from_bytes(units[i : i + 2])) & 0xFFFFFFFF
    return code - (1 << 32) if code >> 31 else code


def mock_verdict(prompt: Column, model: str) -> Column:
    """A judge's verdict that depends on nothing but the prompt and the judge's name; no model is called."""
    seed = F.crc32(F.concat(F.coalesce(prompt, F.lit("")), F.lit("|" + model)).cast("binary"))
    code = text_code(model)
    salt = abs(code) % 3

    def bits(shift: int, n: int) -> Column:
        return (F.shiftrightunsigned(seed, shift) % n).cast("int")

    def one_of(names: Sequence[str], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)

    capabilities = [F.greatest(F.lit(1), F.least(F.lit(5), bits(shift, 5) + salt)).alias(name) for name, shift in CAPABILITY_SHIFTS.items()]
    return F.struct(F.lit(model).alias("judge"), ((seed % 5) + 1).cast("int").alias("difficulty"), one_of(OUTCOMES, bits(3, 5)).alias("outcome"), one_of(JUDGED_MODES, bits(7, 10)).alias("mode"), *capabilities)


def two_verdicts(df: DataFrame, prompt: str, judges: tuple[str, str] = ("judge-a", "judge-b")) -> DataFrame:
    """ST-10: both judges' verdicts and what they agree on: rounded means, the category of the one who found it harder (the first on a tie)."""
    a, b = (mock_verdict(F.col(prompt), name) for name in judges)
    both = df.withColumns({"first": a, "second": b})
    harder = F.when(F.col("second.difficulty") > F.col("first.difficulty"), F.col("second")).otherwise(F.col("first"))
    mean = {c: F.floor((F.col(f"first.{c}") + F.col(f"second.{c}")) / 2 + 0.5).cast("int") for c in ("difficulty", *CAPABILITY_SHIFTS)}
    apart = (F.abs(F.col("first.difficulty") - F.col("second.difficulty")) > 1) | (F.col("first.outcome") != F.col("second.outcome")) | (F.col("first.mode") != F.col("second.mode"))
    return both.withColumns(mean | {"outcome": harder["outcome"], "mode": harder["mode"], "disagreement": apart}).drop("first", "second")
