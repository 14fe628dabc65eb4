"""Grouped measures over the joined event, message and session tables (AGG)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rollup:
    """Measures by keys. Keys and measures are aliases with SQL expressions over the input's columns."""

    measures: dict[str, str]
    keys: dict[str, str] = field(default_factory=dict)
    where: str = "true"
    order: tuple[str, ...] = ()

    def of(self, df: DataFrame) -> DataFrame:
        """One partial and one final aggregation; without keys always one row."""
        grouped = df.where(self.where).groupBy(*[F.expr(e).alias(k) for k, e in self.keys.items()])
        out = grouped.agg(*[F.expr(e).alias(k) for k, e in self.measures.items()]) if self.measures else grouped.agg(F.lit(1).alias("_one")).drop("_one")
        return out.orderBy(*[F.expr(o.split()[0]).desc() if o.endswith(" desc") else F.expr(o) for o in self.order]) if self.order else out


def with_session(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Facts with their session's columns (s_...); Spark broadcasts the sessions when they are small."""
    side = sessions.select(*[F.col(c).alias(f"s_{c}") for c in sessions.columns])
    return facts.join(side, facts["session_id"] == side["s_id"])
