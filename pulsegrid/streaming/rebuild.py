"""Tables by day and user that follow late rows (MAT-3, MAT-6): pairs are marked, leased to one builder, and built anew.

Marks, leases and results are rows of one ``Ledger``. A builder leases pairs that are due in one commit, which no other builder
can make from the same manifest, so two never build one pair at once; its results and the end of the lease are one commit again.
A lease that runs out is due once more, and so is a pair that was marked while it was built.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.shared import stage

from .ledger import Ledger, Manifest

TRIES = 20  # builders meet often, and what they commit is small

PAIR = ["work_date", "user_code"]
MARKS = "work_date date, user_code string, kind string, builder string, until timestamp_ntz"


class Builds:
    """Pairs of day and user below ``path``, and what was built for them: ``result`` is DDL of the columns besides the pair."""

    def __init__(self, spark: SparkSession, path: str, result: str):
        self.spark = spark
        self.ledger = Ledger(spark, path, {"marks": MARKS, "results": f"work_date date, user_code string, {result}, gone boolean"})

    def mark(self, pairs: DataFrame, source: str, batch: int) -> bool:
        """Note that rows of these pairs came with a batch; a batch that comes again changes nothing."""
        return self.ledger.commit(source, batch, lambda _: {"marks": self._marks(pairs.select(*PAIR).distinct(), "open")})

    def _marks(self, pairs: DataFrame, kind: str, builder: str | None = None, until: datetime | None = None) -> DataFrame:
        return pairs.select(*PAIR, F.lit(kind).alias("kind"), F.lit(builder).cast("string").alias("builder"), F.lit(until).cast("timestamp_ntz").alias("until"))

    def due(self, now: datetime, at: Manifest | None = None) -> DataFrame:
        """Pairs that wait for a builder."""
        last = {kind: F.max(F.when(F.col("kind") == kind, F.col("version"))).alias(kind) for kind in ("open", "lease", "done")}
        until = F.max_by("until", F.when(F.col("kind") == "lease", F.col("version"))).alias("until")
        pairs = self.ledger.table("marks", at).groupBy(*PAIR).agg(*last.values(), until)
        leased, ended = F.col("lease").isNotNull(), F.coalesce(F.col("done") > F.col("lease"), F.lit(False))
        waits = F.when(~leased, F.col("open").isNotNull()).when(ended, F.col("open") > F.col("lease")).otherwise(F.col("until") <= F.lit(now).cast("timestamp_ntz"))
        return pairs.where(waits).select(*PAIR)

    def lease(self, builder: str, now: datetime, most: int = 1_000, seconds: int = 600) -> DataFrame | None:
        """Up to ``most`` due pairs, earliest days first, now this builder's; None if there are none."""
        taken: list[DataFrame] = []

        def work(at: Manifest) -> dict[str, DataFrame]:
            pairs = stage(self.due(now, at).orderBy(*PAIR).limit(most), "leased")
            taken[:] = [pairs]
            return {} if pairs.isEmpty() else {"marks": self._marks(pairs, "lease", builder, now + timedelta(seconds=seconds))}

        return taken[0] if self.ledger.commit(None, 0, work, TRIES) else None

    def finish(self, builder: str, pairs: DataFrame, built: DataFrame) -> bool:
        """Keep what was built for the pairs that are still this builder's, also that there is nothing left for one; False if none are."""
        names = [c for c in built.columns if c not in PAIR]
        known = stage(built.join(pairs, PAIR, "left_semi"), "built")

        def work(at: Manifest) -> dict[str, DataFrame]:
            last = self.ledger.table("marks", at).where("kind <> 'open'").groupBy(*PAIR).agg(F.max_by(F.struct("kind", "builder"), "version").alias("m"))
            own = stage(pairs.join(last, PAIR).where((F.col("m.kind") == "lease") & (F.col("m.builder") == builder)).select(*PAIR), "own")
            if own.isEmpty():
                return {}
            rows = own.join(known.withColumn("_there", F.lit(True)), PAIR, "left")
            return {"results": rows.select(*PAIR, *names, F.col("_there").isNull().alias("gone")), "marks": self._marks(own, "done", builder)}

        return self.ledger.commit(None, 0, work, TRIES)

    def results(self) -> DataFrame:
        """The table as it is: of each pair the rows that were built last."""
        newest = F.max("version").over(W.partitionBy(*PAIR))
        return self.ledger.table("results").withColumn("_newest", newest).where("version = _newest and not gone").drop("_newest", "gone")

    def run(self, builder: str, now: Callable[[], datetime], build: Callable[[DataFrame], DataFrame], most: int = 1_000) -> int:
        """Lease and build until nothing is due; how many leases that took. ``build`` makes the rows of the pairs it is given."""
        rounds = 0
        while (pairs := self.lease(builder, now(), most)) is not None:
            self.finish(builder, pairs, build(pairs))
            rounds += 1
        return rounds
