"""STR-15: what fits into a client's next report, by a budget of bytes that follows what the server takes.

Sessions that are not idle come first, then those active last. Each brings its own bytes and as many of its messages, in
order, as there is room for; one that does not fit is left for later and a smaller one behind it may still go. The first session goes in any case,
with one message at least, or a client with one large session would never send anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a report's envelope, the least budget, and after how many full reports it grows again.
ENVELOPE, LEAST, REGROW = 4 << 10, 32 << 10, 10
HELD_BACK = timedelta(hours=1)


@dataclass
class Budget:
    """Bytes of a client's next report: halved when one is refused, doubled after ``REGROW`` that filled half of it."""

    most: int
    current: int = 0
    streak: int = 0

    def __post_init__(self) -> None:
        self.current = self.current or self.most

    def refused(self, used: int) -> None:
        """The report was too large: half of what was sent, if that was less than the budget."""
        self.current, self.streak = max(LEAST, min(self.current, used or self.current) // 2), 0

    def taken(self, used: int) -> None:
        """Small reports say nothing about the budget."""
        if self.current < self.most and used * 2 >= self.current:
            self.streak += 1
            if self.streak == REGROW:
                self.current, self.streak = min(self.most, self.current * 2), 0


class Room:
    """A client's report while it is filled, session by session and message by message."""

    def __init__(self, budget: int):
        self.budget, self.used, self.sessions = budget, ENVELOPE, 0
        self.session: object = None
        self.open = False

    def fits(self, session: object, base: int, size: int | None) -> bool:
        """Whether the next row goes in; ``size`` is None for a session without messages."""
        if session != self.session:
            self.session, forced = session, self.sessions == 0
            self.open = forced or self.used + base + (size or 0) <= self.budget
            if self.open:
                self.sessions += 1
                self.used += base + (size or 0)
            return self.open
        self.open = self.open and self.used + size <= self.budget
        self.used += size if self.open else 0
        return self.open


def next_report(rows: DataFrame, budgets: DataFrame, held: DataFrame | None = None, now: datetime | None = None) -> DataFrame:
    """``rows`` (client, session, idle, last_activity, base, seq, size) with sent: whether a row is in its client's next report.

    ``budgets``: client, budget. ``held``: client, session, until; sessions that are held back at ``now`` are not in it. Each client
    passes as a sorted stream. A session without messages is one row without seq and size.
    """
    order = ["client", "idle", F.desc_nulls_last("last_activity"), "session", F.asc_nulls_first("seq")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, room = None, None
        for batch in batches:
            sent = []
            for who, session, base, size, budget in zip(batch["client"], batch["session"], batch["base"], batch["size"], batch["_budget"]):
                if room is None or who != client:
                    client, room = who, Room(int(budget))
                sent.append(room.fits(session, int(base), None if pd.isna(size) else int(size)))
            yield batch.drop(columns="_budget").assign(sent=sent)

    fresh = rows
    if held is not None:
        blocked = held.where(F.col("until") > F.lit(now).cast("timestamp_ntz")).select("client", "session").distinct()
        fresh = rows.join(blocked, ["client", "session"], "left_anti")
    sized = fresh.join(budgets.select("client", F.col("budget").alias("_budget")), "client").select(*rows.columns, "_budget")
    return sized.repartition("client").sortWithinPartitions(*order).mapInPandas(run, f"{kinds}, sent boolean")


def report_sizes(report: DataFrame) -> DataFrame:
    """client, used, sessions, messages of what is sent: what a refusal is judged by. A refused report of one message can not shrink; its session is held back for ``HELD_BACK``."""
    own = report.where("sent").groupBy("client", "session").agg(F.max("base").alias("base"), F.sum(F.coalesce("size", F.lit(0))).alias("size"), F.count("seq").alias("messages"))
    return own.groupBy("client").agg((F.sum(F.col("base") + F.col("size")) + ENVELOPE).alias("used"), F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"), F.min("session").alias("first"))
