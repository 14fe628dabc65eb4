"""Ordered folds by key that run over a table or live over a stream, with the same result (STR-10, 16, 17, 18, 20).

A fold says what a row does to its key's state and when the state acts by itself. Over a table each key passes
as a sorted stream. Live, a row waits in the state store until the watermark has passed it, so that it does not matter
which micro-batch brings it; then the rows are folded in order, and a timer stands for the moment at which the state
acts next: it lets a debounced build go, or drops what need not be known any longer. Rows later than ``late`` are dropped, as by
every watermark; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pulsegrid.shared import own_folder

SECOND = 1_000_000  # times are microseconds
RUN, CUTS, FEW = 65_536, 32, 16
AT_ONCE = RUN // CUTS  # rows of an entry of a full run
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold:
    """What a key's rows do in order. ``state``, ``row`` and ``result`` are DDL; results begin with a time ``at``."""

    state: str
    row: str
    result: str

    def step(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after a row, and what it yields; ``state`` is None where nothing is known of the key."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the state acts by itself if no row comes before."""
        return None

    def expire(self, state: tuple) -> list[tuple]:
        """What the state yields when it is due; it is dropped then."""
        return []

    def advance(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """``step`` after what was due by ``at``."""
        found: list[tuple] = []
        if state is not None and (when := self.due(state)) is not None and when <= at:
            found, state = self.expire(state), None
        state, more = self.step(state, at, row)
        return state, found + more


@dataclass
class Claims(Fold):
    """STR-17: a key is claimed by its first row and forgotten ``keep`` seconds later; rows in between are replays."""

    keep: int = 600
    state, row, result = "claimed long", "id long", "at long, id long"

    def step(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        return (state, []) if state else ((at,), [(at, row[0])])

    def due(self, state: tuple) -> int:
        return state[0] + self.keep * SECOND


@dataclass
class Throttle(Fold):
    """STR-18, STR-20: a row passes ``seconds`` after the last that did, and says how many were held back since.

    ``forget`` seconds after a row passed, its key is forgotten and with it what was held back.
    """

    seconds: int = 600
    forget: int = 86_400
    state, row, result = "last long, held long", "id long", "at long, id long, suppressed long"

    def step(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        if state is not None and at - state[0] < self.seconds * SECOND:
            return (state[0], state[1] + 1), []
        return (at, 0), [(at, row[0], state[1] if state else 0)]

    def due(self, state: tuple) -> int:
        return state[0] + max(self.seconds, self.forget) * SECOND


@dataclass
class Debounce(Fold):
    """STR-10: work is due ``quiet`` seconds after its last mark, ``most`` seconds after the first at the latest.

    A mark names a user, or none: then the work is for all. One row for each user to build, or one without a user
    for a full build, which no later mark turns into a smaller one.
    """

    quiet: int = 15
    most: int = 60
    state, row, result = "first long, last long, marks long, full boolean, users array<string>", "user string", "at long, marks long, user string"

    def step(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        first, _, marks, full, users = state or (at, at, 0, False, [])
        user = row[0]
        known = users if isinstance(users, set) else set(users)  # grows in place while rows are folded
        if user is not None:
            known.add(user)
        return (first, at, marks + 1, full or user is None, known), []

    def due(self, state: tuple) -> int:
        return min(state[1] + self.quiet * SECOND, state[0] + self.most * SECOND)

    def expire(self, state: tuple) -> list[tuple]:
        return [(self.due(state), state[2], user) for user in ([None] if state[3] else sorted(state[4]))]


@dataclass
class Unchanged(Fold):
    """STR-16: a snapshot of an idle session that looks as the last one sent is held back, for ``resync`` seconds after that one."""

    resync: int = 900
    state, row, result = "print long, sent long", "id long, print long, idle boolean", "at long, id long"

    def step(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        number, print_, idle = row
        if state is not None and idle and state[0] == print_:
            return state, []
        return (print_, at), [(at, number)]

    def due(self, state: tuple) -> int:
        return state[1] + self.resync * SECOND


def shaped(rows: DataFrame, key: str, at: str, payload: list[Column]) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), *payload)


def folded(rows: DataFrame, key: str, at: str, payload: list[Column], fold: Fold) -> DataFrame:
    """``fold`` over a whole table: key and results; rows of one time go in order of ``payload``."""
    names = StructType.fromDDL(fold.result).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[c].astype(object).where(batch[c].notna(), None) for c in batch.columns]
            for who, when, *row in zip(*columns):
                if not begun or who != current:
                    out += [(current, *x) for x in (fold.expire(state) if state is not None else [])]
                    current, state, begun = who, None, True
                state, found = fold.advance(state, int(when), tuple(row))
                out += [(who, *x) for x in found]
            yield pd.DataFrame(out, columns=["key", *names])
        if state is not None:
            yield pd.DataFrame([(current, *x) for x in fold.expire(state)], columns=["key", *names])

    ready = shaped(rows, key, at, payload)
    ordered = ready.repartition("key").sortWithinPartitions(*ready.columns)
    return timed(ordered.mapInPandas(run, f"key string, {fold.result}"))


def timed(found: DataFrame) -> DataFrame:
    return found.withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz"))


def in_order(row: tuple) -> tuple:
    """What rows are sorted by: all their values, nulls first."""
    return tuple((x is not None, x) for x in row)


def stored(state: tuple | None) -> tuple | None:
    """A fold's state as the store takes it."""
    return None if state is None else tuple(sorted(x) if isinstance(x, set) else x for x in state)


def unpacked(few: bytes | None) -> list[tuple]:
    """The few rows that wait in a key's value."""
    return pickle.loads(few) if few else []


class InOrder(StatefulProcessor):
    """Runs a fold live: rows wait for the watermark, then go in order; one timer is set for what comes next.

    Every call of the store costs as much as thousands of rows. Up to ``FEW`` rows wait in the value that is read and written for
    their key anyway. More rows wait in sorted runs of up to ``RUN`` rows, each cut into about ``CUTS`` entries, single rows at the
    least. When a timer rings, the runs that have begun are merged, an entry of each in memory at a time, and what the watermark
    has not passed waits again, as one run if it is more than a few rows. Where no more rows wait than one entry of a full run has,
    one call reads all entries, and one drops them if all have begun.
    """

    def __init__(self, fold: Fold):
        self.fold = fold
        held = StructType.fromDDL(fold.state)  # here, because workers have no session to read DDL with
        self.known_schema = StructType().add("timer", "long").add("runs", "long").add("stock", "long").add("few", "binary").add("held", held)
        self.place_schema = StructType().add("first", "long").add("run", "long").add("part", "long")
        self.rows_schema = StructType().add("rows", "binary")
        self.made = Row("key", *StructType.fromDDL(fold.result).names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.known_schema)
        self.waiting = handle.getMapState("waiting", self.place_schema, self.rows_schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        timer, runs, stock, few, held = self.known.get() or (None, 0, 0, None, None)
        earliest = None
        every = (tuple(row)[1:-1] for row in rows)  # without key and watermark column
        while run := sorted(islice(every, RUN), key=in_order):
            earliest = run[0][0] if earliest is None else min(earliest, run[0][0])
            runs, stock, few = self.wait(run, runs, stock, few)
        self.wake(timer, (runs, stock, few), None if held is None else tuple(held), earliest)  # the store takes no nested Row
        return iter([])

    def wait(self, run: list[tuple], number: int, stock: int, few: bytes | None) -> tuple[int, int, bytes | None]:
        """Let a sorted run wait, with the few rows of its key or in the store; the number of the next run, the rows in the store, and the few rows."""
        if len(run) <= FEW and len(both := unpacked(few) + run) <= FEW:
            return number, stock, pickle.dumps(sorted(both, key=in_order))
        size = max(1, len(run) // CUTS)
        for part, begin in enumerate(range(0, len(run), size)):
            self.waiting.updateValue((run[begin][0], number, part), (pickle.dumps(run[begin : begin + size]),))
        return number + 1, stock + len(run), few

    def wake(self, timer: int | None, waiting: tuple[int, int, bytes | None], held: tuple | None, at: int | None) -> None:
        """Set the key's timer to ``at``, unless it rings before; milliseconds, never before the time itself."""
        new = -(-at // 1000) if at is not None else None
        if new is not None and (timer is None or new < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new)
            timer = new
        self.known.update((timer, *waiting, held))

    def taken(self, places: list[tuple]) -> Iterator[tuple]:
        """The rows of a run's entries, which wait no longer."""
        for place in places:
            rows = pickle.loads(self.waiting.getValue(place)[0])
            self.waiting.removeKey(place)
            yield from rows

    def taken_at_once(self, entries: dict[tuple, bytes], begun: dict[int, list[tuple]]) -> list[Iterator[tuple]]:
        """The same of all runs that have begun, whose entries are read."""
        places = list(chain.from_iterable(begun.values()))
        if len(places) == len(entries) > 0:
            self.waiting.clear()
        else:
            for place in places:
                self.waiting.removeKey(place)
        return [chain.from_iterable(pickle.loads(entries[place]) for place in run) for run in begun.values()]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        _, runs, stock, few, held = self.known.get() or (None, 0, 0, None, None)
        state = tuple(held) if held is not None else None
        begun: dict[int, list[tuple]] = {}
        following: list[int] = []  # times
        at_once = stock <= AT_ONCE
        if not at_once:
            entries = dict.fromkeys(tuple(place) for place in self.waiting.keys())
        else:
            entries = {tuple(place): value[0] for place, value in self.waiting.iterator()} if stock else {}
        for place in sorted(entries, key=lambda place: place[1:]):
            if place[0] > now:
                following.append(place[0])
            else:
                begun.setdefault(place[1], []).append(place)
        left: list[tuple] = []
        first = unpacked(few)
        stock += len(first)
        for row in heapq.merge(first, *(self.taken_at_once(entries, begun) if at_once else map(self.taken, begun.values())), key=in_order):
            stock -= 1
            if row[0] > now:
                left.append(row)
                continue
            state, found = self.fold.advance(state, row[0], row[1:])
            for x in found:
                yield self.made(key[0], *x)
        few = None
        if not following:  # no run is left in the store
            runs = 0
        if left:
            following.append(left[0][0])
            runs, stock, few = self.wait(left, runs, stock, few)
        due = self.fold.due(state) if state is not None else None
        if due is not None and due <= now:
            for x in self.fold.expire(state):
                yield self.made(key[0], *x)
            state, due = None, None
        if due is not None:
            following.append(due)
        if state is None and not following:
            self.known.clear()
        else:
            self.wake(None, (runs, stock, few), stored(state), min(following, default=None))

    def close(self) -> None:
        pass


def live(stream: DataFrame, key: str, at: str, payload: list[Column], fold: Fold, late: str = "5 minutes") -> DataFrame:
    """``fold`` over a stream: key and results, each once the watermark has passed what it depends on."""
    stream.sparkSession.conf.set(*STORE)  # the only store with timers and several states
    ready = shaped(stream.withColumn("_at", F.col(at).cast("timestamp")), key, at, [*payload, F.col("_at")]).withWatermark("_at", late)
    schema = StructType.fromDDL(f"key string, {fold.result}")
    return timed(ready.groupBy("key").transformWithState(InOrder(fold), schema, "Append", "EventTime"))


def to_end(out: DataFrame, name: str) -> DataFrame:
    """A stream run until its sources are read, written as files and read back."""
    spark: SparkSession = out.sparkSession
    folder = own_folder(spark, name)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
