"""SQLite stores of coding tools as Spark data sources (SRC-1, 4, 7, 9, 12, 13).

``spark.dataSource.register(KeyValueStore)`` and ``SqliteTable``; then ``spark.read.format("sqlite_kv").option("path", file).load()``
or ``spark.read.format("sqlite_table").schema(ddl).option("path", file).option("table", name).load()``. A file is
read in ranges of row ids, a partition each. With ``spark.sql.python.filterPushdown.enabled`` comparisons of
columns reach SQLite, which answers them by its indexes; a prefix is a range of keys, never a pattern.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS = 100_000


def prefix_end(prefix: str) -> str:
    """The least string after all that begin with ``prefix``."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


@dataclass
class Rows(InputPartition):
    """Rows of a file with ids above ``low`` up to ``high``, or all."""

    path: str
    low: int | None = None
    high: int | None = None

    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        self.path, self.low, self.high = path, low, high


@dataclass
class Condition:
    """A WHERE clause that grows."""

    terms: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)

    def add(self, term: str, *values: object) -> None:
        self.terms.append(term)
        self.values.extend(values)

    def take(self, column: str, test: Filter) -> bool:
        """Add a comparison of one column with constants; False if it is none."""
        values = test.value if isinstance(test, In) else [getattr(test, "value", 0)]
        if not all(isinstance(v, (str, int, float)) and not isinstance(v, bool) for v in values):
            return False
        if type(test) in COMPARISONS:
            self.add(f"{column} {COMPARISONS[type(test)]} ?", test.value)
        elif isinstance(test, In):
            self.add(f"{column} IN ({', '.join('?' * len(values))})", *values)
        elif isinstance(test, StringStartsWith) and test.value:
            self.add(f"{column} >= ? AND {column} < ?", test.value, prefix_end(test.value))
        elif isinstance(test, (IsNull, IsNotNull)):
            self.add(f"{column} IS {'NOT ' if isinstance(test, IsNotNull) else ''}NULL")
        else:
            return False
        return True

    def __str__(self) -> str:
        return f" WHERE {' AND '.join(self.terms)}" if self.terms else ""


def identifier(name: str) -> str:
    if not name.isidentifier():
        raise ValueError(f"not a name: {name}")
    return f'"{name}"'


class SqliteReader(DataSourceReader):
    """``columns``: result columns by what SQLite calls them; None is the file's name."""

    def __init__(self, options: dict[str, str], table: str, columns: dict[str, str | None], shown: dict[str, str]):
        self.paths, self.table, self.columns, self.shown = options["path"].split(","), identifier(table), columns, shown
        self.size, self.where = int(options.get("rows_per_partition", ROWS)), Condition()

    def _open(self, path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        found = []
        for path in self.paths:
            with self._open(path) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}{self.where}", self.where.values).fetchone()
                except sqlite3.OperationalError as error:
                    if "rowid" not in str(error):
                        raise
                    found.append(Rows(path))  # a table without row ids
                    continue
            if low is not None:
                found += [Rows(path, i, min(i + self.size, high)) for i in range(low - 1, high, self.size)]
        return found

    def statement(self, partition: Rows) -> tuple[str, list]:
        """The query of a partition and its values."""
        where = Condition(list(self.where.terms), list(self.where.values))
        if partition.high is not None:
            where.add("rowid > ? AND rowid <= ?", partition.low, partition.high)
        names = [self.shown.get(n, c) for n, c in self.columns.items() if c is not None]
        return f"SELECT {', '.join(names)} FROM {self.table}{where}", where.values

    def read(self, partition: Rows) -> Iterator[tuple]:
        with self._open(partition.path) as db:
            for row in db.execute(*self.statement(partition)):
                own = iter(row)
                yield tuple(partition.path if c is None else next(own) for c in self.columns.values())


class PushingReader(SqliteReader):
    """Hands comparisons of single columns on to SQLite; Spark refuses it unless push-down is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            name = test.attribute[0] if len(getattr(test, "attribute", ())) == 1 else None
            column = self.columns.get(name) if name else None
            if column is None or not self.where.take(column, test):
                yield test


def reader_for(options: dict[str, str]) -> type[SqliteReader]:
    return PushingReader if options.get("pushdown", "false") == "true" else SqliteReader


class KeyValueStore(DataSource):
    """Options: path (comma-separated files), table, prefix (one key range), after (only rows beyond an id), rows_per_partition, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "file string, row_id bigint, key string, value string"

    def reader(self, schema) -> SqliteReader:
        options = dict(self.options)
        found = reader_for(options)(options, options.get("table", "kv"), {"file": None, "row_id": "rowid", "key": "key", "value": "value"}, {"value": "CAST(value AS TEXT)"})
        if prefix := options.get("prefix"):
            found.where.add("key >= ? AND key < ?", prefix, prefix_end(prefix))
        if after := int(options.get("after", "0")):
            found.where.add("rowid > ?", after)
        return found


class SqliteTable(DataSource):
    """Columns of a table, those of the given schema; options: path (comma-separated files), table, rows_per_partition, pushdown. Text is read as text, whatever it is stored as."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give the columns to read by .schema(...)")

    def reader(self, schema: StructType) -> SqliteReader:
        options = dict(self.options)
        columns = {f.name: identifier(f.name) for f in schema}
        shown = {f.name: f"CAST({identifier(f.name)} AS TEXT)" for f in schema if f.dataType.simpleString() == "string"}
        return reader_for(options)(options, options["table"], columns, shown)
