"""Tables that are built once and read by many queries: daily summary, daily capabilities, attribution, report (MAT-1 to 4).

A table is built anew when the files below it are others than at its last build; two readers at once wait for one build.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame

from pulsegrid.shared import own_folder

from .bindings import Lake

_guard = Lock()
_locks: dict[tuple, Lock] = {}
_built: dict[tuple, tuple] = {}  # by application, folder and name: what it was built from, where it is, its schema


def state(t: Lake, sources: tuple[str, ...]) -> str:
    """What tells one state of the source tables from another: paths, sizes and times of their top folders or files."""
    spark, found = t.spark, []
    for name in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.listStatus(path)
        found.append(f"{name} {[(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in status]}")
    return "\n".join(found)


def built(t: Lake, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame], order: str | None = None) -> DataFrame:
    """The table ``name`` over the lake, built now if it is not there or its sources have changed.

    With ``order`` the files are cut and sorted by that column, so that readers of a range skip the others.
    """
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    with _guard:
        lock = _locks.setdefault(key, Lock())
    with lock:
        now = state(t, sources)
        if key not in _built or _built[key][0] != now:
            rows, path = build(), own_folder(t.spark, name)
            (rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows).write.parquet(path)
            _built[key] = (now, path, rows.schema)
        _, path, schema = _built[key]
        return t.spark.read.schema(schema).parquet(path)
