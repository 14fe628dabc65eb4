"""Queries: operators bound to tables, with DuckDB equivalents."""

from . import aggregates, analysis, behaviour, incremental, ingesting, live_streams, reads, relational, scoring, slices, streams

MODULES = (aggregates, relational, slices, behaviour, scoring, analysis, streams, live_streams, ingesting, reads, incremental)
