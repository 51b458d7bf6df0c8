"""Registry of named queries, each with the SQL it must agree with (if SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a builder under a name; ``covers`` lists the inventory ids it shows."""

    def register(build: Build) -> Build:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(build, sql, tuple(covers.split()))
        return build

    return register


def load_all() -> dict[str, Entry]:
    from caselog.plans import (encode_queries, encoder_queries, event_queries, metric_queries, model_check_queries, model_queries, monitor_queries, row_queries, source_queries,  # noqa: F401
                               split_queries, stream_queries, text_queries, tune_queries)

    return ENTRIES
