"""All registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkshelf.plans import q_aggregates, q_functions, q_joins, q_lifecycle, q_listing, q_more, q_scoring, q_sources, q_windows

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [q_listing, q_windows, q_aggregates, q_joins, q_scoring, q_functions, q_lifecycle, q_sources, q_more]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in MODULES:
        if both := found.keys() & m.q.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        found.update(m.q.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found.update(m.q.ORACLE)
    return found
