"""All registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exported, flow, language, matching, parties, searching, words

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (matching, searching, words, parties, language, flow, exported)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
