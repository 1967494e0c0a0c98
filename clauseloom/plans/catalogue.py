"""The registered queries and their SQL counterparts, gathered from the themed modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, language, notices, relational, state

Query = Callable[[SparkSession, str], DataFrame]
_THEMES = (documents, language, notices, relational, state)


def queries() -> dict[str, Query]:
    return {name: q for theme in _THEMES for name, q in theme.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for theme in _THEMES for name, sql in theme.ORACLES.items()}
