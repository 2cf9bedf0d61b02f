"""Queries over the driver's tables and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import legal_queries, sql_legal, sql_text, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.queries() | legal_queries.queries()


def oracle_sql() -> dict[str, str]:
    return sql_text.twins() | sql_legal.twins()
