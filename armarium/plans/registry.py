"""Names, queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; sql is what DuckDB is to say too."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The last path component and the title, in SQL.
NAME = r"regexp_extract(path, '([^/\\]*)$', 1)"
TITLE = rf"regexp_replace({NAME}, '\.txt$', '')"
