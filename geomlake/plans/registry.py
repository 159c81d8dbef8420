"""Registration of queries together with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Operators of the survey that a query exercises.
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; without sql tests hold it, or the kernel that does its work, against a plain version."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = tuple(covers.split())
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register
