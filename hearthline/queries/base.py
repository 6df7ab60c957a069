"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A named query and, where SQL can express it, its DuckDB counterpart."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated callable(spark, sf_dir) under ``name``."""

    def register(run):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Query(run, sql)
        return run

    return register
