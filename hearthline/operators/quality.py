"""Quality gates as rows: name, passed, value, expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailed(AssertionError):
    """A gate table with a row that did not pass."""


def gate(df: DataFrame, name: str, value: Column, expected, tolerance: float = 0.0) -> DataFrame:
    """One gate row from one aggregate of a table (QC01 to QC16)."""
    row = df.agg(value.cast("double").alias("value"))
    passed = F.coalesce(F.abs(F.col("value") - F.lit(float(expected))) <= tolerance, F.lit(False))
    return row.select(F.lit(name).alias("gate"), passed.alias("passed"), "value", F.lit(float(expected)).alias("expected"))


def gate_table(*gates: DataFrame) -> DataFrame:
    """All gates as one table (QC14)."""
    return reduce(DataFrame.unionByName, gates)


def enforce(gates: DataFrame) -> DataFrame:
    """The gate table, or an error that names what failed; gates are few by nature."""
    failed = [r["gate"] for r in gates.where(~F.col("passed")).collect()]
    if failed:
        raise GateFailed(", ".join(sorted(failed)))
    return gates


def unique_key(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Gate: no key occurs twice (AGG23)."""
    return gate(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), name, F.count("*"), 0)


def count_gate(df: DataFrame, name: str, expected: int) -> DataFrame:
    """Gate: row count (QC01)."""
    return gate(df, name, F.count("*"), expected)


def closure_gate(df: DataFrame, name: str, total: str, parts: list[str], tolerance: float = 0.0) -> DataFrame:
    """Gate: parts add up to the total in every row (QC02, QC05, QC06, QC07); the value is the largest gap."""
    rest = F.abs(F.col(total) - reduce(lambda a, b: a + b, [F.col(p) for p in parts]))
    return gate(df, name, F.coalesce(F.max(rest), F.lit(0)), 0, tolerance)


def external_tolerance(ours: Column, theirs: Column, absolute: float, relative: float) -> Column:
    """Whether an area agrees with an external total (QC16)."""
    return F.abs(ours - theirs) <= F.greatest(F.lit(absolute), theirs * F.lit(relative))
