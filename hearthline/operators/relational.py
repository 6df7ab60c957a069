"""Relational steps with the guarantees a pandas caller gets from ``validate=``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hearthline.session import scratch_dir


class KeyNotUnique(ValueError):
    """A join side that must have unique keys has duplicates."""


def require_unique(df: DataFrame, key: list[str], name: str = "table") -> DataFrame:
    """The table itself, or an error that names a repeated key (AGG23, LIM01): one aggregation, one row comes back."""
    bad = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise KeyNotUnique(f"{name} has {bad[0]['n']} rows with {', '.join(f'{k}={bad[0][k]!r}' for k in key)}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose both sides must have unique keys (JOIN01, JOIN03, JOIN07)."""
    return require_unique(left, key, "left").join(require_unique(right, key, "right"), key, how)


def join_lookup(facts: DataFrame, dimension: DataFrame, key: list[str], must_match: bool = True) -> DataFrame:
    """Left join to a dimension with unique keys (JOIN04, JOIN11, JOIN17, PRJ08); unmatched facts are an error if asked."""
    out = facts.join(require_unique(dimension, key, "dimension").withColumn("__found", F.lit(True)), key, "left")
    if must_match and out.where("__found is null").limit(1).count():
        raise ValueError("facts without a match in the dimension")
    return out.drop("__found")


def join_with_indicator(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join with a merge column both, left_only or right_only (JOIN05)."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return both.withColumn("merge", side).drop("__l", "__r")


#: Up to so many ranges are broadcast as sorted arrays.
BROADCAST_RANGES = 1_000_000


def range_lookup(values: DataFrame, value: str, ranges: DataFrame, upper: str, payload: str) -> DataFrame:
    """The payload of the first range whose upper bound is at least the value (JOIN10); null beyond the last, or for a null value.

    Ranges are counted first. Up to ``BROADCAST_RANGES`` of them go to the executors as sorted arrays
    and each batch of values is one binary search. More are cut into spans by a window and met by a
    join on the inequality, in which Spark compares every value with every span.
    """
    bounds = ranges.where(F.col(upper).isNotNull()).select(F.col(upper).cast("double").alias("__hi"), F.col(payload).alias("__payload"))
    bounds = bounds.groupBy("__hi").agg(F.min("__payload").alias("__payload"))
    if bounds.count() > BROADCAST_RANGES:
        spans = bounds.select(F.lag("__hi").over(Window.orderBy("__hi")).alias("__lo"), "__hi", "__payload")
        inside = (F.col("__lo").isNull() | (F.col(value) > F.col("__lo"))) & (F.col(value) <= F.col("__hi"))
        return values.join(spans, inside, "left").drop("__lo", "__hi").withColumnRenamed("__payload", payload)
    table = bounds.toArrow().sort_by("__hi")
    shared = values.sparkSession.sparkContext.broadcast((table["__hi"].to_numpy(), table["__payload"].combine_chunks()))
    kept = values.select("*", F.col(value).cast("double").alias("__at"))

    def find(batches):
        highs, payloads = shared.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            spot = np.searchsorted(highs, at)
            found = payloads.take(pa.array(spot, mask=np.isnan(at) | (spot >= len(highs))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], payload])

    return kept.mapInArrow(find, StructType([*values.schema.fields, StructField(payload, ranges.schema[payload].dataType)]))


def override(base: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Base rows with the authoritative values of ``changes`` where their key has some (JOIN18), and whether they changed."""
    new = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = base.join(new, key, "left")
    moved = reduce(lambda a, b: a | b, [F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)) for c in columns])
    both = both.withColumn("changed", moved)
    for c in columns:
        both = both.withColumn(c, F.coalesce(f"__{c}", c))
    return both.drop(*[f"__{c}" for c in columns])


def replace_partition(old: DataFrame, new: DataFrame, which: Column) -> DataFrame:
    """Old rows outside the predicate and all new rows (SET03)."""
    return old.where(~which).unionByName(new, allowMissingColumns=True)


def union_widened(*frames: DataFrame) -> DataFrame:
    """Union by name over the ordered union of all columns (SET01, SET02, SNK02)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows of one frame that the other lacks, with multiplicity (SET05, SET06, SET07, QC09)."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)  # one row each


def close(a: Column, b: Column, absolute: float = 5e-10, relative: float = 0.0) -> Column:
    """Equal within an absolute or relative tolerance, nulls equal to nulls (SCL20, SET08)."""
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def missing_keys(have: DataFrame, dimensions: list[DataFrame]) -> DataFrame:
    """Combinations of the dimensions that a table lacks (SET09). Dimensions are small sets of labels."""
    want = reduce(lambda a, b: a.crossJoin(b), dimensions)
    return want.join(have.select(*want.columns).distinct(), want.columns, "left_anti")


def first_by(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key by an order (WIN01, WIN06, ORD04)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def top_by(df: DataFrame, key: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key, with their rank (WIN05)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def running_group(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number of the group a row belongs to when rows are grouped by key in key order, from 0 (WIN02).

    Keys are dealt to ranges and numbered within each; what earlier ranges hold, one number per range,
    is added. No task sees all keys.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    keys = keys.select(key, F.monotonically_increasing_id().alias("__n")).checkpoint()
    part, place = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    sizes = keys.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    offsets = sizes.select("__part", before.alias("__before"))
    numbered = keys.select(key, part.alias("__part"), place.alias("__place")).join(F.broadcast(offsets), "__part")
    return df.join(numbered.select(key, (F.col("__before") + F.col("__place")).alias("group_id")), key)


def custom_rank(column: Column, order: list[str]) -> Column:
    """Sort key for a fixed order of labels; others come last (ORD02)."""
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(column == name, k).otherwise(out)
    return out


def totals_row(df: DataFrame, by: list[str], over: str, measures: list[str], label: str) -> DataFrame:
    """Rows of ``df`` summed by (by, over) and a labelled total over ``over`` (AGG16): one grouping-sets pass."""
    rolled = df.groupingSets([[*by, over], by], *by, over).agg(*[F.sum(m).alias(m) for m in measures], F.grouping(over).alias("__all"))
    return rolled.withColumn(over, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(over))).drop("__all")


def in_two_panels(df: DataFrame, first: tuple[str, Column], second: tuple[str, Column]) -> DataFrame:
    """Rows once per panel whose predicate holds, the panel's name first (SET04, PRJ04, PRJ05)."""
    part = lambda name, keep: df.where(keep).select(F.lit(name).alias("analysis_panel"), "*")
    return part(*first).unionByName(part(*second))
