"""Dasymetric population: shares of structures per class, full, zone-direct and incremental."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("n0", "n1", "n2")


def class_counts(points: DataFrame, zone: str, cls: str = "cls", weight: str | None = None) -> DataFrame:
    """(zone, n0, n1, n2) structures per class (POP02, AGG11)."""
    one = F.col(weight) if weight else F.lit(1)
    per = [F.coalesce(F.sum(F.when(F.col(cls) == k, one)), F.lit(0)).cast("long").alias(f"n{k}") for k in range(3)]
    return points.groupBy(zone).agg(*per)


def allocate(population: DataFrame, counts: DataFrame, zone: str, pop: str = "pop", residual_by: str | None = None) -> DataFrame:
    """Adds nonwui_pop, intermix_pop, interface_pop: population times each class's share of structures (POP01).

    Zones without structures are Non-WUI whole. What rounding leaves open over all zones goes to the
    lowest zone (of each ``residual_by``), so totals are conserved (AGG11: zones without points count zero).
    """
    both = population.join(counts, zone, "left").na.fill(0, list(CLASSES))
    total = F.col("n0") + F.col("n1") + F.col("n2")
    share = lambda k: F.when(total > 0, F.col(pop) * F.col(f"n{k}") / total).otherwise(F.lit(0.0))
    both = both.withColumn("intermix_pop", share(1).cast("double")).withColumn("interface_pop", share(2).cast("double"))
    both = both.withColumn("nonwui_pop", F.when(total > 0, F.col(pop) * F.col("n0") / total).otherwise(F.col(pop)).cast("double"))
    keys = [residual_by] if residual_by else []
    sums = both.groupBy(*keys).agg(
        F.sum(F.col(pop).cast("double")).alias("__pop"), F.sum("nonwui_pop").alias("__a"), F.sum("intermix_pop").alias("__b"), F.sum("interface_pop").alias("__c"), F.min(zone).alias("__first")
    )
    joined = both.join(sums, keys) if keys else both.crossJoin(F.broadcast(sums))  # one row of totals
    rest = F.col("__pop") - F.col("__a") - F.col("__b") - F.col("__c")
    joined = joined.withColumn("nonwui_pop", F.col("nonwui_pop") + F.when(F.col(zone) == F.col("__first"), rest).otherwise(0.0))
    return joined.select(*both.columns)


def zone_direct(classes: DataFrame, population: DataFrame, zone: str, pop: str = "pop") -> DataFrame:
    """Population and zones per class by an exact one-to-one outer join (POP04, JOIN05): unmatched zones are reported, not lost."""
    a = classes.select(zone, "cls", F.lit(True).alias("__l"))
    b = population.select(zone, pop, F.lit(True).alias("__r"))
    both = a.join(b, zone, "full")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return both.withColumn("merge", side).groupBy("merge", "cls").agg(F.count("*").alias("zones"), F.sum(pop).cast("long").alias("population"))


def delta_counts(baseline: DataFrame, points: DataFrame, changed: DataFrame, zone: str) -> DataFrame:
    """Baseline class counts moved by the points in changed cells only (POP03, INC04, JOIN09, O8, O9).

    ``changed`` has (r, c, a, b), the old and new class; only points in those cells are touched.
    """
    moved = points.join(changed.select("r", "c", "a", "b"), ["r", "c"])
    gain = moved.select(zone, F.col("b").alias("cls"), F.lit(1).alias("d"))
    loss = moved.select(zone, F.col("a").alias("cls"), F.lit(-1).alias("d"))
    delta = gain.unionByName(loss).groupBy(zone).agg(*[F.coalesce(F.sum(F.when(F.col("cls") == k, F.col("d"))), F.lit(0)).alias(f"d{k}") for k in range(3)])
    both = baseline.join(delta, zone, "full").na.fill(0)
    return both.select(zone, *[(F.col(f"n{k}") + F.col(f"d{k}")).cast("long").alias(f"n{k}") for k in range(3)])


def closure(detail: DataFrame, official: Column, pop: str = "pop") -> DataFrame:
    """Whether class populations add up to the official total (POP05, QC07)."""
    parts = F.col("nonwui_pop") + F.col("intermix_pop") + F.col("interface_pop")
    out = detail.agg(F.sum(F.col(pop).cast("double")).alias("official"), F.sum(parts).alias("allocated"), F.count_if(parts < 0).alias("negative"))
    return out.withColumn("closed", (F.abs(F.col("official") - F.col("allocated")) <= 1e-6) & (F.col("negative") == 0))


def lowest_first(zone: str, by: str | None = None) -> Column:
    """Marks the zone that takes the residual."""
    window = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return F.row_number().over(window.orderBy(zone)) == 1
