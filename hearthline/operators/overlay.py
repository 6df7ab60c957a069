"""Comparing rasters cell by cell: pair counters, Jaccard, transitions, changed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.params import NODATA, PIXEL_KM2


def _valid(c: Column) -> Column:
    return c.isin(0, 1, 2)


def overlay(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("r", "c"), names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both rasters' classes per cell (JOIN13); a missing cell is NoData."""
    left = a.select(*keys, F.col("cls").alias(names[0]))
    right = b.select(*keys, F.col("cls").alias(names[1]))
    both = left.join(right, list(keys), "full")
    return both.select(*keys, *[F.coalesce(n, F.lit(NODATA)).alias(n) for n in names])


def pair_counts(cells: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """The eleven counters of two class columns in one pass (GRD33)."""
    x, y = F.col(a), F.col(b)
    vx, vy = _valid(x), _valid(y)
    wx, wy = x.isin(1, 2), y.isin(1, 2)
    count = F.count_if
    return cells.groupBy(*by).agg(
        count(wx & wy).alias("both_wui"),
        count(vx & vy & wx & ~wy).alias("a_only"),
        count(vx & vy & wy & ~wx).alias("b_only"),
        count(vx & vy & ~wx & ~wy).alias("both_non_wui"),
        count(vx & vy).alias("common_valid"),
        count(~vx & vy).alias("excluded_a_nodata"),
        count(vx & ~vy).alias("excluded_b_nodata"),
        count(~vx & ~vy).alias("excluded_both_nodata"),
        count(F.lit(True)).alias("full_grid"),
        count(vx & vy & wx).alias("a_wui_common"),
        count(vx & vy & wy).alias("b_wui_common"),
    )


def finalise_pairs(counts: DataFrame, empty_union: float | None = None) -> DataFrame:
    """Union, Jaccard, agreement, areas and conservation flags (GRD34, GRD35, QC03, QC04).

    ``empty_union`` is the Jaccard of two empty sets: null unless a caller defines it.
    """
    union = F.col("a_wui_common") + F.col("b_wui_common") - F.col("both_wui")
    jaccard = F.when(union > 0, F.col("both_wui") / union).otherwise(F.lit(empty_union).cast("double"))
    agreement = F.try_divide(F.col("both_wui") + F.col("both_non_wui"), F.col("common_valid"))
    excluded = F.col("excluded_a_nodata") + F.col("excluded_b_nodata") + F.col("excluded_both_nodata")
    return counts.select(
        "*",
        union.alias("union_pix"),
        F.round(jaccard, 12).alias("jaccard"),
        F.round(agreement, 12).alias("agreement"),
        F.round(F.col("both_wui") * PIXEL_KM2, 6).alias("intersection_km2"),
        F.round(union * PIXEL_KM2, 6).alias("union_km2"),
        (F.col("common_valid") + excluded == F.col("full_grid")).alias("grid_closed"),
        (union == F.col("both_wui") + F.col("a_only") + F.col("b_only")).alias("union_closed"),
        (F.col("common_valid") == union + F.col("both_non_wui")).alias("domain_closed"),
    )


def micro_jaccard(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Ratio of sums, never mean of ratios (AGG04)."""
    total = pairs.groupBy(*by).agg(F.sum("both_wui").alias("both_wui"), F.sum("union_pix").alias("union_pix"), F.count("*").alias("units"))
    return total.withColumn("micro_jaccard", F.round(F.try_divide("both_wui", "union_pix"), 12))


def macro_jaccard(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Unweighted mean over units with its range (AGG03, AGG05, AGG06)."""
    return pairs.groupBy(*by).agg(
        F.round(F.avg("jaccard"), 12).alias("macro_jaccard"), F.round(F.min("jaccard"), 12).alias("least"), F.round(F.max("jaccard"), 12).alias("most"),
        F.round(F.max("jaccard") - F.min("jaccard"), 12).alias("spread"),
    )


def transitions(cells: DataFrame, old: str = "a", new: str = "b") -> DataFrame:
    """Pixels per (old, new) class pair on the common domain (GRD32, AGG24)."""
    both = cells.where(_valid(F.col(old)) & _valid(F.col(new)))
    return both.groupBy(F.col(old).alias("old_cls"), F.col(new).alias("new_cls")).agg(F.count("*").alias("pixels"))


def changed_cells(cells: DataFrame, old: str = "a", new: str = "b") -> DataFrame:
    """Cells whose class changes on the common domain (GRD29, GRD30)."""
    return cells.where(_valid(F.col(old)) & _valid(F.col(new)) & (F.col(old) != F.col(new)))


def changed_at(cells: DataFrame, occupied: DataFrame, old: str = "a", new: str = "b") -> DataFrame:
    """Changed cells that hold structures, with their number (GRD31)."""
    return changed_cells(occupied.join(cells, ["r", "c"]), old, new)


def forbidden_transitions(cells: DataFrame, allowed: list[tuple[int, int]], old: str = "a", new: str = "b") -> DataFrame:
    """Transitions outside the allowed pairs; empty when the gate passes (QC08)."""
    moves = transitions(changed_cells(cells, old, new), old, new)
    ok = F.lit(False)
    for x, y in allowed:
        ok = ok | ((F.col("old_cls") == x) & (F.col("new_cls") == y))
    return moves.where(~ok)


def impact(cells: DataFrame, old: str = "a", new: str = "b") -> DataFrame:
    """Loss, gain, intersection and union of WUI between two versions; equal empties count as 1 (GRD36)."""
    x, y = F.col(old).isin(1, 2), F.col(new).isin(1, 2)
    counts = cells.agg(
        F.count_if(x & ~y).alias("lost"), F.count_if(y & ~x).alias("gained"), F.count_if(x & y).alias("kept"),
        F.count_if(x | y).alias("either"), F.count_if(F.col(old) != F.col(new)).alias("changed"),
    )
    return counts.withColumn("jaccard", F.when(F.col("either") == 0, F.lit(1.0)).otherwise(F.round(F.col("kept") / F.col("either"), 12)))


def zonal_metrics(cells: DataFrame, zone: str, structures: str = "n", with_structures: bool = True) -> DataFrame:
    """Pixels and structures per class in each zone, with the area and structure shares (GRD27, JOIN11, CTY01, PRJ07).

    Shares are null where their denominator is zero; without structures p_s is null by definition.
    """
    per = lambda k: F.count_if(F.col("cls") == k)
    inside = lambda k: F.coalesce(F.sum(F.when(F.col("cls") == k, F.col(structures))), F.lit(0)).cast("long")
    out = cells.groupBy(zone).agg(
        F.count("*").alias("land_pix"), per(1).alias("intermix_pix"), per(2).alias("interface_pix"),
        F.coalesce(F.sum(structures), F.lit(0)).cast("long").alias("total_struct"), inside(1).alias("intermix_struct"), inside(2).alias("interface_struct"),
    )
    p_a = F.try_divide(F.col("intermix_pix") + F.col("interface_pix"), F.col("land_pix"))
    p_s = F.try_divide(F.col("intermix_struct") + F.col("interface_struct"), F.col("total_struct")) if with_structures else F.lit(None).cast("double")
    return out.withColumn("p_a", F.round(p_a, 12)).withColumn("p_s", F.round(p_s, 12))


def structures_by_class(cells: DataFrame, structures: str = "n") -> DataFrame:
    """Structures per class including NoData (GRD28), and whether they add up (QC06)."""
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("cls") == k, F.col(structures))), F.lit(0)).cast("long")
    out = cells.agg(F.sum(structures).cast("long").alias("total_struct"), pick(0).alias("nonwui_struct"), pick(1).alias("intermix_struct"), pick(2).alias("interface_struct"), pick(NODATA).alias("nodata_struct"))
    closed = F.col("total_struct") == F.col("nonwui_struct") + F.col("intermix_struct") + F.col("interface_struct") + F.col("nodata_struct")
    return out.withColumn("closed", closed)
