"""Report panels: appendix tables, division means and sensitivity series as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators import relational as R

MEASURES = ("nonwui_km2", "intermix_km2", "interface_km2", "wui_km2")


def share_panel(area: DataFrame, by: str = "method") -> DataFrame:
    """Mean area and micro share by method (FIG4, AGG03, AGG04)."""
    return area.groupBy(by).agg(F.avg("wui_km2").alias("mean_wui_km2"), (F.sum("wui_km2") * 100.0 / F.sum("valid_km2")).alias("wui_share_pct"), F.count("*").alias("units"))


def division_means(area: DataFrame, divisions: DataFrame) -> DataFrame:
    """Means per division; a state without one is an error (FIG5, PRJ08)."""
    return R.join_lookup(area, divisions, ["state"]).groupBy("division", "method").agg(*[F.avg(m).alias(m) for m in MEASURES])


def sensitivity_series(by_radius: DataFrame, fixed: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Radius series with the fixed-boundary method repeated at each radius (FIG7, FIG8, PRJ10)."""
    spread = fixed.withColumn("radius_m", F.explode(F.array(*[F.lit(r) for r in radii])))
    return by_radius.unionByName(spread.select(*by_radius.columns))


def appendix(national: DataFrame, design: DataFrame, measures: list[str], by: list[str]) -> DataFrame:
    """National and full-design rows as two panels, each with a total (A1 to A6, SET04, AGG16)."""
    both = R.union_widened(national.withColumn("analysis_panel", F.lit("national")), design.withColumn("analysis_panel", F.lit("design")))
    return R.totals_row(both, ["analysis_panel", *by], "state", measures, "CONUS")


def state_method_matrix(rows: DataFrame, methods: list[str], value: str) -> DataFrame:
    """States down, methods across, sorted by the first method (PIV01, PIV05, ORD04)."""
    wide = rows.groupBy("state").pivot("method", methods).agg(F.first(value))
    return wide.orderBy(F.desc(methods[0]))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
