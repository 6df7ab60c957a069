"""Record identity, duplicates and point-source policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds n_group and is_kept: the first row of each key by a total order is kept (WIN01, WIN03, DUP-D1, O22).

    Nulls are equal to each other in a key, unlike in a join.
    """
    by = Window.partitionBy(*key)
    return rows.withColumn("n_group", F.count("*").over(by)).withColumn("is_kept", F.row_number().over(by.orderBy(*order)) == 1)


def duplicate_summary(rows: DataFrame, key: list[str], source: str | None = None) -> DataFrame:
    """Records, groups, repeated groups, extra records, and those that cross sources (DUP-X, AGG13): pre-aggregated by key."""
    aggregates = [F.count("*").alias("n")]
    if source:
        aggregates += [F.min(source).alias("lo"), F.max(source).alias("hi")]
    groups = rows.groupBy(*key).agg(*aggregates)
    cross = (F.col("lo") != F.col("hi")) if source else F.lit(False)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(
        total(F.col("n")).alias("records"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("repeated_groups"),
        total(F.col("n") - 1).alias("extra_records"), F.count_if((F.col("n") > 1) & cross).alias("cross_groups"),
        total(F.when(cross, F.col("n") - 1)).alias("cross_extra"),
    )


def sufficient_duplicates(rows: DataFrame, key: list[str], sufficient: str, source: str) -> DataFrame:
    """Groups of a normalised identity and coordinate that are all sufficient and come from several sources (DUP-D3)."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and(sufficient).alias("all_sufficient"), F.min(source).alias("lo"), F.max(source).alias("hi"))
    return groups.where("all_sufficient and n > 1 and lo <> hi")


def shared_coordinates(rows: DataFrame, coordinate: list[str], identity: str, sufficient: str) -> DataFrame:
    """Per repeated coordinate: records, different sufficient identities (DUP-D4), insufficient records (DUP-D5)."""
    groups = rows.groupBy(*coordinate).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col(sufficient), F.col(identity))).alias("identities"), F.count_if(~F.col(sufficient)).alias("insufficient")
    )
    return groups.where("n > 1")


def crowded_cells(rows: DataFrame, cell: list[str], coordinate: list[str]) -> DataFrame:
    """Cells with two or more different coordinates (DUP-D6, WIN04)."""
    return rows.groupBy(*cell).agg(F.count("*").alias("n"), F.count_distinct(*coordinate).alias("coordinates")).where("coordinates >= 2")


def nearest_other(points: DataFrame, id_col: str, x: str, y: str, reach: float) -> DataFrame:
    """(id, nearest): distance to the nearest different coordinate within ``reach`` (VEC12, DUP-D7).

    Coordinates are bucketed to cells of ``reach``; a coordinate meets only its own and the eight
    cells around, so the work follows local density. Equal coordinates meet once, as one.
    """
    spots = points.groupBy(x, y).agg(F.count("*").alias("held")).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cell = lambda c: F.floor(F.col(c) / F.lit(reach))
    spots = spots.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = spots.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    around = around.select(F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    squared = F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2))
    met = spots.join(around, ["cx", "cy"]).withColumn("d2", squared).where((F.col("d2") > 0) & (F.col("d2") <= reach * reach))
    nearest = met.groupBy("x", "y").agg(F.sqrt(F.min("d2")).alias("nearest"))
    return points.join(nearest, [x, y] if (x, y) == ("x", "y") else (F.col(x) == nearest["x"]) & (F.col(y) == nearest["y"])).select(id_col, "nearest")


def availability(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Share of non-blank values of each field in percent (DUP-AV, SCL09)."""
    filled = [(F.count_if(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "")).alias(f) for f in fields]
    wide = rows.agg(F.count("*").alias("records"), *filled)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("x")
    return wide.select("records", cells).select("x.field", "x.filled", "records", F.round(F.col("x.filled") * 100 / F.col("records"), 6).alias("percent"))


def private_examples(groups: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """A few hashed example groups, largest first; the key itself is not shown (DUP-EX, WIN05)."""
    token = F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, 12)
    return groups.select(token.alias("token"), "n").orderBy(F.desc("n"), "token").limit(most)


def policy_flags(rows: DataFrame, exact: list[str], identity: list[str], coordinate: list[str], order: list[str]) -> DataFrame:
    """keep_p0..keep_p4: all, raw, first of exact duplicates, first of identities, first of coordinates (POL-P0..P4, POL-P)."""
    first = lambda key: F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    flagged = rows.withColumn("keep_p1", F.lit(True)).withColumn("keep_p2", first(exact))
    flagged = flagged.withColumn("keep_p3", F.col("keep_p2") & first(identity))
    return flagged.withColumn("keep_p4", first(coordinate))


def normalise_text(value: Column) -> Column:
    """Upper case, trimmed, inner white space collapsed (SCL07 without compatibility forms)."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))
