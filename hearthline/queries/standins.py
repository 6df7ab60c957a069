"""Grids, classes, blocks and graphs derived from the driver's tables, in Spark and as DuckDB fragments.

The tables hold no maps, so integer formulas place customers and orders on a 256 x 256 grid; both
engines evaluate the same formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import grid as G
from hearthline.params import Kernel
from hearthline.session import table

N = 256
POINTS = Kernel.of_cells(5, 3)
NEAR = Kernel.of_cells(8)
BLOCK = 16
DENSE_BLOCK = 7


def cells(spark: SparkSession) -> DataFrame:
    """Every cell of the grid."""
    ids = spark.range(N * N)
    return ids.select(F.floor(F.col("id") / N).cast("long").alias("r"), (F.col("id") % N).alias("c"))


def points_p(spark, d) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(((k * 37 + n * 5) % N).alias("r"), ((k * 11 + n * 29) % N).alias("c"), k.alias("id"), n.cast("long").alias("county"), "c_acctbal")


def points_s(spark, d) -> DataFrame:
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(((k * 37 + o * 5) % N).alias("r"), ((k * 11 + o * 29) % N).alias("c"), o.alias("id"))


def wild(spark) -> DataFrame:
    """Cells of wild land."""
    mask = ((F.floor(F.col("r") / 32) * 5 + F.floor(F.col("c") / 32) * 3) % 4) < 2
    return cells(spark).where(mask).withColumn("n", F.lit(1).cast("long"))


def runs(spark, d, points: DataFrame) -> DataFrame:
    layers = {"pts": (G.count_points(points), POINTS, "n"), "veg": (wild(spark), POINTS, "n"), "near": (wild(spark), NEAR, "n")}
    return G.focal_sums(layers, N, N)


def classes(spark, d, points: DataFrame) -> DataFrame:
    """(r, c, cls) over the whole grid by the circular rule."""
    classified = G.classify_circular(runs(spark, d, points), "pts", "veg", "near", POINTS, POINTS.cells)
    found = G.explode_runs(classified.where("cls > 0").select("r", "c0", "c1", "cls"))
    return cells(spark).join(found, ["r", "c"], "left").select("r", "c", F.coalesce("cls", F.lit(0)).alias("cls"))


def class_p(spark, d) -> DataFrame:
    return classes(spark, d, points_p(spark, d))


def class_s(spark, d) -> DataFrame:
    return classes(spark, d, points_s(spark, d))


def blocks(spark, d) -> DataFrame:
    """(blk, hu, veg, near, dense) of 16 x 16 blocks; vegetation can be exactly half."""
    blk = (F.floor(F.col("r") / BLOCK) * BLOCK + F.floor(F.col("c") / BLOCK)).cast("long")
    green = ((F.floor(F.col("r") / 8) * 5 + F.floor(F.col("c") / 32) * 3) % 4) < 2
    veg = cells(spark).groupBy(blk.alias("blk")).agg((F.count_if(green) * 100.0 / (BLOCK * BLOCK)).alias("veg"))
    hu = points_p(spark, d).groupBy(blk.alias("blk")).agg(F.count("*").alias("hu"))
    out = veg.join(hu, "blk", "left").withColumn("hu", F.coalesce("hu", F.lit(0)).cast("long"))
    br, bc = F.floor(F.col("blk") / BLOCK), F.col("blk") % BLOCK
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    patch = out.where("veg > 75").select(br.alias("pr"), bc.alias("pc")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    patch = patch.select(((F.col("pr") + F.col("dr")) * BLOCK + F.col("pc") + F.col("dc")).alias("blk"), (F.col("pc") + F.col("dc")).alias("pc")).where(f"pc between 0 and {BLOCK - 1}")
    patch = patch.select(F.col("blk").cast("long").alias("blk")).distinct().withColumn("near", F.lit(True))
    return out.join(patch, "blk", "left").withColumn("near", F.coalesce("near", F.lit(False))).withColumn("dense", F.col("hu") >= DENSE_BLOCK)


def zonal(spark, d, strict: bool = True) -> DataFrame:
    return G.classify_zonal(blocks(spark, d), "hu", "veg", "near", DENSE_BLOCK - 0.5, strict)


def class_z(spark, d, strict: bool = True) -> DataFrame:
    """(r, c, cls) of the zonal rule, burnt to cells."""
    blk = (F.floor(F.col("r") / BLOCK) * BLOCK + F.floor(F.col("c") / BLOCK)).cast("long")
    return cells(spark).withColumn("blk", blk).join(zonal(spark, d, strict).select("blk", "cls"), "blk").select("r", "c", "cls")


def units(spark, d) -> DataFrame:
    """(family, unit, y): a value per user and event type."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("family"), F.col("user_id").alias("unit"))
    return e.agg(F.sum(F.floor("value")).cast("double").alias("y"))


def edges(spark, d) -> DataFrame:
    """Queen adjacency of the users on a lattice fifteen wide."""
    from hearthline.operators.spatialstats import queen_edges

    lattice = units(spark, d).select("family", "unit", F.floor(F.col("unit") / 15).alias("r"), (F.col("unit") % 15).alias("c"))
    return queen_edges(lattice)


_OFFSETS = "(SELECT a.range AS dy, b.range AS dx FROM range(-{r}, {r} + 1) a, range(-{r}, {r} + 1) b WHERE a.range * a.range + b.range * b.range <= {r} * {r})"


def _class_sql(name: str, points: str) -> str:
    return f"""
{name}_n AS (SELECT r, c, count(*) AS n FROM {points} GROUP BY ALL),
{name}_d AS (SELECT p.r + o.dy AS r, p.c + o.dx AS c, sum(p.n) AS s FROM {name}_n p, {_OFFSETS.format(r=5)} o GROUP BY ALL),
{name} AS (
  SELECT g.r, g.c, CAST(CASE WHEN coalesce(d.s, 0) >= 3 AND 2 * coalesce(v.s, 0) > 81 THEN 1
                             WHEN coalesce(d.s, 0) >= 3 AND w.r IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS cls, coalesce(d.s, 0) AS s, coalesce(v.s, 0) AS veg
  FROM grid g LEFT JOIN {name}_d d USING (r, c) LEFT JOIN veg v USING (r, c) LEFT JOIN near w ON w.r = g.r AND w.c = g.c)"""


SQL = {
    "grid": f"grid AS (SELECT a.range AS r, b.range AS c FROM range({N}) a, range({N}) b)",
    "points_p": "points_p AS (SELECT (c_custkey * 37 + c_nationkey * 5) % 256 AS r, (c_custkey * 11 + c_nationkey * 29) % 256 AS c, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS county, c_acctbal FROM customer)",
    "points_s": "points_s AS (SELECT (o_custkey * 37 + o_orderkey * 5) % 256 AS r, (o_custkey * 11 + o_orderkey * 29) % 256 AS c, o_orderkey AS id FROM orders)",
    "wild": "wild AS (SELECT r, c FROM grid WHERE ((r // 32) * 5 + (c // 32) * 3) % 4 < 2)",
    "veg": f"veg AS (SELECT w.r + o.dy AS r, w.c + o.dx AS c, count(*) AS s FROM wild w, {_OFFSETS.format(r=5)} o GROUP BY ALL)",
    "near": f"near AS (SELECT DISTINCT w.r + o.dy AS r, w.c + o.dx AS c FROM wild w, {_OFFSETS.format(r=8)} o)",
    "class_p": _class_sql("class_p", "points_p").strip(),
    "class_s": _class_sql("class_s", "points_s").strip(),
    "blocks": """blocks AS (
  SELECT v.blk, v.veg, coalesce(h.hu, 0) AS hu, coalesce(h.hu, 0) >= 7 AS dense,
         EXISTS (SELECT 1 FROM (SELECT (r // 16) * 16 + c // 16 AS blk, count(*) FILTER (((r // 8) * 5 + (c // 32) * 3) % 4 < 2) * 100.0 / 256 AS veg FROM grid GROUP BY 1) q
                 WHERE q.veg > 75 AND abs(q.blk // 16 - v.blk // 16) <= 1 AND abs(q.blk % 16 - v.blk % 16) <= 1) AS near
  FROM (SELECT (r // 16) * 16 + c // 16 AS blk, CAST(count(*) FILTER (((r // 8) * 5 + (c // 32) * 3) % 4 < 2) AS DOUBLE) * 100.0 / 256 AS veg FROM grid GROUP BY 1) v
  LEFT JOIN (SELECT (r // 16) * 16 + c // 16 AS blk, count(*) AS hu FROM points_p GROUP BY 1) h USING (blk))""",
    "zonal": "zonal AS (SELECT *, CAST(CASE WHEN dense AND veg > 50 THEN 1 WHEN dense AND veg <= 50 AND near THEN 2 ELSE 0 END AS INTEGER) AS cls, CAST(CASE WHEN dense AND veg >= 50 THEN 1 WHEN dense AND veg < 50 AND near THEN 2 ELSE 0 END AS INTEGER) AS old FROM blocks)",
    "class_z": "class_z AS (SELECT r, c, cls, old FROM grid JOIN zonal ON blk = (r // 16) * 16 + c // 16)",
    "units": "units AS (SELECT event_type AS family, user_id AS unit, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS y FROM events GROUP BY ALL)",
    "edges": "edges AS (SELECT a.family, a.unit AS src, b.unit AS dst FROM units a JOIN units b ON a.family = b.family AND a.unit <> b.unit AND abs(a.unit // 15 - b.unit // 15) <= 1 AND abs(a.unit % 15 - b.unit % 15) <= 1)",
}

_NEEDS = {
    "wild": ["grid"], "veg": ["wild"], "near": ["wild"], "class_p": ["points_p", "veg", "near"], "class_s": ["points_s", "veg", "near"],
    "blocks": ["grid", "points_p"], "zonal": ["blocks"], "class_z": ["zonal"], "edges": ["units"],
}


def with_sql(names: str, body: str) -> str:
    """``WITH`` the named fragments and what they need, then ``body``; a body that starts with WITH goes on with its own."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    body = body.strip()
    rest = ",\n" + body[4:].lstrip() if body[:5].upper() == "WITH " else "\n" + body
    return "WITH " + ",\n".join(SQL[n] for n in order) + rest
