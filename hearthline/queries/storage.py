"""Sources and sinks: what is written to the shared folder is read back, and scans are summarised."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthline.functions import scalar as C
from hearthline.operators import grid as G
from hearthline.queries import standins as S
from hearthline.queries.base import query
from hearthline.queries.standins import with_sql
from hearthline.session import scratch_dir, table
from hearthline.sources import readers, writers


def _path(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/hearthline/{name}-{uuid.uuid4().hex}"


@query("src_id_range", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders")
def id_range(spark, d):
    return readers.id_range(table(spark, d, "orders"), "o_orderkey")


@query("src_scan_quality", with_sql("zonal", """SELECT count(*) AS rows, count(DISTINCT blk) AS keys, count(*) FILTER (blk IS NULL) AS null_keys, count(*) FILTER (cls IS NULL) AS null_codes,
count(*) FILTER (cls NOT IN (0, 1, 2)) AS bad_codes, count(*) FILTER (veg < 60) AS negative_area, count(*) FILTER (hu < 5) AS null_density, sum(veg - 60) AS area FROM zonal"""))
def scan_quality(spark, d):
    """Areas and densities are made to hold negative and null ones."""
    z = S.zonal(spark, d)
    return readers.scan_quality(z, F.col("cls"), F.col("veg") - 60, F.col("blk"), F.when(F.col("hu") >= 5, F.col("hu")))


@query("src_decimated", with_sql("grid class_z", "SELECT r, c, cls FROM class_z WHERE r % 8 = 4 AND c % 8 = 4"))
def decimated(spark, d):
    """Every eighth cell each way is the feature: a raster for display."""
    return readers.decimate(S.class_z(spark, d), 8)


@query("snk_csv_read_back", "SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier")
def csv(spark, d):
    path = _path(spark, "csv")
    writers.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), path, compression="gzip")
    return readers.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("snk_json_read_back", "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance FROM customer")
def json(spark, d):
    """NaN is written as null."""
    path, balance = _path(spark, "json"), F.col("c_acctbal").cast("double")
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, balance).otherwise(float("nan")).alias("balance"))
    writers.write_json(rows, path)
    return spark.read.schema("c_custkey long, balance double").json(path)


@query("snk_raster_replaced", with_sql("grid class_z", "SELECT r // 64 AS band, count(*) AS cells, sum(CASE WHEN r // 64 = 2 THEN 9 ELSE cls END) AS total FROM class_z GROUP BY 1"))
def raster(spark, d):
    """Of a raster's folders only those that are written again are replaced."""
    path = _path(spark, "raster")
    cells = S.class_z(spark, d).withColumn("band", F.floor(F.col("r") / 64).cast("long"))
    writers.write_raster(cells, path, ("band",))
    writers.write_raster(cells.where("band = 2").withColumn("cls", F.lit(9)), path, ("band",))
    back = spark.read.parquet(path)
    return back.groupBy(F.col("band").cast("long").alias("band")).agg(F.count("*").alias("cells"), F.sum("cls").alias("total"))


@query("snk_manifest_changes", "SELECT 'band=' || range AS part, range = 2 AS changed FROM range(4)")
def manifest(spark, d):
    """Digests before and after one folder is written anew."""
    path = _path(spark, "frozen")
    cells = S.cells(spark).withColumn("cls", F.col("c") % 3).withColumn("band", F.floor(F.col("r") / 64).cast("long"))
    writers.write_raster(cells.coalesce(1), path, ("band",))
    part = F.regexp_extract("path", "(band=[0-9]+)", 1)
    digest = lambda: writers.manifest(spark, path).select(part.alias("path"), "sha256")
    before = spark.createDataFrame(digest().collect(), "path string, sha256 string")  # four files
    writers.write_raster(cells.where("band = 2").withColumn("cls", F.lit(7)).coalesce(1), path, ("band",))
    after = digest()
    moved = writers.unchanged(before, after).select("path", F.lit(True).alias("changed"))
    return before.select("path").join(moved, "path", "left").select(F.col("path").alias("part"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query("flt_grid_and_extent", with_sql("points_p", """SELECT id, (r - 8 BETWEEN 0 AND 199) AND (c - 8 BETWEEN 0 AND 149) AS on_grid, c >= 10 AND c < 120 AND r > 30 AND r <= 200 AS inside FROM points_p"""))
def bounds(spark, d):
    p = S.points_p(spark, d)
    return p.select("id", G.in_bounds(F.col("r") - 8, F.col("c") - 8, 200, 150).alias("on_grid"), G.in_extent(F.col("c"), F.col("r"), 10, 30, 120, 200).alias("inside"))


@query("grd_weighted_counts", with_sql("points_p", "SELECT county, CAST(sum(id % 7) AS BIGINT) AS n FROM points_p GROUP BY 1"))
def weighted(spark, d):
    return G.count_points(S.points_p(spark, d).withColumn("w", F.col("id") % 7), ("county",), "w")


@query("grd_content_hash_equal", "SELECT true AS same, false AS other")
def content(spark, d):
    """The fingerprint doesn't depend on the order of cells, but on each of them."""
    cells = S.class_z(spark, d)
    one = lambda t, n: G.content_hash(t).select(F.lit(n).alias("of"), F.concat_ws(":", "cells", "fingerprint").alias("hash"))
    changed = cells.withColumn("cls", F.when((F.col("r") == 3) & (F.col("c") == 200), (F.col("cls") + 1) % 3).otherwise(F.col("cls")))
    rows = one(cells, "a").unionByName(one(cells.repartition(7, "c").orderBy(F.desc("r")), "b")).unionByName(one(changed, "c"))
    of = lambda n: F.max(F.when(F.col("of") == n, F.col("hash")))
    return rows.agg((of("a") == of("b")).alias("same"), (of("a") == of("c")).alias("other"))


@query("scl_more_formats", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '--' ELSE printf('%,d', CAST(round_even(o_totalprice, 0) AS BIGINT)) END AS thousands,
o_orderstatus = 'O' AS said, lpad(lower(hex(o_orderkey)), 16, '0') AS code, o_orderstatus <> 'P' AS filled FROM orders""")
def formats(spark, d):
    status = F.col("o_orderstatus")
    said = F.when(status == "O", " TRUE ").otherwise("no")
    blank = F.when(status == "P", "  ").otherwise(status)
    price = F.when(F.col("o_orderkey") % 3 != 0, C.round_half_even(F.col("o_totalprice").cast("double")))
    return table(spark, d, "orders").select("o_orderkey", C.thousands(price).alias("thousands"), C.says_true(said).alias("said"), C.hex16(F.col("o_orderkey")).alias("code"), C.is_filled(blank).alias("filled"))
