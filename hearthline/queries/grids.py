"""Grid and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import grid as G
from hearthline.operators import overlay as O
from hearthline.params import RADII_M, Kernel
from hearthline.queries import standins as S
from hearthline.queries.base import query
from hearthline.queries.standins import with_sql
from hearthline.session import table


@query("grd_cell_counts", with_sql("points_p", "SELECT r, c, r * 256 + c AS cell, count(*) AS n FROM points_p GROUP BY ALL"))
def cell_counts(spark, d):
    counts = G.count_points(S.points_p(spark, d))
    return counts.select("r", "c", G.cell_id(F.col("r"), F.col("c"), S.N).alias("cell"), "n")


@query("grd_focal_dense_cells", with_sql("grid class_p", "SELECT r, c, CAST(s AS BIGINT) AS s FROM class_p WHERE s >= 3"))
def focal_dense(spark, d):
    sums = G.focal_sums({"s": (G.count_points(S.points_p(spark, d)), S.POINTS, "n")}, S.N, S.N)
    return G.explode_runs(sums.where(F.col("s") >= S.POINTS.min_count)).select("r", "c", "s")


@query("grd_focal_veg_fraction", with_sql("grid veg", "SELECT g.r, g.c, coalesce(s, 0) AS s, 2 * coalesce(s, 0) > 81 AS vegetated FROM grid g LEFT JOIN veg USING (r, c)"))
def veg_fraction(spark, d):
    sums = G.explode_runs(G.focal_sums({"s": (S.wild(spark), S.POINTS, "n")}, S.N, S.N))
    both = S.cells(spark).join(sums, ["r", "c"], "left").withColumn("s", F.coalesce("s", F.lit(0)).cast("long"))
    return both.select("r", "c", "s", (F.col("s") * 2 > S.POINTS.cells).alias("vegetated"))


@query("grd_class_circular", with_sql("grid class_p", "SELECT r, c, cls FROM class_p"))
def class_circular(spark, d):
    return S.class_p(spark, d)


_DOMAIN = "(r - 128) * (r - 128) + (c - 128) * (c - 128) <= 12100 AND (r - 100) * (r - 100) + (c - 90) * (c - 90) > 900"


@query("grd_class_domain", with_sql("grid class_p", f"""WITH m AS (SELECT r // 64 AS band, CASE WHEN {_DOMAIN} THEN cls ELSE 255 END AS cls FROM class_p)
SELECT band, count(*) FILTER (cls = 0) AS nonwui_pix, count(*) FILTER (cls = 1) AS intermix_pix, count(*) FILTER (cls = 2) AS interface_pix, count(*) FILTER (cls <> 255) AS valid_pix FROM m GROUP BY 1"""))
def class_domain(spark, d):
    """Classes within a state's cells, here a disk with a hole; the rest is NoData and not valid."""
    masked = G.mask_domain(S.class_p(spark, d), S.cells(spark).where(_DOMAIN))
    counted = G.class_histogram(masked.withColumn("band", F.floor(F.col("r") / 64).cast("long")), ("band",))
    return counted.select("band", "nonwui_pix", "intermix_pix", "interface_pix", "valid_pix")


@query("grd_class_zonal", with_sql("zonal", "SELECT blk, hu, veg, near, cls FROM zonal"))
def class_zonal(spark, d):
    return S.zonal(spark, d).select("blk", "hu", "veg", "near", "cls")


@query("grd_boundary_50_rebuild", with_sql("zonal", "SELECT blk, veg, old AS cls, CASE WHEN abs(veg - 50) <= 1e-12 AND dense THEN CASE WHEN near THEN 2 ELSE 0 END ELSE old END AS cls_new FROM zonal"))
def boundary(spark, d):
    return G.rebuild_boundary(S.zonal(spark, d, strict=False), "veg", "dense", "near").select("blk", "veg", "cls", "cls_new")


@query(
    "grd_policy_mask",
    with_sql(
        "grid class_p",
        """WITH once AS (SELECT r, c, count(DISTINCT id % 100) AS n FROM points_p GROUP BY ALL),
d2 AS (SELECT p.r + o.dy AS r, p.c + o.dx AS c, sum(p.n) AS s FROM once p, """ + S._OFFSETS.format(r=5) + """ o GROUP BY ALL)
SELECT p.r, p.c, p.cls, CASE WHEN coalesce(d2.s, 0) >= 3 THEN p.cls ELSE 0 END AS cls_new FROM class_p p LEFT JOIN d2 USING (r, c)""",
    ),
)
def policy_mask(spark, d):
    points = S.points_p(spark, d)
    once = points.select("r", "c", (F.col("id") % 100).alias("k")).distinct()
    dense = G.focal_sums({"s": (G.count_points(once), S.POINTS, "n")}, S.N, S.N).where(F.col("s") >= S.POINTS.min_count)
    return G.mask_by_density(S.class_p(spark, d), G.explode_runs(dense.select("r", "c0", "c1"))).select("r", "c", "cls", "cls_new")


@query(
    "grd_scenario_weights",
    with_sql(
        "points_p points_s",
        """WITH a AS (SELECT r, c, count(*) AS a FROM points_p GROUP BY ALL), b AS (SELECT r, c, count(*) AS b FROM points_s GROUP BY ALL),
w AS (SELECT r, c, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (r, c))
SELECT r, c, a, b, a + b AS s0, CAST(1 AS BIGINT) AS s1, CAST((a > 0) AS BIGINT) + CAST((b > 0) AS BIGINT) AS s2,
       CASE WHEN a > 0 AND b > 0 THEN 1 ELSE a + b END AS s3, a AS s4, b AS s5 FROM w""",
    ),
)
def scenarios(spark, d):
    a = G.count_points(S.points_p(spark, d)).withColumnRenamed("n", "a")
    b = G.count_points(S.points_s(spark, d)).withColumnRenamed("n", "b")
    return G.scenario_weights(a.join(b, ["r", "c"], "full").na.fill(0, ["a", "b"]))


@query(
    "grd_multiplicity_bins",
    """SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' WHEN n <= 100 THEN '26-100' ELSE '>100' END AS bin,
count(*) AS cells, CAST(sum(n) AS BIGINT) AS records FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1""",
)
def multiplicity(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.groupBy(G.multiplicity_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("cells"), F.sum("n").alias("records"))


@query(
    "grd_floor_vs_trunc",
    """SELECT vec_id, CAST(floor(y / -0.25) AS BIGINT) AS fr, CAST(floor(x / 0.25) AS BIGINT) AS fc,
CAST(trunc(y / -0.25) AS BIGINT) AS tr, CAST(trunc(x / 0.25) AS BIGINT) AS tc
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)""",
)
def floor_vs_trunc(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    fr, fc = G.world_to_cell(F.col("x"), F.col("y"), 0.0, 0.0, 0.25, -0.25)
    tr, tc = G.world_to_cell(F.col("x"), F.col("y"), 0.0, 0.0, 0.25, -0.25, "trunc")
    return p.select("vec_id", fr.alias("fr"), fc.alias("fc"), tr.alias("tr"), tc.alias("tc"))


@query("grd_sample_points", with_sql("grid class_p points_s", "SELECT s.id, s.r, s.c, CASE WHEN p.cls IN (1, 2) THEN p.cls ELSE 0 END AS cls FROM points_s s LEFT JOIN (SELECT * FROM class_p WHERE r < 200) p USING (r, c)"))
def sample_points(spark, d):
    raster = S.class_p(spark, d).where("r < 200")
    return G.sample_cells(S.points_s(spark, d), raster).withColumn("cls", G.normalise_class(F.col("cls"))).select("id", "r", "c", "cls")


@query(
    "grd_class_histogram_area",
    with_sql(
        "grid class_p",
        """SELECT r // 64 AS band, count(*) FILTER (cls = 0) AS nonwui_pix, count(*) FILTER (cls = 1) AS intermix_pix, count(*) FILTER (cls = 2) AS interface_pix,
count(*) AS valid_pix, count(*) FILTER (cls > 0) AS wui_pix, round(CAST(count(*) FILTER (cls > 0) AS DOUBLE) * 0.0009, 6) AS wui_km2, round(CAST(count(*) AS DOUBLE) * 0.0009, 6) AS valid_km2 FROM class_p GROUP BY 1""",
    ),
)
def histogram(spark, d):
    return G.class_histogram(S.class_p(spark, d).withColumn("band", F.floor(F.col("r") / 64)), ("band",))


@query(
    "grd_kernel_table",
    """WITH k AS (SELECT r.range * 100 AS radius_m, greatest(CAST(round(r.range * 100 / 30.0) AS BIGINT), 1) AS radius_px FROM range(1, 11) r)
SELECT radius_m, radius_px, count(*) AS kernel_cells, CAST(floor(6.17 * pi() * radius_m * radius_m / 1e6) AS BIGINT) + 1 AS min_count
FROM k, range(-40, 41) a, range(-40, 41) b WHERE a.range * a.range + b.range * b.range <= radius_px * radius_px GROUP BY ALL""",
)
def kernels(spark, d):
    rows = [(r, k.radius, k.cells, k.min_count) for r in RADII_M for k in [Kernel.of_metres(r)]]
    return spark.createDataFrame(rows, "radius_m long, radius_px long, kernel_cells long, min_count long")


@query("grd_tile_counts", with_sql("points_s", "SELECT (r // 32) * 8 + c // 32 AS tile, count(*) AS n FROM points_s GROUP BY 1"))
def tiles(spark, d):
    tile = G.tile_of(F.col("r"), F.col("c"), 32, 8)
    return S.points_s(spark, d).groupBy(tile.alias("tile")).agg(F.count("*").alias("n"))


@query(
    "grd_halo_counts",
    with_sql("points_p", "SELECT t.range AS tile, count(*) AS n FROM points_p, range(64) t WHERE r BETWEEN (t.range // 8) * 32 - 5 AND (t.range // 8) * 32 + 36 AND c BETWEEN (t.range % 8) * 32 - 5 AND (t.range % 8) * 32 + 36 GROUP BY 1"),
)
def halos(spark, d):
    return G.halo_tiles(S.points_p(spark, d), 32, 5, 8, 8).groupBy("tile").agg(F.count("*").alias("n"))


@query("grd_nodata_audit", with_sql("grid class_p", "SELECT count(*) FILTER (cls = 0) AS declared_nodata, count(*) FILTER (cls = 0) AS valid_lost, CAST(0 AS BIGINT) AS outside_domain FROM class_p"))
def nodata(spark, d):
    return G.nodata_audit(S.class_p(spark, d), "cls", 0)


@query("grd_cell_centres", with_sql("points_p", "SELECT DISTINCT r * 256 + c AS cell, CAST(100.0 + 30.0 * (c + 0.5) AS DOUBLE) AS x, CAST(9000.0 - 30.0 * (r + 0.5) AS DOUBLE) AS y FROM points_p"))
def centres(spark, d):
    cell = S.points_p(spark, d).select(G.cell_id(F.col("r"), F.col("c"), S.N).alias("cell")).distinct()
    row, col = G.cell_of_id(F.col("cell"), S.N)
    x, y = G.cell_centre(row, col, 100.0, 9000.0, 30.0, -30.0)
    return cell.select("cell", x.alias("x"), y.alias("y"))


@query("grd_multi_radius", with_sql("points_s", "WITH k AS (SELECT * FROM (VALUES (2, 1), (3, 2), (5, 3)) t(radius, least)), n AS (SELECT r, c, count(*) AS n FROM points_s GROUP BY ALL), s AS (SELECT radius, least, r + a.range AS r, c + b.range AS c, sum(n) AS s FROM n, k, range(-5, 6) a, range(-5, 6) b WHERE a.range * a.range + b.range * b.range <= radius * radius GROUP BY ALL) SELECT CAST(radius AS BIGINT) AS radius, count(*) AS dense_cells FROM s WHERE s >= least AND r BETWEEN 0 AND 255 AND c BETWEEN 0 AND 255 GROUP BY 1"))
def multi_radius(spark, d):
    """Several radii over one set of counted cells (O5): one shuffle for all of them."""
    counts = G.count_points(S.points_s(spark, d))
    kernels = [Kernel.of_cells(2, 1), Kernel.of_cells(3, 2), Kernel.of_cells(5, 3)]
    sums = G.focal_sums({f"s{k.radius}": (counts, k, "n") for k in kernels}, S.N, S.N)
    width = F.col("c1") - F.col("c0")
    totals = sums.agg(*[F.sum(F.when(F.col(f"s{k.radius}") >= k.min_count, width)).cast("long").alias(str(k.radius)) for k in kernels])
    return totals.unpivot([], [str(k.radius) for k in kernels], "radius", "dense_cells").withColumn("radius", F.col("radius").cast("long"))


@query("zonal_county_pa_ps", with_sql("grid class_p", """WITH n AS (SELECT r, c, count(*) AS n FROM points_p GROUP BY ALL),
z AS (SELECT (r // 64) * 4 + c // 64 AS county, cls, coalesce(n, 0) AS n FROM class_p LEFT JOIN n USING (r, c))
SELECT county, count(*) AS land_pix, count(*) FILTER (cls = 1) AS intermix_pix, count(*) FILTER (cls = 2) AS interface_pix,
CAST(sum(n) AS BIGINT) AS total_struct, CAST(coalesce(sum(n) FILTER (cls = 1), 0) AS BIGINT) AS intermix_struct, CAST(coalesce(sum(n) FILTER (cls = 2), 0) AS BIGINT) AS interface_struct,
round(count(*) FILTER (cls > 0) / count(*), 12) AS p_a, round(CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (cls > 0), 0) / sum(n) END, 12) AS p_s FROM z GROUP BY county"""))
def zonal(spark, d):
    cells = S.class_p(spark, d).join(G.count_points(S.points_p(spark, d)), ["r", "c"], "left")
    return O.zonal_metrics(cells.withColumn("county", (F.floor(F.col("r") / 64) * 4 + F.floor(F.col("c") / 64)).cast("long")), "county")


@query("struct_counts_by_class", with_sql("grid class_p points_s", """WITH x AS (SELECT coalesce(p.cls, 255) AS cls FROM points_s s LEFT JOIN (SELECT * FROM class_p WHERE r < 200) p USING (r, c))
SELECT count(*) AS total_struct, count(*) FILTER (cls = 0) AS nonwui_struct, count(*) FILTER (cls = 1) AS intermix_struct, count(*) FILTER (cls = 2) AS interface_struct, count(*) FILTER (cls = 255) AS nodata_struct, true AS closed FROM x"""))
def structures(spark, d):
    raster = S.class_p(spark, d).where("r < 200")
    return O.structures_by_class(G.sample_cells(G.count_points(S.points_s(spark, d)), raster, outside=255))
