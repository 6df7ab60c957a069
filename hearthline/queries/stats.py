"""Spatial statistics and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import geometry as V
from hearthline.operators import spatialstats as M
from hearthline.queries import standins as S
from hearthline.queries.base import query
from hearthline.queries.standins import with_sql

_Z = """m AS (SELECT family, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd FROM units GROUP BY family),
z AS (SELECT u.family, u.unit, u.y, m.n, (u.y - m.mean) / m.sd AS z FROM units u JOIN m USING (family)),
k AS (SELECT family, src, count(*) AS k FROM edges GROUP BY ALL),
lag AS (SELECT e.family, e.src AS unit, sum(z.z / k.k) AS lag_z, count(*) AS neighbours FROM edges e JOIN k ON k.family = e.family AND k.src = e.src JOIN z ON z.family = e.family AND z.unit = e.dst GROUP BY ALL)"""


_MORAN_SQL = with_sql("units edges", f"""WITH {_Z},
w AS (SELECT e.family, e.src, e.dst, 1.0 / k.k AS w FROM edges e JOIN k ON k.family = e.family AND k.src = e.src),
s1 AS (SELECT a.family, sum(a.w) AS s0, sum((a.w + coalesce(b.w, 0)) * (a.w + coalesce(b.w, 0))) / 2 AS s1 FROM w a LEFT JOIN w b ON a.family = b.family AND a.src = b.dst AND a.dst = b.src GROUP BY a.family),
t AS (SELECT family, unit, sum(t) AS t FROM (SELECT family, src AS unit, sum(w) AS t FROM w GROUP BY ALL UNION ALL SELECT family, dst, sum(w) FROM w GROUP BY ALL) GROUP BY ALL),
s2 AS (SELECT family, sum(t * t) AS s2 FROM t GROUP BY family),
x AS (SELECT z.family, first(z.n) AS n, sum(z.z * lag.lag_z) AS cr, sum(z.z * z.z) AS sq FROM z LEFT JOIN lag USING (family, unit) GROUP BY z.family),
g AS (SELECT x.family, n, n / s0 * cr / sq AS moran_i, -1.0 / (n - 1) AS expected_i,
 (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1.0 / ((n - 1) * (n - 1)) AS variance_norm FROM x JOIN s1 USING (family) JOIN s2 USING (family))
SELECT family, n, round(moran_i, 9) AS moran_i, round(expected_i, 9) AS expected_i, round(variance_norm, 9) AS variance_norm, round((moran_i - expected_i) / sqrt(variance_norm), 6) AS z_norm FROM g""")


@query("moran_global", _MORAN_SQL)
def moran(spark, d):
    values, edges = M.assemble(S.units(spark, d), S.edges(spark, d))
    out = M.global_moran(values, edges)
    return out.select("family", "n", *[F.round(c, 9).alias(c) for c in ("moran_i", "expected_i", "variance_norm")], F.round("z_norm", 6).alias("z_norm"))


@query("moran_direction", _MORAN_SQL.replace("SELECT family, n, round(moran_i, 9)", """, zs AS (SELECT family, moran_i, expected_i, (moran_i - expected_i) / sqrt(variance_norm) AS z FROM g),
p AS (SELECT family, moran_i, expected_i, greatest(0.0, 1 - 2 * sum(CASE WHEN s.range IN (0, 2000) THEN 1 WHEN s.range % 2 = 1 THEN 4 ELSE 2 END * exp(-(least(abs(z), 12) * s.range / 2000) * (least(abs(z), 12) * s.range / 2000) / 2)) * least(abs(any_value(z)), 12) / 6000 / sqrt(2 * pi())) AS p
      FROM zs, range(2001) s GROUP BY family, moran_i, expected_i)
SELECT family, round(p, 9) AS p_norm, CASE WHEN p < 0.05 AND moran_i > expected_i THEN 'POSITIVE' WHEN p < 0.05 THEN 'NEGATIVE' ELSE 'NOT_SIGNIFICANT' END AS direction FROM p
--"""))
def direction(spark, d):
    """SQL lacks the error function, so its counterpart integrates the normal density by Simpson's rule."""
    values, edges = M.assemble(S.units(spark, d), S.edges(spark, d))
    return M.direction(M.global_moran(values, edges)).select("family", F.round("p_norm", 9).alias("p_norm"), "direction")


@query("moran_eligibility", with_sql("units edges", """WITH u AS (SELECT * FROM units UNION ALL SELECT 'single', 1, 5.0 UNION ALL SELECT 'flat', 1, 5.0 UNION ALL SELECT 'flat', 2, 5.0),
e AS (SELECT * FROM edges UNION ALL SELECT 'flat', 1, 2 UNION ALL SELECT 'flat', 2, 1),
v AS (SELECT family, count(*) AS n, round(var_pop(y), 6) AS variance FROM u GROUP BY family), s AS (SELECT family, CAST(count(DISTINCT src) AS DOUBLE) AS s0 FROM e GROUP BY family)
SELECT family, n, variance, coalesce(s0, 0) AS s0, CASE WHEN n <= 1 OR coalesce(s0, 0) = 0 THEN 'UNDEFINED' WHEN variance <= 0 THEN 'NO_VARIANCE' WHEN n < 30 THEN 'TOO_FEW_UNITS' ELSE 'ELIGIBLE' END AS status FROM v LEFT JOIN s USING (family)"""))
def eligible(spark, d):
    u = S.units(spark, d).unionByName(spark.createDataFrame([("single", 1, 5.0), ("flat", 1, 5.0), ("flat", 2, 5.0)], "family string, unit long, y double"))
    e = S.edges(spark, d).unionByName(spark.createDataFrame([("flat", 1, 2), ("flat", 2, 1)], "family string, src long, dst long"))
    return M.eligibility(u, e).select("family", "n", F.round("variance", 6).alias("variance"), "s0", "status")


@query("moran_quadrant_lag", with_sql("units edges", f"""WITH {_Z}
SELECT z.family, z.unit, round(z.z, 9) AS z, round(lag.lag_z, 9) AS lag_z, round((z.n - 1) * z.z * lag.lag_z / z.n, 9) AS local_i, coalesce(lag.neighbours, 0) AS neighbours,
CASE WHEN z.z > 0 AND lag_z > 0 THEN 'HH' WHEN z.z < 0 AND lag_z < 0 THEN 'LL' WHEN z.z > 0 AND lag_z < 0 THEN 'HL' WHEN z.z < 0 AND lag_z > 0 THEN 'LH' ELSE 'ISLAND_OR_UNDEFINED' END AS quadrant
FROM z LEFT JOIN lag USING (family, unit)"""))
def local(spark, d):
    out = M.local_moran(*M.assemble(S.units(spark, d), S.edges(spark, d)))
    return out.select("family", "unit", *[F.round(c, 9).alias(c) for c in ("z", "lag_z", "local_i")], "neighbours", "quadrant")


def _tested(spark, d):
    values, edges = M.assemble(S.units(spark, d), S.edges(spark, d))
    found = M.local_moran(values, edges)
    return M.local_significance(found, edges)


@query("moran_local_perm")
def permuted(spark, d):
    """Conditional permutations are random by nature: seeded, and checked by distribution."""
    out = _tested(spark, d)
    return out.select("family", "unit", F.round("local_i", 9).alias("local_i"), F.round("p_sim_two_sided", 6).alias("p_sim"), F.round("z_sim", 6).alias("z_sim"))


@query("moran_placeholders", with_sql("units edges", f"""WITH {_Z},
few AS (SELECT 'single' AS family, 1 AS unit UNION ALL SELECT 'flat', 1 UNION ALL SELECT 'flat', 2)
SELECT z.family, z.unit, CASE WHEN z.n < 30 THEN 'TOO_FEW_UNITS' ELSE 'ELIGIBLE' END AS status, CASE WHEN z.n >= 30 THEN round((z.n - 1) * z.z * lag.lag_z / z.n, 9) END AS local_i, z.n >= 30 AND lag.unit IS NOT NULL AS tested FROM z LEFT JOIN lag USING (family, unit)
UNION ALL SELECT family, unit, CASE WHEN family = 'single' THEN 'UNDEFINED' ELSE 'NO_VARIANCE' END, NULL, false FROM few"""))
def placeholders(spark, d):
    """Units of families that cannot be tested keep a row."""
    u = S.units(spark, d).unionByName(spark.createDataFrame([("single", 1, 5.0), ("flat", 1, 5.0), ("flat", 2, 5.0)], "family string, unit long, y double"))
    values, edges = M.assemble(u, S.edges(spark, d).unionByName(spark.createDataFrame([("flat", 1, 2), ("flat", 2, 1)], "family string, src long, dst long")))
    tests = M.local_significance(M.local_moran(values, edges), edges)
    out = M.with_placeholders(tests, values, M.eligibility(values, edges))
    return out.select("family", "unit", "status", F.round("local_i", 9).alias("local_i"), F.col("p_sim_two_sided").isNotNull().alias("tested"))


@query("moran_clusters")
def clusters(spark, d):
    tests = _tested(spark, d)
    labelled = M.cluster_labels(tests, M.fdr_critical(tests, "p_sim_two_sided"))
    return labelled.groupBy("family", "cluster").agg(F.count("*").alias("units"))


@query("moran_two_sided_p", "SELECT * FROM (VALUES (0, CAST(0.375 AS DOUBLE)), (1, CAST(0.375 AS DOUBLE))) t(unit, p)")
def pseudo_p(spark, d):
    up = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
    rows = spark.createDataFrame([(0, 2.5, up), (1, -2.5, up)], "unit int, obs double, sims array<double>")
    return rows.select("unit", M.two_sided_p(F.col("obs"), F.col("sims")).alias("p"))


@query("moran_graph_hash", with_sql("units edges", """WITH n AS (SELECT family, src, '[' || src || ',[' || string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) || ']]' AS t FROM edges GROUP BY family, src)
SELECT family, sha256('[' || string_agg(t, ',' ORDER BY src) || ']') AS weights_sha256 FROM n GROUP BY family"""))
def graph(spark, d):
    return M.graph_hash(S.edges(spark, d))


@query("fdr_bh", """WITH p AS (SELECT event_type AS family, event_id, (event_id * 7919 % 1009 + 1) * (event_id * 7919 % 1009 + 1) / 1020100.0 / 40 AS p FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS n FROM p),
c AS (SELECT family, first(n) AS n_tests, count(*) FILTER (p < 0.05) AS raw_significant, coalesce(max(k) FILTER (p < k * 0.05 / n), 1) AS k FROM r GROUP BY family)
SELECT c.family, n_tests, raw_significant, k, round(k * 0.05 / n_tests, 12) AS critical, (SELECT count(*) FROM p WHERE p.family = c.family AND p.p <= c.k * 0.05 / c.n_tests) AS significant FROM c""")
def fdr(spark, d):
    from hearthline.session import table

    i = F.col("event_id") * 7919 % 1009 + 1
    tests = table(spark, d, "events").select(F.col("event_type").alias("family"), (i * i / 1020100.0 / 40).alias("p"))
    out = M.fdr_critical(tests)
    return out.select("family", "n_tests", "raw_significant", F.col("k").cast("long").alias("k"), F.round("critical", 12).alias("critical"), "significant")


def _boxes(spark, d):
    """Rectangles, some overlapping: (gid, zone, xs, ys) from suppliers."""
    from hearthline.session import table

    k = F.col("s_suppkey")
    x, y = (k * 37 % 200).cast("double"), (k * 53 % 200).cast("double")
    w = (k % 5 * 8 + 10).cast("double")
    return table(spark, d, "supplier").select(k.alias("gid"), (k % 11).alias("zone"), F.array(x, x + w, x + w, x).alias("xs"), F.array(y, y, y + w, y + w).alias("ys"))


_BOXES = "boxes AS (SELECT s_suppkey AS gid, s_suppkey % 11 AS zone, s_suppkey * 37 % 200 AS x, s_suppkey * 53 % 200 AS y, s_suppkey % 5 * 8 + 10 AS w FROM supplier)"


@query("pip_unique_ambiguous_outside", with_sql("points_p", f"""WITH {_BOXES}, j AS (SELECT id, count(DISTINCT zone) AS n, min(zone) AS zone FROM points_p JOIN boxes b ON points_p.c BETWEEN b.x AND b.x + b.w AND points_p.r BETWEEN b.y AND b.y + b.w GROUP BY id)
SELECT p.id AS pid, CASE WHEN n = 1 THEN 'assigned' WHEN n > 1 THEN 'ambiguous' ELSE 'outside' END AS status, CASE WHEN n = 1 THEN zone END AS zone FROM points_p p LEFT JOIN j USING (id)"""))
def pip(spark, d):
    points = S.points_p(spark, d).select(F.col("id").alias("pid"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    boxes = _boxes(spark, d)
    return V.assign_points(points, boxes, boxes.select("gid", "zone"), 32.0)


def _holed(spark, d):
    """Boxes with a hole of half their width in the middle, run the other way round, and a second part beside them."""
    b = _boxes(spark, d)
    x, y = F.element_at("xs", 1), F.element_at("ys", 1)
    w = F.array_max("xs") - F.array_min("xs")
    ring = lambda x0, y0, size: (F.array(x0, x0 + size, x0 + size, x0), F.array(y0, y0, y0 + size, y0 + size))
    hole, part = ring(x + w / 4, y + w / 4, w / 2), ring(x + w + 4, y, w / 2)
    rows = [b.select("gid", *[c.alias(n) for c, n in zip(r, ("xs", "ys"), strict=True)]) for r in (ring(x, y, w), [F.reverse(c) for c in hole], part)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("pip_holes_and_parts", with_sql("points_p", f"""WITH {_BOXES}, s AS (SELECT gid, x, y, w, p.c AS px, p.r AS py, p.id FROM boxes b, points_p p
 WHERE p.c BETWEEN x AND x + w + 4 + w / 2 AND p.r BETWEEN y AND y + w)
SELECT id AS pid, gid FROM s WHERE (px <= x + w AND NOT (px > x + w / 4 AND px < x + w - w / 4 AND py > y + w / 4 AND py < y + w - w / 4)) OR (px >= x + w + 4 AND py <= y + w / 2)"""))
def pip_holes(spark, d):
    points = S.points_p(spark, d).select(F.col("id").alias("pid"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return V.points_in_polygons(points, _holed(spark, d), 32.0)


@query("vec_holes_area", f"WITH {_BOXES} SELECT gid, CAST(w * w AS DOUBLE) AS area FROM boxes")
def holed_area(spark, d):
    """A quarter of the area is a hole and another quarter a part beside it."""
    return V.centroids(_holed(spark, d), "gid", "xs", "ys").select("gid", F.round("area", 6).alias("area"))


@query("vec_area_centroid", f"WITH {_BOXES} SELECT gid, CAST(w * w AS DOUBLE) AS area, x + w / 2 AS cx, y + w / 2 AS cy FROM boxes")
def centroid(spark, d):
    out = V.centroids(_boxes(spark, d), "gid", "xs", "ys")
    return out.select("gid", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy")])


@query("vec_rasterize", f"WITH {_BOXES} SELECT gid, CAST(y + r.range AS BIGINT) AS r, CAST(x AS BIGINT) AS c0, CAST(x + w AS BIGINT) AS c1 FROM boxes, range(60) r WHERE r.range < w")
def rasterize(spark, d):
    return V.fill_polygon(_boxes(spark, d))


@query("patch_components_area", with_sql("points_p", """WITH RECURSIVE d AS (SELECT DISTINCT r // 4 AS r, c // 4 AS c FROM points_p),
reach AS (SELECT r, c, r AS r2, c AS c2 FROM d UNION SELECT reach.r, reach.c, d.r, d.c FROM reach JOIN d ON abs(d.r - reach.r2) + abs(d.c - reach.c2) = 1),
l AS (SELECT r, c, min(r2 * 4294967296 + c2) AS patch FROM reach GROUP BY ALL)
SELECT patch, count(*) AS cells FROM l GROUP BY patch""").replace("WITH points_p", "WITH RECURSIVE points_p").replace(",\nRECURSIVE d", ",\nd"))
def patches(spark, d):
    cells = S.points_p(spark, d).select(F.floor(F.col("r") / 4).alias("r"), F.floor(F.col("c") / 4).alias("c")).distinct()
    return V.patch_components(cells).groupBy("patch").agg(F.count("*").alias("cells"))


@query("patch_near_cells", with_sql("near grid", "SELECT r, c FROM grid JOIN near USING (r, c)"))
def near(spark, d):
    """Cells within the patch distance of a patch, by difference events instead of buffered polygons (VEC07, VEC08)."""
    from hearthline.operators import grid as G

    sums = G.focal_sums({"s": (S.wild(spark), S.NEAR, "n")}, S.N, S.N).where("s > 0")
    return G.explode_runs(sums.select("r", "c0", "c1"))
