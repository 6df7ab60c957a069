"""Pairwise overlay, transition and sensitivity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import grid as G
from hearthline.operators import overlay as O
from hearthline.operators import population as P
from hearthline.queries import standins as S
from hearthline.queries.base import query
from hearthline.queries.standins import with_sql

_COUNTERS = """count(*) FILTER (a IN (1, 2) AND b IN (1, 2)) AS both_wui, count(*) FILTER (a IN (1, 2) AND b = 0) AS a_only, count(*) FILTER (a = 0 AND b IN (1, 2)) AS b_only,
count(*) FILTER (a = 0 AND b = 0) AS both_non_wui, count(*) FILTER (a < 255 AND b < 255) AS common_valid, count(*) FILTER (a = 255 AND b < 255) AS excluded_a_nodata,
count(*) FILTER (a < 255 AND b = 255) AS excluded_b_nodata, count(*) FILTER (a = 255 AND b = 255) AS excluded_both_nodata, count(*) AS full_grid,
count(*) FILTER (a IN (1, 2) AND b < 255) AS a_wui_common, count(*) FILTER (b IN (1, 2) AND a < 255) AS b_wui_common"""

_PAIR = """x AS (SELECT g.r, g.c, g.r // 64 AS band, coalesce(p.cls, 255) AS a, coalesce(z.cls, 255) AS b FROM grid g
  LEFT JOIN (SELECT * FROM class_p WHERE c < 240) p USING (r, c) LEFT JOIN (SELECT * FROM class_z WHERE r >= 16) z USING (r, c))"""
_FINAL = f"y AS (SELECT band, {_COUNTERS} FROM x GROUP BY band)"


def _pair(spark, d):
    a, b = S.class_p(spark, d).where("c < 240"), S.class_z(spark, d).where("r >= 16")
    full = S.cells(spark).join(O.overlay(a, b), ["r", "c"], "left").na.fill(255, ["a", "b"])
    return full.withColumn("band", F.floor(F.col("r") / 64))


def _pairs(spark, d):
    return O.finalise_pairs(O.pair_counts(_pair(spark, d), by=("band",)))


@query("pair_counts", with_sql("grid class_p class_z", f"WITH {_PAIR} SELECT band, {_COUNTERS} FROM x GROUP BY band"))
def counts(spark, d):
    return O.pair_counts(_pair(spark, d), by=("band",))


@query("pair_final", with_sql("grid class_p class_z", f"""WITH {_PAIR}, {_FINAL}, u AS (SELECT *, a_wui_common + b_wui_common - both_wui AS union_pix FROM y)
SELECT *, round(CASE WHEN union_pix > 0 THEN both_wui / union_pix END, 12) AS jaccard, round(CASE WHEN common_valid > 0 THEN (both_wui + both_non_wui) / common_valid END, 12) AS agreement,
round(CAST(both_wui AS DOUBLE) * 0.0009, 6) AS intersection_km2, round(CAST(union_pix AS DOUBLE) * 0.0009, 6) AS union_km2, true AS grid_closed, true AS union_closed, true AS domain_closed FROM u"""))
def final(spark, d):
    return _pairs(spark, d)


@query("pair_jaccard_micro", with_sql("grid class_p class_z", f"""WITH {_PAIR}, {_FINAL}
SELECT 'P/Z' AS pair, CAST(sum(both_wui) AS BIGINT) AS both_wui, CAST(sum(a_wui_common + b_wui_common - both_wui) AS BIGINT) AS union_pix, count(*) AS units,
round(sum(both_wui) / sum(a_wui_common + b_wui_common - both_wui), 12) AS micro_jaccard FROM y"""))
def micro(spark, d):
    return O.micro_jaccard(_pairs(spark, d).withColumn("pair", F.lit("P/Z")), ("pair",))


@query("pair_jaccard_macro", with_sql("grid class_p class_z", f"""WITH {_PAIR}, {_FINAL},
j AS (SELECT CASE WHEN a_wui_common + b_wui_common - both_wui > 0 THEN round(both_wui / (a_wui_common + b_wui_common - both_wui), 12) END AS j FROM y)
SELECT 'P/Z' AS pair, round(avg(j), 12) AS macro_jaccard, round(min(j), 12) AS least, round(max(j), 12) AS most, round(max(j) - min(j), 12) AS spread FROM j"""))
def macro(spark, d):
    return O.macro_jaccard(_pairs(spark, d).withColumn("pair", F.lit("P/Z")), ("pair",))


@query("pair_three_methods", with_sql("grid class_p class_s class_z", """WITH m AS (SELECT p.cls AS p, s.cls AS s, z.cls AS z FROM class_p p JOIN class_s s USING (r, c) JOIN class_z z USING (r, c)),
x AS (SELECT 'P/S' AS pair, p AS a, s AS b FROM m UNION ALL SELECT 'P/Z', p, z FROM m UNION ALL SELECT 'S/Z', s, z FROM m)
SELECT pair, count(*) FILTER (a > 0 AND b > 0) AS both_wui, count(*) FILTER (a > 0 OR b > 0) AS either FROM x GROUP BY pair"""))
def three(spark, d):
    """One co-located overlay of three rasters gives all three pairs."""
    m = S.class_p(spark, d).withColumnRenamed("cls", "p").join(S.class_s(spark, d).withColumnRenamed("cls", "s"), ["r", "c"])
    m = m.join(S.class_z(spark, d).withColumnRenamed("cls", "z"), ["r", "c"])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a.upper()}/{b.upper()}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("p", "s"), ("p", "z"), ("s", "z"))]))
    x = m.select(pairs.alias("x")).select("x.*")
    return x.groupBy("pair").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both_wui"), F.count_if((F.col("a") > 0) | (F.col("b") > 0)).alias("either"))


def _old_new(spark, d):
    return O.overlay(S.class_z(spark, d, strict=False), S.class_z(spark, d))


@query("chg_transition_matrix", with_sql("class_z", "SELECT old AS old_cls, cls AS new_cls, count(*) AS pixels FROM class_z GROUP BY ALL"))
def transition(spark, d):
    return O.transitions(_old_new(spark, d))


@query("chg_transition_pivot", with_sql("class_z", "SELECT old AS old_cls, count(*) FILTER (cls = 0) AS to_0, count(*) FILTER (cls = 1) AS to_1, count(*) FILTER (cls = 2) AS to_2 FROM class_z GROUP BY old"))
def pivoted(spark, d):
    wide = O.transitions(_old_new(spark, d)).groupBy("old_cls").pivot("new_cls", [0, 1, 2]).sum("pixels").na.fill(0)
    return wide.toDF("old_cls", "to_0", "to_1", "to_2")


@query("chg_allowed_gate", with_sql("class_z", "SELECT count(*) = 0 AS passed, count(*) AS forbidden FROM (SELECT DISTINCT old, cls FROM class_z WHERE old <> cls AND NOT (old = 1 AND cls IN (0, 2)))"))
def gate(spark, d):
    bad = O.forbidden_transitions(_old_new(spark, d), [(1, 0), (1, 2)])
    return bad.agg(F.count("*").alias("forbidden")).select((F.col("forbidden") == 0).alias("passed"), "forbidden")


@query("chg_changed_cells", with_sql("class_z", "SELECT r, c, old AS a, cls AS b FROM class_z WHERE old <> cls"))
def changed(spark, d):
    return O.changed_cells(_old_new(spark, d))


@query("chg_changed_at_structures", with_sql("points_p class_z", "SELECT r, c, count(*) AS n, old AS a, cls AS b FROM class_z JOIN points_p USING (r, c) WHERE old <> cls GROUP BY ALL"))
def changed_sparse(spark, d):
    return O.changed_at(_old_new(spark, d), G.count_points(S.points_p(spark, d)))


@query("chg_impact", with_sql("class_z", """SELECT count(*) FILTER (old > 0 AND cls = 0) AS lost, count(*) FILTER (old = 0 AND cls > 0) AS gained, count(*) FILTER (old > 0 AND cls > 0) AS kept,
count(*) FILTER (old > 0 OR cls > 0) AS either, count(*) FILTER (old <> cls) AS changed,
CASE WHEN count(*) FILTER (old > 0 OR cls > 0) = 0 THEN 1.0 ELSE round(CAST(count(*) FILTER (old > 0 AND cls > 0) AS DOUBLE) / count(*) FILTER (old > 0 OR cls > 0), 12) END AS jaccard FROM class_z"""))
def impact(spark, d):
    return O.impact(_old_new(spark, d))


@query("chg_block_transitions", with_sql("zonal", "SELECT old AS old_cls, cls AS new_cls, count(*) AS blocks, CAST(sum(hu) AS BIGINT) AS hu FROM zonal GROUP BY ALL"))
def block_transitions(spark, d):
    old = S.zonal(spark, d, strict=False).select("blk", F.col("cls").alias("old_cls"))
    both = S.zonal(spark, d).withColumnRenamed("cls", "new_cls").join(old, "blk")
    return both.groupBy("old_cls", "new_cls").agg(F.count("*").alias("blocks"), F.sum("hu").alias("hu"))


_POP = """pop AS (SELECT (r // 16) * 16 + c // 16 AS blk, CAST(sum(greatest(0, CAST(floor(c_acctbal) AS BIGINT))) AS BIGINT) AS pop FROM points_p GROUP BY 1)"""


def _population(spark, d):
    p = S.points_p(spark, d)
    blk = (F.floor(F.col("r") / 16) * 16 + F.floor(F.col("c") / 16)).cast("long")
    return p.groupBy(blk.alias("blk")).agg(F.sum(F.greatest(F.lit(0), F.floor("c_acctbal"))).alias("pop"))


def _counted(spark, d, raster):
    blk = (F.floor(F.col("r") / 16) * 16 + F.floor(F.col("c") / 16)).cast("long")
    return P.class_counts(G.sample_cells(S.points_s(spark, d), raster).withColumn("blk", blk), "blk")


@query("pop_by_block", with_sql("points_p", f"WITH {_POP} SELECT * FROM pop"))
def pop_by_block(spark, d):
    return _population(spark, d)


@query("pop_allocate", with_sql("grid class_p points_s", f"""WITH {_POP},
n AS (SELECT (r // 16) * 16 + c // 16 AS blk, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2 FROM points_s JOIN (SELECT r, c, cls FROM class_p) USING (r, c) GROUP BY 1),
a AS (SELECT blk, pop, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM pop LEFT JOIN n USING (blk))
SELECT *, round(CASE WHEN n0 + n1 + n2 > 0 THEN pop * n1 / (n0 + n1 + n2) ELSE 0 END, 6) AS intermix_pop, round(CASE WHEN n0 + n1 + n2 > 0 THEN pop * n2 / (n0 + n1 + n2) ELSE 0 END, 6) AS interface_pop,
round(CASE WHEN n0 + n1 + n2 > 0 THEN pop * n0 / (n0 + n1 + n2) ELSE pop END, 6) AS nonwui_pop FROM a"""))
def allocate(spark, d):
    out = P.allocate(_population(spark, d), _counted(spark, d, S.class_p(spark, d)), "blk")
    return out.select("blk", "pop", "n0", "n1", "n2", *[F.round(c, 6).alias(c) for c in ("intermix_pop", "interface_pop", "nonwui_pop")])


@query("pop_closure", with_sql("points_p", f"WITH {_POP} SELECT CAST(sum(pop) AS DOUBLE) AS official, true AS closed FROM pop"))
def closure(spark, d):
    out = P.allocate(_population(spark, d), _counted(spark, d, S.class_p(spark, d)), "blk")
    return P.closure(out, F.lit(0)).select("official", "closed")


@query("pop_zone_direct", with_sql("zonal points_p", f"""WITH {_POP}, x AS (SELECT z.blk AS l, p.blk AS q, z.cls, p.pop FROM zonal z FULL JOIN pop p ON z.blk = p.blk)
SELECT CASE WHEN l IS NULL THEN 'right_only' WHEN q IS NULL THEN 'left_only' ELSE 'both' END AS merge, cls, count(*) AS zones, CAST(sum(pop) AS BIGINT) AS population FROM x GROUP BY ALL"""))
def zone_direct(spark, d):
    return P.zone_direct(S.zonal(spark, d), _population(spark, d), "blk")


@query("pop_delta_equals_full", with_sql("points_s class_z", """SELECT (r // 16) * 16 + c // 16 AS blk, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2, true AS same
FROM points_s JOIN class_z USING (r, c) GROUP BY 1"""))
def delta(spark, d):
    blk = (F.floor(F.col("r") / 16) * 16 + F.floor(F.col("c") / 16)).cast("long")
    points = S.points_s(spark, d).withColumn("blk", blk)
    moved = P.delta_counts(_counted(spark, d, S.class_z(spark, d, strict=False)), points, O.changed_cells(_old_new(spark, d)), "blk")
    full = _counted(spark, d, S.class_z(spark, d)).toDF("blk", "m0", "m1", "m2")
    both = moved.join(full, "blk", "full")
    same = F.col("n0").eqNullSafe(F.col("m0")) & F.col("n1").eqNullSafe(F.col("m1")) & F.col("n2").eqNullSafe(F.col("m2"))
    return both.select("blk", "n0", "n1", "n2", same.alias("same"))


@query("sens_radius_expand", with_sql("grid class_z", "SELECT CAST(r.range * 100 AS BIGINT) AS radius_m, 'Z' AS method, count(*) FILTER (cls > 0) AS wui_pix FROM class_z, range(1, 11) r GROUP BY 1"))
def sens(spark, d):
    """A fixed-boundary method repeated at every radius (PRJ10)."""
    one = S.class_z(spark, d).agg(F.count_if(F.col("cls") > 0).alias("wui_pix"))
    return one.select(F.explode(F.sequence(F.lit(100), F.lit(1000), F.lit(100))).alias("radius_m"), F.lit("Z").alias("method"), "wui_pix").withColumn("radius_m", F.col("radius_m").cast("long"))
