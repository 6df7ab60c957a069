import math

import pytest
from pyspark.sql import functions as F

from hearthline.operators import geometry as V
from hearthline.operators import overlay as O
from hearthline.operators import points as D
from hearthline.operators import population as P
from hearthline.operators import quality as Q
from hearthline.operators import relational as R
from hearthline.operators import spatialstats as M

Y = [0.2, 1.0, 2.5, 4.0, 8.2]


def path(spark, n=5):
    values = spark.createDataFrame([("f", i, Y[i]) for i in range(5)], "family string, unit long, y double")
    pairs = [("f", a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))]
    return values, spark.createDataFrame(pairs, "family string, src long, dst long")


def test_global_moran_on_a_path(spark):
    values, edges = path(spark)
    got = M.global_moran(values, edges).first()
    mean = sum(Y) / 5
    z = [y - mean for y in Y]
    near = {0: [1], 1: [0, 2], 2: [1, 3], 3: [2, 4], 4: [3]}
    cross = sum(z[i] * sum(z[j] for j in near[i]) / len(near[i]) for i in range(5))
    assert got["moran_i"] == pytest.approx(cross / sum(v * v for v in z))
    assert got["expected_i"] == pytest.approx(-0.25)
    p = M.direction(M.global_moran(values, edges)).first()["p_norm"]
    assert p == pytest.approx(math.erfc(abs(got["z_norm"]) / math.sqrt(2)))


def test_islands_keep_a_row_without_results(spark):
    values, edges = path(spark, 4)
    local = {r["unit"]: r for r in M.local_moran(values, edges).collect()}
    assert local[4]["local_i"] is None and local[4]["quadrant"] == "ISLAND_OR_UNDEFINED" and local[4]["neighbours"] == 0
    assert local[0]["quadrant"] == "LL"


def test_permutations_repeat_and_do_not_depend_on_partitions(spark):
    values, edges = path(spark)
    local = M.local_moran(values, edges)
    a = {r["unit"]: r["sims"] for r in M.permute_local(local, edges, 49).collect()}
    b = {r["unit"]: r["sims"] for r in M.permute_local(local.repartition(3), edges.repartition(2), 49).collect()}
    assert a == b and set(a) == set(range(5)) and all(len(v) == 49 for v in a.values())


def test_two_sided_p_of_the_small_fixture(spark):
    up = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
    rows = spark.createDataFrame([(0, 2.5, up), (1, -2.5, up)], "u int, o double, s array<double>")
    assert [r[0] for r in rows.orderBy("u").select(M.two_sided_p(F.col("o"), F.col("s"))).collect()] == [0.375, 0.375]


def test_fdr_without_a_hit_is_alpha_over_n(spark):
    tests = spark.createDataFrame([("f", 0.5), ("f", 0.9), ("g", 0.001), ("g", 0.02), ("g", None)], "family string, p double")
    got = {r["family"]: (r["n_tests"], r["k"], r["significant"]) for r in M.fdr_critical(tests).collect()}
    assert got == {"f": (2, 1, 0), "g": (2, 2, 2)}


def test_jaccard_of_empty_sets_is_null_unless_defined(spark):
    cells = spark.createDataFrame([(0, 0), (255, 0), (0, 255)], "a int, b int")
    row = O.finalise_pairs(O.pair_counts(cells)).first()
    assert row["jaccard"] is None and row["grid_closed"] and row["union_closed"] and row["domain_closed"]
    assert O.finalise_pairs(O.pair_counts(cells), 1.0).first()["jaccard"] == 1.0


def test_allocation_conserves_population(spark):
    pop = spark.createDataFrame([(1, 100.0), (2, 7.0), (3, 0.1)], "z long, pop double")
    counts = spark.createDataFrame([(1, 1, 1, 1), (3, 2, 5, 3)], "z long, n0 long, n1 long, n2 long")
    out = P.allocate(pop, counts, "z")
    assert P.closure(out, F.lit(0)).first()["closed"]
    assert out.where("z = 2").first()["nonwui_pop"] == 7.0  # no structures: all Non-WUI


def test_point_in_polygon_covers_its_boundary_and_reports_ambiguity(spark):
    polygons = spark.createDataFrame([(1, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), (2, [4.0, 8.0, 8.0, 4.0], [0.0, 0.0, 4.0, 4.0])], "gid long, xs array<double>, ys array<double>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 2.0), (3, 9.0, 9.0), (4, 0.0, 0.0)], "pid long, x double, y double")
    pairs = V.points_in_polygons(points, polygons, 3.0)
    zones = spark.createDataFrame([(1, "a"), (2, "b")], "gid long, zone string")
    got = {r["pid"]: (r["status"], r["zone"]) for r in V.resolve_assignment(points, pairs, zones).collect()}
    assert got == {1: ("assigned", "a"), 2: ("ambiguous", None), 3: ("outside", None), 4: ("assigned", "a")}


def test_patches_and_polygon_fill(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3), (4, 3), (4, 4), (1, 5)], "r long, c long")
    patches = V.patch_components(cells)
    assert sorted(r[0] for r in patches.groupBy("patch").count().select("count").collect()) == [1, 3, 3]
    box = spark.createDataFrame([(1, [1.0, 4.0, 4.0, 1.0], [0.0, 0.0, 2.0, 2.0])], "gid long, xs array<double>, ys array<double>")
    assert sorted((r["r"], r["c0"], r["c1"]) for r in V.fill_polygon(box).collect()) == [(0, 1, 4), (1, 1, 4)]


def test_duplicates_treat_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "a", 0)], "id long, k string, src int")
    kept = D.keep_first(rows, ["k"], ["src", "id"]).where("is_kept").select("id").orderBy("id").collect()
    assert [r["id"] for r in kept] == [1, 3]
    assert D.duplicate_summary(rows, ["k"], "src").first()["cross_groups"] == 1


def test_unique_joins_and_gates_fail_loudly(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    once = spark.createDataFrame([(1, "x")], "k long, w string")
    with pytest.raises(R.KeyNotUnique):
        R.join_one_to_one(once, twice, ["k"])
    with pytest.raises(ValueError):
        R.join_lookup(spark.createDataFrame([(2,)], "k long"), once, ["k"])
    with pytest.raises(Q.GateFailed):
        Q.enforce(Q.gate_table(Q.count_gate(once, "one", 1), Q.unique_key(twice, ["k"], "unique")))
