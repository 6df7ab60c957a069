import math
import random

from pyspark.sql import functions as F

from hearthline.operators import grid as G
from hearthline.params import RADII_M, Kernel


def test_kernel_table():
    kernels = [Kernel.of_metres(r) for r in RADII_M]
    assert [k.radius for k in kernels] == [3, 7, 10, 13, 17, 20, 23, 27, 30, 33]
    assert [k.cells for k in kernels] == [29, 149, 317, 529, 901, 1257, 1653, 2289, 2821, 3409]
    assert [k.min_count for k in kernels] == [1, 1, 2, 4, 5, 7, 10, 13, 16, 20]
    assert all(k.cells % 2 for k in kernels)  # so half and more than half agree for circles


def test_focal_sum_is_brute_force_and_independent_of_partitions(spark):
    rng = random.Random(1)
    cells = {(rng.randrange(40), rng.randrange(50)): rng.randrange(1, 4) for _ in range(60)}
    df = spark.createDataFrame([(r, c, n) for (r, c), n in cells.items()], "r long, c long, n long")
    kernel = Kernel.of_cells(6)
    want = {}
    for r in range(40):
        for c in range(50):
            s = sum(n for (y, x), n in cells.items() if (y - r) ** 2 + (x - c) ** 2 <= 36)
            if s:
                want[r, c] = s
    for parts in (1, 5):
        runs = G.focal_sums({"s": (df.repartition(parts), kernel, "n")}, 40, 50)
        got = {(x["r"], x["c"]): x["s"] for x in G.explode_runs(runs).where("s > 0").collect()}
        assert got == want


def test_floor_and_truncation_differ_left_of_the_grid(spark):
    df = spark.createDataFrame([(-0.5, -0.5), (0.5, 0.5)], "x double, y double")
    floor = G.world_to_cell(F.col("x"), F.col("y"), 0, 0, 1, 1)
    trunc = G.world_to_cell(F.col("x"), F.col("y"), 0, 0, 1, 1, "trunc")
    rows = df.select(floor[0].alias("fr"), trunc[0].alias("tr")).collect()
    assert [(r["fr"], r["tr"]) for r in rows] == [(-1, 0), (0, 0)]


def test_half_vegetated_blocks(spark):
    rows = [(1, 9.0, 50.0, True), (2, 9.0, 50.0, False), (3, 9.0, 51.0, True), (4, 1.0, 50.0, True)]
    blocks = spark.createDataFrame(rows, "blk int, hd double, veg double, near boolean").withColumn("dense", F.col("hd") > 6.17)
    old = G.classify_zonal(blocks, "hd", "veg", "near", 6.17, strict=False)
    got = {r["blk"]: (r["cls"], r["cls_new"]) for r in G.rebuild_boundary(old, "veg", "dense", "near").collect()}
    assert got == {1: (1, 2), 2: (1, 0), 3: (1, 1), 4: (0, 0)}
    new = {r["blk"]: r["cls"] for r in G.classify_zonal(blocks, "hd", "veg", "near", 6.17).collect()}
    assert new == {k: v[1] for k, v in got.items()}


def test_sampling_counts_missing_cells_as_class_zero(spark):
    raster = spark.createDataFrame([(0, 0, 1), (0, 1, 255)], "r long, c long, cls int")
    points = spark.createDataFrame([(0, 0), (0, 1), (5, 5)], "r long, c long")
    got = G.sample_cells(points, raster).withColumn("k", G.normalise_class(F.col("cls"))).orderBy("r", "c").collect()
    assert [r["k"] for r in got] == [1, 0, 0]


def test_empty_points_make_no_runs(spark):
    none = spark.createDataFrame([], "r long, c long, n long")
    assert G.focal_sums({"s": (none, Kernel.of_cells(3), "n")}, 10, 10).count() == 0


def test_density_threshold_is_strict():
    k = Kernel.of_metres(500)
    assert k.min_count / (math.pi * 0.25) > 6.17 >= (k.min_count - 1) / (math.pi * 0.25)
