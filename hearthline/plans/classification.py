"""The plan from points to classified grid, for any number of states, methods and radii at once (entry A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators import grid as G
from hearthline.operators import points as D
from hearthline.params import Kernel


def structures(addresses: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Points without exact duplicates; the first in source order stays."""
    return D.keep_first(addresses, key, order).where("is_kept").drop("n_group", "is_kept")


def classify(points: DataFrame, vegetation: DataFrame, patches: DataFrame, kernel: Kernel, near: Kernel, height: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, r, c0, c1, cls) runs: counts, one events shuffle for three layers, one running sum, one expression."""
    one = lambda cells: cells.select(*keys, "r", "c").withColumn("n", F.lit(1).cast("long"))
    layers = {
        "pts": (G.count_points(points, (*keys, "r", "c")), kernel, "n"),
        "veg": (one(vegetation), kernel, "n"),
        "near": (one(patches), near, "n"),
    }
    return G.classify_circular(G.focal_sums(layers, height, width, keys), "pts", "veg", "near", kernel, kernel.cells)
