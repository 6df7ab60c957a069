"""Map algebra on sparse cells and run-length rows.

A raster is rows of cells (r, c, value) or of runs (r, c0, c1, value) with c1 exclusive; an absent
row is NoData. Neighbourhood sums are difference events: a cell adds its value at the left edge of
each kernel row and takes it away behind the right edge, so one shuffle by raster row and a running
sum give every layer at once, and the cost follows the occupied cells, not the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.params import INTERFACE, INTERMIX, NODATA, NON_WUI, Kernel


def world_to_cell(x: Column, y: Column, c0: float, f0: float, a: float, e: float, mode: str = "floor") -> tuple[Column, Column]:
    """(row, column) of planar coordinates, by floor (GRD01) or by truncation toward zero (GRD02)."""
    col, row = (x - F.lit(c0)) / F.lit(a), (y - F.lit(f0)) / F.lit(e)
    if mode == "floor":
        return F.floor(row).cast("long"), F.floor(col).cast("long")
    if mode == "trunc":
        return row.cast("long"), col.cast("long")
    raise ValueError(f"mode must be floor or trunc, not {mode!r}")


def cell_centre(row: Column, col: Column, c0: float, f0: float, a: float, e: float) -> tuple[Column, Column]:
    """(x, y) of a cell's centre (GRD04)."""
    return F.lit(c0) + F.lit(a) * (col + F.lit(0.5)), F.lit(f0) + F.lit(e) * (row + F.lit(0.5))


def cell_id(row: Column, col: Column, width: int) -> Column:
    """Row-major cell number (GRD03)."""
    return row * F.lit(width) + col


def cell_of_id(cell: Column, width: int) -> tuple[Column, Column]:
    """(row, column) of a cell number."""
    row = F.floor(cell / F.lit(width)).cast("long")
    return row, cell - row * F.lit(width)


def in_bounds(row: Column, col: Column, height: int, width: int) -> Column:
    """Whether a cell lies on the grid (FLT08)."""
    return row.between(0, height - 1) & col.between(0, width - 1)


def in_extent(x: Column, y: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """Half-open extent test: left <= x < right and bottom < y <= top (FLT09)."""
    return (x >= left) & (x < right) & (y > bottom) & (y <= top)


def count_points(points: DataFrame, by: tuple[str, ...] = ("r", "c"), weight: str | None = None) -> DataFrame:
    """Points per occupied cell (GRD05, GRD06, AGG12); duplicates count."""
    total = F.sum(weight) if weight else F.count("*")
    return points.groupBy(*by).agg(total.cast("long").alias("n"))


def tile_of(row: Column, col: Column, size: int, tiles_across: int) -> Column:
    """Number of the square tile that holds a cell (GRD07, SRC13)."""
    return (F.floor(row / size) * tiles_across + F.floor(col / size)).cast("long")


def halo_tiles(cells: DataFrame, size: int, halo: int, tiles_across: int, tiles_down: int) -> DataFrame:
    """Each cell once per tile whose padded window holds it (SRC14, GRD08)."""
    lo = lambda c: F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0))
    hi = lambda c, n: F.least(F.floor((F.col(c) + halo) / size), F.lit(n - 1))
    spread = cells.withColumn("tr", F.explode(F.sequence(lo("r"), hi("r", tiles_down))))
    spread = spread.withColumn("tc", F.explode(F.sequence(lo("c"), hi("c", tiles_across))))
    return spread.withColumn("tile", (F.col("tr") * tiles_across + F.col("tc")).cast("long")).drop("tr", "tc")


def _events(cells: DataFrame, kernel: Kernel, value: str, name: str, keys: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in kernel.rows])
    v = F.col(value).cast("long")

    def edges(k):
        row = (F.col("r") + k["dy"]).cast("long")
        left = F.struct(row.alias("r"), (F.col("c") - k["hw"]).cast("long").alias("c"), v.alias(name))
        return F.array(left, F.struct(row.alias("r"), (F.col("c") + k["hw"] + 1).cast("long").alias("c"), (-v).alias(name)))

    return cells.select(*keys, F.explode(F.flatten(F.transform(rows, edges))).alias("e")).select(*keys, "e.*")


def focal_sums(layers: dict[str, tuple[DataFrame, Kernel, str]], height: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs (keys, r, c0, c1, one column per layer) of circular neighbourhood sums (GRD11, JOIN14).

    ``layers`` maps a name to (cells with r, c, value; kernel; value column). Sums are zero-padded
    outside the grid; runs where every sum is zero before the first event of a raster row are absent.
    All layers share one shuffle by (keys, r) and one running sum.
    """
    keys = list(keys)
    parts = []
    for name, (cells, kernel, value) in layers.items():
        part = _events(cells, kernel, value, name, keys)
        part = part.where(F.col("r").between(0, height - 1)).withColumn("c", F.greatest(F.least(F.col("c"), F.lit(width)), F.lit(0)))
        parts.append(part.select(*keys, "r", "c", *[(F.col(name) if n == name else F.lit(0).cast("long")).alias(n) for n in layers]))
    events = reduce(DataFrame.unionByName, parts).groupBy(*keys, "r", "c").agg(*[F.sum(n).alias(n) for n in layers])
    along = Window.partitionBy(*keys, "r").orderBy("c")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    runs = events.select(*keys, "r", F.col("c").alias("c0"), F.lead("c", 1, width).over(along).alias("c1"), *[F.sum(n).over(upto).alias(n) for n in layers])
    return runs.where("c0 < c1")


def explode_runs(runs: DataFrame) -> DataFrame:
    """Cells (.., r, c) of runs."""
    rest = [x for x in runs.columns if x not in ("c0", "c1")]
    return runs.select(*rest, F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("c"))


def classify_circular(runs: DataFrame, points: str, vegetation: str, near: str, density: Kernel, kernel_cells: int, strict: bool = True) -> DataFrame:
    """Adds cls to runs: intermix where dense and vegetated, interface where dense near a patch, else 0 (GRD12, GRD13, GRD14).

    The vegetation share is over kernel cells; ``strict`` asks for more than half of them.
    """
    dense = F.col(points) >= density.min_count
    twice = F.col(vegetation) * 2
    vegetated = twice > kernel_cells if strict else twice >= kernel_cells
    cls = F.when(dense & vegetated, INTERMIX).when(dense & ~vegetated & (F.col(near) > 0), INTERFACE).otherwise(NON_WUI)
    return runs.withColumn("cls", cls)


def mask_domain(raster: DataFrame, domain: DataFrame) -> DataFrame:
    """Cells that are not in ``domain`` (r, c) become NoData (GRD14, GRD18, GRD26); one row of the domain per cell."""
    inside = domain.select("r", "c", F.lit(True).alias("__in")).distinct()
    return raster.join(inside, ["r", "c"], "left").withColumn("cls", F.when(F.col("__in"), F.col("cls")).otherwise(NODATA)).drop("__in")


def classify_zonal(blocks: DataFrame, density: str, vegetation: str, near: str, threshold: float, strict: bool = True) -> DataFrame:
    """Adds cls to blocks (GRD16): more than (or at least, if not ``strict``) half vegetated is intermix."""
    dense = F.col(density) > threshold
    vegetated = F.col(vegetation) > 50.0 if strict else F.col(vegetation) >= 50.0
    return blocks.withColumn("cls", F.when(dense & vegetated, INTERMIX).when(dense & ~vegetated & F.col(near), INTERFACE).otherwise(NON_WUI))


def rebuild_boundary(blocks: DataFrame, vegetation: str, dense: str, near: str, cls: str = "cls", tolerance: float = 1e-12) -> DataFrame:
    """Reclassifies blocks exactly at half vegetation: dense ones are interface if near a patch, else 0 (GRD17, FLT06, SRC11)."""
    at_half = (F.abs(F.col(vegetation) - 50.0) <= tolerance) & F.col(dense)
    return blocks.withColumn(f"{cls}_new", F.when(at_half, F.when(F.col(near), INTERFACE).otherwise(NON_WUI)).otherwise(F.col(cls)))


def mask_by_density(classes: DataFrame, dense_cells: DataFrame) -> DataFrame:
    """Keeps a cell's old class where it is still dense, else 0 (GRD15, O7)."""
    kept = dense_cells.select("r", "c", F.lit(True).alias("__dense"))
    masked = F.when(F.col("__dense"), F.col("cls")).otherwise(NON_WUI)
    return classes.join(kept, ["r", "c"], "left").withColumn("cls_new", masked).drop("__dense")


def sample_cells(points: DataFrame, raster: DataFrame, value: str = "cls", outside: int | None = 0) -> DataFrame:
    """A raster's value at each point's cell (GRD22, GRD23, GRD28); cells without data give ``outside``."""
    found = points.join(raster.select("r", "c", value), ["r", "c"], "left")
    return found if outside is None else found.withColumn(value, F.coalesce(value, F.lit(outside)))


def normalise_class(value: Column) -> Column:
    """1 and 2 stay; NoData, out of bounds and anything else count as 0 (GRD24)."""
    return F.when(value.isin(INTERMIX, INTERFACE), value).otherwise(NON_WUI)


def class_histogram(raster: DataFrame, by: tuple[str, ...] = (), pixel_km2: float = 0.0009) -> DataFrame:
    """Pixels and areas per class (GRD25, GRD26, AREA01); NoData is not valid."""
    n = lambda k: F.count_if(F.col("cls") == k)
    counted = raster.groupBy(*by).agg(n(NON_WUI).alias("nonwui_pix"), n(INTERMIX).alias("intermix_pix"), n(INTERFACE).alias("interface_pix"), F.count_if(F.col("cls") != NODATA).alias("valid_pix"))
    wui = F.col("intermix_pix") + F.col("interface_pix")
    return counted.withColumn("wui_pix", wui).withColumn("wui_km2", F.round(wui * pixel_km2, 6)).withColumn("valid_km2", F.round(F.col("valid_pix") * pixel_km2, 6))


def scenario_weights(cells: DataFrame, address: str = "a", building: str = "b") -> DataFrame:
    """S0 to S5 from address and building counts per coordinate (GRD42, POL-S, GRD43: one pass for all)."""
    a, b = F.col(address), F.col(building)
    has = lambda x: (x > 0).cast("long")
    return cells.select(
        "*",
        (a + b).alias("s0"),
        F.lit(1).cast("long").alias("s1"),
        (has(a) + has(b)).alias("s2"),
        F.when((a > 0) & (b > 0), F.lit(1).cast("long")).otherwise(a + b).alias("s3"),
        a.alias("s4"),
        b.alias("s5"),
    )


# Bins of records per cell, as (name, least, most).
MULTIPLICITY = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4", 4, 4), ("5", 5, 5), ("6-10", 6, 10), ("11-25", 11, 25), ("26-100", 26, 100), (">100", 101, None))


def multiplicity_bin(n: Column) -> Column:
    """The bin of a cell's number of records (GRD44)."""
    out = F.lit(None).cast("string")
    for name, least, most in reversed(MULTIPLICITY):
        inside = n >= least if most is None else n.between(least, most)
        out = F.when(inside, name).otherwise(out)
    return out


def grid_matches(a: dict, b: dict) -> list[str]:
    """Names of the grid properties (affine, size, CRS) in which two grids differ (GRD38, GRD39)."""
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))


def pixel_area_km2(a: float, b: float, d: float, e: float) -> float:
    """Area of an affine grid's pixel (GRD37)."""
    return abs(a * e - b * d) / 1e6


def content_hash(raster: DataFrame) -> DataFrame:
    """One order-insensitive fingerprint of all cells and their values (GRD40)."""
    one = F.xxhash64("r", "c", "cls").cast("decimal(38,0)")
    return raster.agg(F.count("*").alias("cells"), F.sum(one).cast("string").alias("fingerprint"))


def nodata_audit(raster: DataFrame, value: str, declared: int) -> DataFrame:
    """Whether a declared NoData value collides with a valid class (GRD41, GRD21, FLT10, SRC16)."""
    v = F.col(value)
    return raster.agg(
        F.count_if(v == declared).alias("declared_nodata"),
        F.count_if((v == declared) & v.isin(NON_WUI, INTERMIX, INTERFACE)).alias("valid_lost"),
        F.count_if(~v.isin(NON_WUI, INTERMIX, INTERFACE, NODATA)).alias("outside_domain"),
    )
