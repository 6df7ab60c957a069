"""Thresholds and codes that are part of the results."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Class codes, pixel, thresholds.
NON_WUI, INTERMIX, INTERFACE, NODATA = 0, 1, 2, 255
CLASS_NAMES = {NON_WUI: "Non-WUI", INTERMIX: "Intermix", INTERFACE: "Interface"}
PIXEL_M = 30.0
PIXEL_KM2 = 0.0009
DENSITY_PER_KM2 = 6.17
PATCH_DISTANCE_M = 2400.0
PATCH_MIN_KM2 = 5.0
PATCH_VEGETATION_PCT = 75.0
BOUNDARY_PCT = 50.0
BOUNDARY_TOLERANCE = 1e-12
RADII_M = tuple(range(100, 1001, 100))
SENSITIVITY_STATES = ("CA", "CO", "FL", "PA", "TX")
DEFAULT_RADIUS_M = 500
PERMUTATIONS, SEED, ALPHA = 999, 20260728, 0.05
MIN_UNITS = 30


@dataclass(frozen=True)
class Kernel:
    """A circular neighbourhood: radius in cells, rows of (dy, half width), number of cells, least dense count (GRD09, GRD10)."""

    radius: int
    rows: tuple[tuple[int, int], ...]
    cells: int
    min_count: int

    @staticmethod
    def of_cells(radius: int, min_count: int = 1) -> "Kernel":
        rows = tuple((dy, math.isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1))
        return Kernel(radius, rows, sum(2 * hw + 1 for _, hw in rows), min_count)

    @staticmethod
    def of_metres(radius_m: float, pixel_m: float = PIXEL_M, density: float = DENSITY_PER_KM2) -> "Kernel":
        """The least count is the integer form of ``count / (pi R^2) > density``."""
        least = math.floor(density * math.pi * radius_m * radius_m / 1e6) + 1
        return Kernel.of_cells(max(round(radius_m / pixel_m), 1), least)
