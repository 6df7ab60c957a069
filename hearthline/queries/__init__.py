"""The catalogue of named queries, each with its DuckDB counterpart."""

from hearthline.queries import dups, grids, overlays, relational, stats, storage
from hearthline.queries.base import CATALOGUE, Query

__all__ = ["CATALOGUE", "Query", "dups", "grids", "overlays", "relational", "stats", "storage"]
