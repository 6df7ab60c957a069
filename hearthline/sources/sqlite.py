"""SQLite and GeoPackage attribute tables as a Spark data source, split by row-id ranges (SRC01 to SRC06, INC02).

``spark.dataSource.register(SqliteSource)`` once, then
``spark.read.format("sqlite").option("table", ..).load(path)``. The file must be readable on the
executors; pure-attribute scans need no geometry library.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: SQLite's column affinities.
_KINDS = (("INT", LongType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("NUM", DoubleType()), ("BLOB", BinaryType()))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://').removeprefix('file:')}?mode=ro&immutable=1", uri=True)


def feature_layers(path: str) -> list[tuple[str, str]]:
    """(layer, geometry column) of a GeoPackage (SRC05)."""
    with _open(path) as db:
        return db.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) ORDER BY 1").fetchall()


def integrity(path: str) -> str:
    """``ok`` or what SQLite finds wrong (SRC06)."""
    with _open(path) as db:
        return db.execute("PRAGMA integrity_check").fetchone()[0]


class RowRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteSource(DataSource):
    """Columns ``option("columns", "a,b")`` of one table, read in ``option("partitions", n)`` ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        kind = lambda declared: next((t for mark, t in _KINDS if mark in (declared or "").upper()), StringType())
        fields = {c[1]: StructField(c[1], kind(c[2])) for c in columns}
        return StructType([fields[c] for c in wanted] if wanted else list(fields.values()))

    def reader(self, schema: StructType) -> "SqliteReader":
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "8")), self.options.get("where", ""))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, n: int, where: str):
        self.path, self.table, self.names, self.n, self.where = path, table, schema.names, n, where

    def partitions(self) -> list[RowRange]:
        with _open(self.path) as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [RowRange(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.n))
        return [RowRange(k, min(k + step - 1, hi)) for k in range(lo, hi + 1, step)]

    def read(self, partition: RowRange):
        columns = ", ".join(f'"{c}"' for c in self.names)
        extra = f" AND ({self.where})" if self.where else ""
        with _open(self.path) as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?{extra}', (partition.lo, partition.hi))
