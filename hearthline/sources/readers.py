"""Scans: typed files, catalogues of files, and schema resolution (SRC01 to SRC26)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header, plain or gzip (SRC17, SRC18). Without a schema every column is text; nothing is inferred."""
    reader = spark.read.options(header=True, mode="PERMISSIVE", **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON documents, one or many per file (SRC19)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geom_type, x, y) of newline-delimited GeoJSON points (SRC07, SRC12, FLT07); other geometries and bad rows give null places."""
    schema = "type string, properties map<string,string>, geometry struct<type:string,coordinates:array<double>>"
    rows = spark.read.schema(schema).json(path)
    xy = F.when(F.col("geometry.type") == "Point", F.col("geometry.coordinates"))
    return rows.select("properties", F.col("geometry.type").alias("geom_type"), F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y"))


def first_geometry_is_null(spark: SparkSession, path: str) -> bool:
    """Whether the first record of newline-delimited GeoJSON has no geometry (SRC21): reads one row."""
    row = spark.read.schema("geometry string").json(path).limit(1).first()
    return row is not None and row["geometry"] is None


def read_meta_count(spark: SparkSession, path: str) -> DataFrame:
    """(path, records) of JSON side-cars that give a count under one of the usual names (SRC20)."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    names = ("count", "records", "feature_count", "features")
    return texts.select("path", F.coalesce(*[F.get_json_object("value", f"$.{n}").cast("long") for n in names]).alias("records"))


def file_catalog(spark: SparkSession, path: str, pattern: str, names: list[str], content: bool = False) -> DataFrame:
    """Files whose name matches, with the pattern's groups as columns, size, time and (if asked) digest (SRC23, D14, SCL25, SNK09).

    Only metadata is read unless the digest is wanted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = F.element_at(F.split("path", "/"), -1)
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    picked = files.where(base.rlike(java)).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
        *[F.regexp_extract(base, java, k + 1).alias(n) for k, n in enumerate(names)],
        *([F.sha2("content", 256).alias("sha256")] if content else []),
    )
    return picked


def pick_field(df: DataFrame, *names: str) -> str:
    """The first of some names that a table has, in any case (SRC24, SRC10)."""
    have = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in have:
            return have[name.lower()]
    raise KeyError(f"none of {', '.join(names)} in {', '.join(df.columns)}")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself, or an error that lists what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def id_range(df: DataFrame, id_col: str) -> DataFrame:
    """(lo, hi, n) of an id (SRC04)."""
    return df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count("*").alias("n"))


def decimate(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th cell of a raster, for display (SRC15)."""
    return cells.where((F.col("r") % step == step // 2) & (F.col("c") % step == step // 2))


def scan_quality(df: DataFrame, code: Column, area: Column, key: Column, density: Column) -> DataFrame:
    """Conditional counts of a block table in one pass (SRC03, AGG10)."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(key.isNull()).alias("null_keys"), F.count_if(code.isNull()).alias("null_codes"),
        F.count_if(~code.isin(0, 1, 2)).alias("bad_codes"), F.count_if(area < 0).alias("negative_area"), F.count_if(density.isNull()).alias("null_density"), F.sum(area).alias("area"),
    )
