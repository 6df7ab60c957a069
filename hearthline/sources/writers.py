"""Sinks: committed tables, manifests, status documents and print tables (SNK01 to SNK13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles as text with fixed digits, as printed tables carry them (SNK01)."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 12, compression: str = "none") -> None:
    """CSV with a header; the job's committer makes it appear whole or not at all (SNK01, SNK08, O23, INC05)."""
    fixed(df, digits).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines; NaN has no place there and becomes null (SNK03, SNK12)."""
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").json(path)


def write_raster(df: DataFrame, path: str, by: tuple[str, ...] = ("state", "method", "radius_m")) -> None:
    """Cells or runs, one folder per raster; only the folders that are written are replaced (SNK04, SNK05, INC03)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest(spark, path: str) -> DataFrame:
    """(sha256, path, bytes) of all files under a path, in path order (SNK09, QC12)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("bytes")).orderBy("path")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest differs or that are on one side only; empty when inputs are frozen (QC12, QC13)."""
    a = before.select("path", F.col("sha256").alias("was"))
    return a.join(after.select("path", F.col("sha256").alias("now")), "path", "full").where(~F.col("was").eqNullSafe(F.col("now")))


_ESCAPES = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}


def latex_table(df: DataFrame, caption: str, columns: dict[str, str], order: list[Column | str], most: int = 5000) -> str:
    """A long table for print (SNK10). Print tables are short: more than ``most`` rows are an error, not a cut."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("--")).alias(c) for c in columns], *[(F.col(o) if isinstance(o, str) else o).alias(f"__order{k}") for k, o in enumerate(order)])
    rows = rows.orderBy(*[f"__order{k}" for k in range(len(order))]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not make a print table")
    clean = lambda s: "".join(_ESCAPES.get(ch, ch) for ch in s)
    head = [r"\begin{longtable}{" + "l" * len(columns) + "}", rf"\caption{{{clean(caption)}}}\\", r"\toprule", " & ".join(clean(v) for v in columns.values()) + r" \\", r"\midrule"]
    body = [" & ".join(clean(r[k]) for k in range(len(columns))) + r" \\" for r in rows]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{longtable}"])
