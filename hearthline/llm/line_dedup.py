"""Line deduplication with SQL functions only.

Every line's key is hashed to 128 bits; texts are split once, and the hashes are written out. They are
range-partitioned together with a salt of the document, sorted by document and position inside each
range, and streamed once per key and salt into (documents, last holder). Salted parts of a key meet in
a second, small window, and the verdict goes back to the lines by key and salt, so a line that a third
of all documents hold is spread over ``salts`` tasks both times. What comes back is a run-length
compressed keep bitmap per document; texts are never shuffled to find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import SPACE, ascii_lower, materialise


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, of, pos, h1, h2) of each line whose key is long enough; ``of`` counts the document's lines."""
    split = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), _lines(F.col(text_col)).alias("lines")
    )
    lines = split.select("doc", "version", F.size("lines").alias("of"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    keyed = keyed.select("doc", "version", "of", "pos", ascii_lower(F.col("line")).alias("key"))
    return keyed.select("doc", "version", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, salts: int = 32
) -> DataFrame:
    """(doc, version, n_dropped, keep_runs) of the documents that lose lines.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents keeps its
    lines only in the largest document id that holds it. ``version`` is the hash of the text, so
    repeated rows and rows that share an id stay apart. ``keep_runs`` is the keep bitmap as runs of
    kept lines (start, length); documents that lose nothing have no row. Rows without an id neither
    count nor lose lines; null texts are one empty line; an empty table gives an empty result.
    """
    found = _occurrences(docs, id_col, text_col, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    found = materialise(found, "line-hashes")
    ranged = found.select("h1", "h2", "salt", "doc", "pos").repartitionByRange("h1", "h2", "salt")
    # The window sorts each range by document and position and streams it; no further exchange is needed for it.
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos")
    firsts = ranged.withColumn("before", F.lag("doc").over(stream)).where(~F.col("doc").eqNullSafe(F.col("before")))
    parts = firsts.groupBy("h1", "h2", "salt").agg(F.count("*").alias("docs"), F.max("doc").alias("holder"))
    key = Window.partitionBy("h1", "h2")
    whole = parts.select("h1", "h2", "salt", F.sum("docs").over(key).alias("docs"), F.max("holder").over(key).alias("holder"))
    dropped = found.join(whole.where(F.col("docs") >= min_docs).drop("docs"), ["h1", "h2", "salt"]).where(F.col("doc") != F.col("holder"))
    positions = dropped.groupBy("doc", "version", "of").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return positions.select("doc", "version", F.size("gone").alias("n_dropped"), _runs("gone", "of").alias("keep_runs"))


def _runs(gone: str, of: str):
    """Runs of kept lines before, between and after the sorted dropped positions."""
    return F.expr(
        f"""filter(transform(sequence(0, size({gone})), k -> named_struct(
              'start', if(k = 0, 0, {gone}[k - 1] + 1),
              'length', if(k = size({gone}), {of}, {gone}[k]) - if(k = 0, 0, {gone}[k - 1] + 1))),
            r -> r.length > 0)"""
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """All rows and columns of ``docs`` plus n_lines, n_dropped and kept_text.

    The text that is kept is cut from the lines by the keep bitmap; a row that loses nothing keeps
    its text as it is (null as empty). Helper columns have names that no input column bears.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, **limits).select(
        F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("n_dropped").alias("__gone"), F.col("keep_runs").alias("__runs")
    )
    joined = docs.join(bitmaps, (F.col(id_col) == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__version")), "left")
    cut = F.expr(
        "array_join(flatten(element_at(transform(array(split(`" + text_col + "`, '\\n', -1)), "
        "lines -> transform(__runs, r -> slice(lines, r.start + 1, r.length))), 1)), '\\n')"
    )
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")],
        F.size(_lines(F.col(text_col))).cast("long").alias("n_lines"),
        F.coalesce(F.col("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__runs").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(cut).alias("kept_text"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, len(parts) AS n,
         translate(trim(parts[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
repeated AS (
  SELECT k, max(doc_id) AS holder FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, (r.k IS NOT NULL AND l.doc_id <> r.holder) AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
