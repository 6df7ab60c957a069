"""Record identity and duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import points as D
from hearthline.queries.base import query
from hearthline.session import table

KEY = ["user_id", "event_type", "whole"]
_E = "e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS whole, event_id % 3 AS src FROM events)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("whole"), (F.col("event_id") % 3).alias("src"))


@query("dup_d1_first_kept", f"WITH {_E} SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, whole) AS n_group, row_number() OVER (PARTITION BY user_id, event_type, whole ORDER BY src, event_id) = 1 AS is_kept FROM e")
def d1(spark, d):
    return D.keep_first(_events(spark, d), KEY, ["src", "event_id"]).select("event_id", "n_group", "is_kept")


_GROUPS = """g AS (SELECT user_id, event_type, whole, count(*) AS n, min(src) AS lo, max(src) AS hi FROM e GROUP BY ALL)"""


@query("dup_summary_cross_source", f"""WITH {_E}, {_GROUPS} SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS groups, count(*) FILTER (n > 1) AS repeated_groups, CAST(sum(n - 1) AS BIGINT) AS extra_records,
count(*) FILTER (n > 1 AND lo <> hi) AS cross_groups, CAST(coalesce(sum(n - 1) FILTER (lo <> hi), 0) AS BIGINT) AS cross_extra FROM g""")
def summary(spark, d):
    return D.duplicate_summary(_events(spark, d), KEY, "src")


@query("dup_d2_same_source", f"WITH {_E} SELECT src, count(*) AS extra FROM (SELECT src, row_number() OVER (PARTITION BY src, user_id, event_type, whole ORDER BY event_id) AS k FROM e) WHERE k > 1 GROUP BY src")
def d2(spark, d):
    marked = D.keep_first(_events(spark, d), ["src", *KEY], ["event_id"])
    return marked.where("not is_kept").groupBy("src").agg(F.count("*").alias("extra"))


@query("dup_d3_sufficient", f"WITH {_E} SELECT user_id, event_type, whole, count(*) AS n FROM e GROUP BY ALL HAVING bool_and(whole % 5 <> 0) AND count(*) > 1 AND min(src) <> max(src)")
def d3(spark, d):
    rows = _events(spark, d).withColumn("ok", F.col("whole") % 5 != 0)
    return D.sufficient_duplicates(rows, KEY, "ok", "src").select(*KEY, "n")


_COORD = "SELECT user_id, whole, count(*) AS n, count(DISTINCT CASE WHEN whole % 5 <> 0 OR src > 0 THEN event_type END) AS identities, count(*) FILTER (NOT (whole % 5 <> 0 OR src > 0)) AS insufficient FROM e GROUP BY ALL HAVING count(*) > 1"


def _shared(spark, d):
    rows = _events(spark, d).withColumn("ok", (F.col("whole") % 5 != 0) | (F.col("src") > 0))
    return D.shared_coordinates(rows, ["user_id", "whole"], "event_type", "ok")


@query("dup_d4_identities", f"WITH {_E} SELECT * FROM ({_COORD}) WHERE identities >= 2")
def d4(spark, d):
    return _shared(spark, d).where("identities >= 2")


@query("dup_d5_insufficient", f"WITH {_E} SELECT * FROM ({_COORD}) WHERE insufficient > 0")
def d5(spark, d):
    return _shared(spark, d).where("insufficient > 0")


@query("dup_d6_crowded_cells", f"WITH {_E} SELECT user_id, whole // 10 AS cell, count(*) AS n, count(DISTINCT (whole, event_type)) AS coordinates FROM e GROUP BY ALL HAVING count(DISTINCT (whole, event_type)) >= 2")
def d6(spark, d):
    rows = _events(spark, d).withColumn("cell", F.floor(F.col("whole") / 10))
    return D.crowded_cells(rows, ["user_id", "cell"], ["whole", "event_type"])


@query("dup_d7_near", """WITH p AS (SELECT vec_id, CAST(floor(embedding[1] * 10000) AS DOUBLE) AS x, CAST(floor(embedding[2] * 10000) AS DOUBLE) AS y FROM embeddings)
SELECT a.vec_id, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS nearest FROM p a JOIN p b ON (a.x <> b.x OR a.y <> b.y)
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40000 GROUP BY 1""")
def d7(spark, d):
    """The product is a float as in SQL; ANSI Spark would make float by integer a double, whose floor can be one less."""
    value = lambda k: F.get("embedding", F.lit(k)) * F.lit(10000).cast("float")
    whole = lambda k: F.when(F.abs(value(k)) < float("inf"), F.floor(value(k)).cast("double"))
    points = table(spark, d, "embeddings").select("vec_id", whole(0).alias("x"), whole(1).alias("y"))
    return D.nearest_other(points, "vec_id", "x", "y", 200.0).select("vec_id", F.round("nearest", 6).alias("nearest"))


@query("dup_availability", """WITH f AS (SELECT count(*) AS records, count(*) FILTER (trim(coalesce(role, '')) <> '') AS role, count(*) FILTER (trim(coalesce(text, '')) <> '') AS text FROM conversations)
SELECT 'role' AS field, role AS filled, records, round(role * 100 / records, 6) AS percent FROM f UNION ALL SELECT 'text', text, records, round(text * 100 / records, 6) FROM f""")
def available(spark, d):
    return D.availability(table(spark, d, "conversations"), ["role", "text"])


@query("dup_identical_content", "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def identical(spark, d):
    """Groups of byte-identical content (DUP-F, FLT13)."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("dup_private_examples", f"WITH {_E}, {_GROUPS} SELECT substr(sha256(user_id || '|' || event_type || '|' || whole), 1, 12) AS token, n FROM g WHERE n > 1 ORDER BY n DESC, token LIMIT 10")
def examples(spark, d):
    groups = _events(spark, d).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    return D.private_examples(groups, KEY)


@query("dup_policies", f"""WITH {_E}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, whole ORDER BY src, event_id) = 1 AS p2,
row_number() OVER (PARTITION BY user_id, whole // 2, event_type ORDER BY src, event_id) = 1 AS i3, row_number() OVER (PARTITION BY user_id, whole ORDER BY src, event_id) = 1 AS p4 FROM e)
SELECT count(*) AS p1, count(*) FILTER (p2) AS p2, count(*) FILTER (p2 AND i3) AS p3, count(*) FILTER (p4) AS p4 FROM f""")
def policies(spark, d):
    rows = _events(spark, d).withColumn("half", F.floor(F.col("whole") / 2))
    flags = D.policy_flags(rows, KEY, ["user_id", "half", "event_type"], ["user_id", "whole"], ["src", "event_id"])
    return flags.agg(*[F.count_if(F.col(f"keep_p{k}")).alias(f"p{k}") for k in range(1, 5)])


@query("dup_normalised_text", "SELECT role, count(DISTINCT upper(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')))) AS different FROM conversations GROUP BY role")
def normalised(spark, d):
    rows = table(spark, d, "conversations").select("role", D.normalise_text(F.col("text")).alias("t"))
    return rows.groupBy("role").agg(F.count_distinct("t").alias("different"))
