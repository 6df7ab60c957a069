"""Relational, scalar, window, set and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import scalar as C
from hearthline.operators import quality as Q
from hearthline.operators import relational as R
from hearthline.queries import standins as S
from hearthline.queries.base import query
from hearthline.queries.standins import with_sql
from hearthline.session import table


@query("rel_join_1to1", "SELECT c_custkey AS id, c_name, o.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def one_to_one(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return R.join_one_to_one(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), orders, ["id"])


@query("rel_join_left_many", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def many_to_one(spark, d):
    facts = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return R.join_lookup(facts, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"]).drop("c_custkey")


@query("rel_join_full_indicator", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS merge
FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT l_suppkey * 31 AS k FROM lineitem) b ON a.k = b.k""")
def full(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "lineitem").select((F.col("l_suppkey") * 31).alias("k")).distinct()
    return R.join_with_indicator(a, b, ["k"])


@query("rel_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_semi")


@query("rel_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("rel_join_range", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 45 THEN 'large' END AS label FROM part")
def ranges(spark, d):
    spans = spark.createDataFrame([(10.0, "small"), (30.0, "medium"), (45.0, "large")], "upto double, label string")
    return R.range_lookup(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", spans, "upto", "label").select("p_partkey", "label")


@query("rel_override", """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'renamed' ELSE s_name END AS s_name, s_suppkey % 10 = 0 AS changed FROM supplier""")
def overridden(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = base.where("s_suppkey % 10 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"))
    return R.override(base, new, ["s_suppkey"], ["s_name"])


@query("rel_window_first", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first(spark, d):
    return R.first_by(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("rel_window_topn", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topn(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_by(rows, ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("rel_window_running_group", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS group_id FROM events")
def group_id(spark, d):
    out = R.running_group(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    return out.select("event_id", F.col("group_id").cast("long").alias("group_id"))


@query("rel_window_cumsum", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM lineitem")
def cumsum(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum(F.floor("l_quantity")).over(w).alias("upto"))


@query("rel_group_min_max", "SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(DISTINCT o_orderstatus) AS states, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def segments(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count_distinct("o_orderstatus").alias("states"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@query("rel_group_moments", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 4) AS var FROM events GROUP BY 1")
def moments(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"))


@query("rel_dense_groups", "SELECT n_nationkey, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY 1")
def dense(spark, d):
    """Counts with zero-filled groups (AGG11)."""
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return table(spark, d, "nation").select("n_nationkey").join(some, "n_nationkey", "left").na.fill(0, ["customers"])


@query("rel_micro_ratio", "SELECT n_regionkey, round(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 9) AS micro, round(avg(r), 9) AS macro FROM (SELECT n_regionkey, c_acctbal, avg(CASE WHEN c_acctbal > 0 THEN 100.0 ELSE 0 END) OVER (PARTITION BY n_nationkey) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1".replace("round(avg(r), 9) AS macro", "any_value(m) AS macro").replace("c_acctbal, avg(CASE WHEN c_acctbal > 0 THEN 100.0 ELSE 0 END) OVER (PARTITION BY n_nationkey) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey", "c_acctbal, m FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT n_regionkey AS rk, round(avg(r), 9) AS m FROM (SELECT n_regionkey, n_nationkey, avg(CASE WHEN c_acctbal > 0 THEN 100.0 ELSE 0 END) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) GROUP BY 1) ON rk = n_regionkey"))
def micro_macro(spark, d):
    """Ratio of sums beside mean of ratios (AGG03, AGG04)."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = rows.groupBy("n_regionkey", "n_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("hit"), F.count("*").alias("n"))
    return per.groupBy("n_regionkey").agg(F.round(F.sum("hit") * 100.0 / F.sum("n"), 9).alias("micro"), F.round(F.avg(F.col("hit") * 100.0 / F.col("n")), 9).alias("macro"))


_ORDER = ["BUILDING", "MACHINERY", "AUTOMOBILE"]


@query("rel_sort_custom", "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END AS INTEGER) AS place FROM customer")
def custom_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.custom_rank(F.col("c_mktsegment"), _ORDER).alias("place")).orderBy("place", "c_custkey")


@query("rel_limit_best", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("rel_set_union_widen", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def widen(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return R.union_widened(a, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")))


@query("rel_replace_partition", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'P' FROM orders WHERE o_orderkey % 50 = 0")
def replaced(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.replace_partition(o, o.where("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("P")), F.col("o_orderstatus") == "P")


@query("rel_except_keys", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS only_right")
def except_keys(spark, d):
    return R.same_rows(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("rel_missing_combinations", "SELECT n_nationkey, seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = seg AND c_acctbal > 8000)")
def missing(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return R.missing_keys(c.where("c_acctbal > 8000"), [table(spark, d, "nation").select("n_nationkey"), c.select("seg").distinct()])


@query("rel_pivot_state_method", "SELECT n_regionkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def pivot(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count().na.fill(0).toDF("n_regionkey", "building", "machinery")


@query("rel_unpivot", "SELECT o_orderkey, 'total' AS measure, o_totalprice AS x FROM orders UNION ALL SELECT o_orderkey, 'key', CAST(o_custkey AS DOUBLE) FROM orders")
def unpivot(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("double").alias("key"))
    return rows.unpivot("o_orderkey", ["total", "key"], "measure", "x")


@query("rel_rollup_conus", "SELECT c_mktsegment AS method, coalesce(CAST(c_nationkey AS VARCHAR), 'CONUS') AS state, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS bal, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment))")
def rollup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").cast("string").alias("state"), F.floor("c_acctbal").alias("bal"), F.lit(1).alias("n"))
    return R.totals_row(c, ["method"], "state", ["bal", "n"], "CONUS")


@query("panel_two_scopes", "SELECT 'national' AS analysis_panel, n_nationkey, n_name FROM nation UNION ALL SELECT 'sensitivity', n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
def panels(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return R.in_two_panels(n, ("national", F.lit(True)), ("sensitivity", F.col("n_nationkey") < 5))


@query("panel_labels", """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Fixed' ELSE CAST(n_nationkey % 4 * 100 AS VARCHAR) END AS setting, CASE WHEN n_nationkey % 5 = 0 THEN '--' WHEN n_nationkey / 10000.0 < 0.001 THEN '<0.001' ELSE printf('%.3f', n_nationkey / 10000.0) END AS p FROM nation""")
def labels(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", C.setting(k % 4 * 100).alias("setting"), C.p_text(F.when(k % 5 != 0, k / 10000.0)).alias("p"))


@query("scl_pad_strip_code", """SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS padded,
regexp_replace(c_custkey || '.0', '\\.0$', '') AS stripped, CASE WHEN (c_custkey * 7000000) % 4294967296 > 2147483647 THEN (c_custkey * 7000000) % 4294967296 - 4294967296 ELSE (c_custkey * 7000000) % 4294967296 END AS folded, substr(lpad(CAST(c_custkey AS VARCHAR), 15, '0'), 1, 12) AS bg FROM customer""")
def pads(spark, d):
    k = F.col("c_custkey").cast("string")
    code = (F.col("c_custkey") * 7000000).cast("string")
    return table(spark, d, "customer").select("c_custkey", C.zfill(k, 3).alias("padded"), C.strip_decimal(F.concat(k, F.lit(".0"))).alias("stripped"), C.folded_code(code).alias("folded"), C.block_group(k).alias("bg"))


@query("scl_formats", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS token, regexp_matches(sha256(p_name), '^[0-9a-f]{64}$') AS sha_ok, replace(p_brand, '-', '') || '__' || p_size AS combo, ceil(p_size / 7.0) * 7.0 AS nice, try_cast(trim(p_brand) AS DOUBLE) AS number FROM part")
def formats(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", C.token(F.col("p_name")).alias("token"), C.is_sha256(F.sha2("p_name", 256)).alias("sha_ok"), C.combination(F.col("p_brand"), F.col("p_size")).alias("combo"), C.nice_ceiling(F.col("p_size"), 7.0).alias("nice"), C.to_number(F.col("p_brand")).alias("number"))


@query("scl_percent_close", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal * 100.0 / (s_suppkey % 3) END AS pct, abs(s_acctbal - round(s_acctbal, 1)) <= greatest(0.01, 1e-6 * greatest(abs(s_acctbal), abs(round(s_acctbal, 1)))) AS near FROM supplier")
def percents(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", C.percent(b, F.col("s_suppkey") % 3).alias("pct"), R.close(b, F.round(b, 1), 0.01, 1e-6).alias("near"))


@query("scl_nfkc")
def compat(spark, d):
    """Compatibility forms are not in SQL."""
    return table(spark, d, "documents").select("doc_id", F.sha2(C.nfkc(F.col("text")), 256).alias("nfkc_sha256"))


@query("rel_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority NOT IN ('1-URGENT') AND lower(o_orderpriority) LIKE '%o%' AND o_custkey IS NOT NULL")
def filters(spark, d):
    p = F.col("o_orderpriority")
    keep = F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 150000) & ~p.isin("1-URGENT") & F.lower(p).contains("o") & F.col("o_custkey").isNotNull()
    return table(spark, d, "orders").where(keep).select("o_orderkey")


@query("qc_gate_table", with_sql("grid class_p class_z points_p", """SELECT 'cells' AS gate, true AS passed, 65536.0::DOUBLE AS value, 65536.0::DOUBLE AS expected UNION ALL SELECT 'unique_cells', true, 0, 0
UNION ALL SELECT 'class_closure', true, 0, 0 UNION ALL SELECT 'unique_customers', true, 0, 0"""))
def gates(spark, d):
    from hearthline.operators import grid as G

    raster = S.class_p(spark, d)
    return Q.gate_table(
        Q.count_gate(raster, "cells", S.N * S.N),
        Q.unique_key(raster, ["r", "c"], "unique_cells"),
        Q.closure_gate(G.class_histogram(raster), "class_closure", "valid_pix", ["nonwui_pix", "intermix_pix", "interface_pix"]),
        Q.unique_key(S.points_p(spark, d), ["id"], "unique_customers"),
    )


@query("qc_two_runs_equal", "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def two_runs(spark, d):
    """The same classes from differently partitioned points (QC09, QC10)."""
    again = S.classes(spark, d, S.points_p(spark, d).repartition(7, "id"))
    return R.same_rows(S.class_p(spark, d), again)


@query("prj_nested_rows", "SELECT event_id, 'a' AS k, event_id % 3 AS v FROM events UNION ALL SELECT event_id, 'b', event_id % 5 FROM events")
def nested(spark, d):
    """Lists of records flattened to rows (PRJ12)."""
    items = F.array(F.struct(F.lit("a").alias("k"), (F.col("event_id") % 3).alias("v")), F.struct(F.lit("b").alias("k"), (F.col("event_id") % 5).alias("v")))
    return table(spark, d, "events").select("event_id", F.explode(items).alias("x")).select("event_id", "x.*")


@query("agg_string_sets", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1")
def string_sets(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ";").alias("states"))
