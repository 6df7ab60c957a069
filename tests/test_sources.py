import json
import sqlite3

from pyspark.sql import functions as F

from hearthline.functions import scalar as C
from hearthline.sources import readers, writers
from hearthline.sources.sqlite import SqliteSource
from hearthline.streaming import incremental


def test_sqlite_ranges_read_every_row_once(spark, tmp_path):
    path = str(tmp_path / "t.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE blocks (GEOID20 TEXT, POP20 INTEGER, share REAL)")
        db.executemany("INSERT INTO blocks VALUES (?, ?, ?)", [(f"{k:015d}", k, k / 2) for k in range(100)])
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("table", "blocks").option("columns", "GEOID20,POP20").option("partitions", "7").load(path)
    assert df.columns == ["GEOID20", "POP20"] and df.agg(F.sum("POP20"), F.count("*")).first() == (4950, 100)


def test_csv_json_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("01", 0.1), ("02", None)], "fips string, v double")
    writers.write_csv(df, str(tmp_path / "c"), compression="gzip")
    back = readers.read_csv(spark, str(tmp_path / "c")).orderBy("fips").collect()
    assert [(r["fips"], r["v"]) for r in back] == [("01", "0.100000000000"), ("02", None)]
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    before = writers.manifest(spark, str(tmp_path / "c"))
    assert writers.unchanged(before, before).count() == 0


def test_geojson_points_and_sniff(spark, tmp_path):
    rows = [{"type": "Feature", "properties": {"street": "A"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "p.geojson").write_text("\n".join(map(json.dumps, rows)))
    got = readers.read_points(spark, str(tmp_path / "p.geojson")).collect()
    assert sorted((r["x"], r["y"]) for r in got if r["x"] is not None) == [(1.0, 2.0)] and len(got) == 2
    assert not readers.first_geometry_is_null(spark, str(tmp_path / "p.geojson"))


def test_catalog_and_fields(spark, tmp_path):
    for name in ("CO_P_500m.bin", "CA_S_100m.bin", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = readers.file_catalog(spark, str(tmp_path), r"^([A-Z]{2})_([PS])_(\d+)m", ["state", "method", "radius"]).collect()
    assert sorted((r["state"], r["method"], r["radius"]) for r in got) == [("CA", "S", "100"), ("CO", "P", "500")]
    assert readers.pick_field(spark.range(1).withColumn("GeoID", F.lit(1)), "GEOID20", "geoid") == "GeoID"


def test_incremental_counts_resume_and_do_not_repeat(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = spark.range(10).select((F.col("id") % 2).alias("k"))
    first.coalesce(1).write.parquet(source)
    assert incremental.count_into(spark, source, first.schema, ["k"], target, mark) == 1
    assert incremental.count_into(spark, source, first.schema, ["k"], target, mark) == 0
    first.coalesce(1).write.mode("append").parquet(source)
    incremental.count_into(spark, source, first.schema, ["k"], target, mark)
    assert sorted(map(tuple, incremental.totals(spark, target, ["k"]).collect())) == [(0, 10), (1, 10)]


def test_scalars(spark):
    row = spark.range(1).select(
        C.zfill(F.lit("1234"), 2).alias("a"), C.strip_decimal(F.lit("12.0")).alias("b"), C.folded_code(F.lit("4294967295")).alias("c"),
        C.p_text(F.lit(0.0001)).alias("d"), C.setting(F.lit(0)).alias("e"), C.to_number(F.lit("x")).alias("f"), C.nfkc(F.lit("ﬁ")).alias("g"),
        C.round_half_even(F.lit(2.5)).alias("h"),
    ).first()
    assert tuple(row) == ("1234", "12", -1, "<0.001", "Fixed", None, "fi", 2.0)


def test_latex(spark):
    text = writers.latex_table(spark.createDataFrame([("b_c", None), ("a", 1.0)], "s string, v double"), "T", {"s": "State", "v": "V"}, ["s"])
    assert text.index("a & 1.0") < text.index(r"b\_c & --")
