"""Near points of embeddings where float and double products differ, and where a value is not a number or absent."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from hearthline.queries import CATALOGUE

FLOAT_UP = 0.0029  # as a float times 10000 it is 29.0, as a double a little less


def test_near_points_use_the_product_of_floats(spark, tmp_path):
    rows = [[FLOAT_UP, 0.0], [FLOAT_UP + 0.00105, 0.0], [float("nan"), 0.0], [float("inf"), 0.0], [0.0], None, [None, 0.0], [-FLOAT_UP, 0.0]]
    pq.write_table(pa.table({"vec_id": list(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    query = CATALOGUE["dup_d7_near"]
    got = sorted(tuple(r) for r in query.run(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert got == sorted(con.execute(query.sql).fetchall()) and [r[0] for r in got] == [0, 1, 7]
