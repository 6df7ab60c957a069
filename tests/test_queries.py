"""Every catalogue query against its DuckDB counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

from hearthline.queries import CATALOGUE

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return repr(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(D):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    query = CATALOGUE[name]
    df = query.run(spark, D)
    got = sorted(tuple(canonical(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if not query.sql:
        assert got
        return
    found = duck.execute(query.sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(canonical(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall())
