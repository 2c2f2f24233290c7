import math

import duckdb
import pytest

from tidewheel.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "customer", "nation")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(x):
    return bytes(x) if isinstance(x, bytearray) else round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    sql = db.sql(ORACLE[name])
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
