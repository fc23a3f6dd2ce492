"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n in __spark_entry__.CATALOG))
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = db.execute(__spark_entry__.oracle_sql()[name])
    own = [c[0] for c in cursor.description]
    assert sorted(own) == names
    at = [own.index(c) for c in names]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "p_name", "p_type", "p_brand"]
