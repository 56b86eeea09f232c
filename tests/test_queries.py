import duckdb
import pytest

from netloom import queries as Q

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: On the smallest tables no network lies in another.
LARGER = {"verify_disjoint"}
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    out = {}
    for d in (DATA, MORE):
        out[d] = con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    data = MORE if name in LARGER else DATA
    df = Q.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got
    con = db[data].execute(Q.ORACLE_SQL[name])
    at = [[d[0] for d in con.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in con.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_stream_rates(spark):
    from netloom.streaming.enrich import rates

    df = spark.createDataFrame([("2020-01-01 00:10:00", "a"), ("2020-01-01 00:20:00", "a"), ("2020-01-01 01:20:00", "b")], "t string, k string").selectExpr("cast(t as timestamp) t", "k")
    assert sorted(r["count"] for r in rates(df, "t", "k").collect()) == [1, 2]
