import os

import duckdb
import pytest

from strataforge.plans import registry as queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = db.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
