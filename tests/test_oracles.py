"""Each registered query of the core library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from courtflow.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer() else str(v)

    columns = sorted(df.columns)
    d = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(tuple(map(plain, r)) for r in d.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert list(got.columns) and len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(con.sql(registry.ORACLE_SQL[name]).df())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
