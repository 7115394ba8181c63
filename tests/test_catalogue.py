"""Every named query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillgraph.plans import catalogue, rules  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(rows, names):
    def value(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted(repr([value(r[names.index(c)]) for c in sorted(names)]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE:
        assert got
        return
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(got, df.columns) == plain(want.fetchall(), want.columns)
