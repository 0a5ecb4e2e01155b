"""Every registered query of the library against its SQL, on the smallest tables."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from shelfspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda t: tuple(str(x).removesuffix(" 00:00:00") for x in t)
    assert sorted(map(key, rows_of(got, columns))) == sorted(map(key, rows_of(want, columns)))


def rows_of(df, columns):
    return [tuple(None if v is None or v != v else v for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None)]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["posicao", "LVRCODIGO", "LVRTITULO", "total_emprestimos"] and df.count() == 10


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
