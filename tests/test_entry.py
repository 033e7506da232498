import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from kinfold.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "NULL" if v is None or v != v else (repr(float(v)) if isinstance(v, (float, np.floating)) else str(v))
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_agree_with_their_sql(spark, duck, name):
    assert canon(catalog.queries()[name](spark, DIR).toPandas()) == canon(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
