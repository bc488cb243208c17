"""Every registered query of the core library against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from meshwright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)]
    return [tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df.astype(object).itertuples(index=False)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) > 0
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r)))
        assert key(tidy(got)) == key(tidy(want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
