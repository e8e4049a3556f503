"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from marlstone.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: "null" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(clean(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, oracle, name):
    df = queries()[name](spark, DATA)
    want = oracle.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert set(oracle_sql()) <= set(queries()) and set(e.oracle_sql()) <= set(e.queries()) and set(queries()) <= set(e.queries())
