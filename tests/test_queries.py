"""Every query of the library against its SQL in DuckDB."""

import duckdb
import pytest

from corpusloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def rows(columns, found):
    return columns, sorted(str([round(float(x), 6) if isinstance(x, float) else str(x) for x in r]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = rows(columns, df.select(*(f"`{c}`" for c in columns)).collect())
    sql = duck.sql(ORACLES[name])
    want = rows(sorted(sql.columns), sql.project(", ".join(f'"{c}"' for c in sorted(sql.columns))).fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_works_without_the_llm_folders(spark, small):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns
