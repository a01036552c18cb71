"""Every query of the library proper against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from turnlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    found = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return found


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, database, name):
    df = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql()[name]
    result = database.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
