"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sql, name):
    got = QUERIES[name](spark, SF_SMALL)
    want = sql.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(map(shown, r)) for r in want.fetchall())


def test_entry_runs_and_is_stable(spark):
    import __spark_entry__ as entry

    first, again = entry.entry(spark), entry.entry(spark)
    assert first.schema == again.schema and first.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
