"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")


def canonical(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    want = sorted((tuple(canonical(x) for x in r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(canonical(r[c]) for c in columns) for r in frame.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 150
