"""Each registered query against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from textloom import registry

DATA = Path("/root/testdata/sf0.001")
ORACLES = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the synthetic tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6g}"
    return str(value)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
