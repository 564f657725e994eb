"""What SQL can say of the training-data operators, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from textloom.llm import oracles, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="the synthetic tables are not here")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(names)
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(got.select(*names).collect()) == order(found.fetchall())
