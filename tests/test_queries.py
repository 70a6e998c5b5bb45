"""Every query with SQL against DuckDB, over the smallest tables; every other runs."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from thresher.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="test tables absent")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name])
        assert sorted(want.columns) == cols
        assert got == Counter(want.select(",".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 50
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
