"""Every query over the smallest tables: it runs, and where it has SQL, DuckDB gives the same rows."""

import math
import os

import pytest
from conftest import SF

import __spark_entry__ as entry
import lodestone.queries_operators  # noqa: F401 - registers its queries
from lodestone.queries import ORACLES, QUERIES


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        cols = [c[0] for c in found.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted(repr([shown(v) for _, v in sorted(zip(cols, r))]) for r in found.fetchall())
        assert sorted(repr([shown(r[c]) for c in sorted(cols)]) for r in got) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
