"""Every query of the observation engine against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import trailmark.plans.all  # noqa: F401
from trailmark.operators import registry


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, database, sf_dir, name):
    rows = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(rows.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in rows.collect())
    cursor = database.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
