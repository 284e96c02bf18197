"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sessionloom.plans.registry import FLAGSHIP, ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.select(picked).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_the_flagship_is_registered():
    assert FLAGSHIP in QUERIES
