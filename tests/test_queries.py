"""Every query that SQL can express equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

from vellum.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 7))
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 7))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.sql(catalog.ORACLES[name])
    assert sorted(result.columns) == cols
    expected = sorted(tuple(map(plain, r)) for r in result.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == expected
