"""The registered queries against their SQL on the smallest tables."""

import importlib.util
import math
from pathlib import Path

import pytest

from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")

import __spark_entry__ as e  # noqa: E402


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(e.queries()))
def test_query(spark, con, name):
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    if (sql := e.oracle_sql().get(name)) is None:
        assert got and len(set(cols)) == len(cols)  # what these find is tested with their operators
        return
    r = con.execute(sql)
    theirs = [d[0] for d in r.description]
    order = sorted(range(len(theirs)), key=lambda i: theirs[i])
    assert cols == sorted(theirs)
    assert got == sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and importlib.util.find_spec("lakeglean")


def test_entry(spark):
    assert e.entry(spark).count() > 0
