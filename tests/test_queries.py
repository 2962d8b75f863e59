"""Every core query that has an SQL twin agrees with it on the smallest tables, where these are there."""

import os

import pytest

from pagewright.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        c.execute(f"create view {f.split('.')[0]} as select * from '{path}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.values.tolist())


def test_names():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_twin(spark, sql, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
