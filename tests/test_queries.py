"""Registered queries against their SQL, plans, sources, log queries and streams, on the small tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None and b is None) or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)))
    return a == b


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert rows
        return
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()]
    assert len(rows) == len(expected)
    text = lambda r: [(x is None, str(x) if isinstance(x, (str, bool)) else "", x if isinstance(x, (int, float)) and not isinstance(x, bool) else 0) for x in r]
    ints = lambda r: (text([x for x in r if not isinstance(x, float)]), text([x for x in r if isinstance(x, float)]))
    for a, b in zip(sorted(rows, key=ints), sorted(expected, key=ints), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
