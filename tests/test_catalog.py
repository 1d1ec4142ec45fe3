"""Every registered reference query against its DuckDB oracle, on the smallest test data."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from prlens.plans import catalog, metrics_catalog  # noqa: E402, F401


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    def one(x):
        if x is None or x != x:
            return "null"
        return f"{float(x):.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert _norm(got) == _norm([tuple(r[i] for i in at) for r in cur.fetchall()])


def test_entry_registry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
