"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pytest

from quillspark.plans import catalogue
from quillspark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _norm(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    expected = oracle.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in rows) == sorted(tuple(map(_norm, r)) for r in want)
