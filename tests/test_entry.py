"""The entry points, and all queries with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from svloom.plans.queries import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=cols.__getitem__)

    def norm(x):
        if isinstance(x, float):
            return None if math.isnan(x) else f"{x:.6g}"
        return str(x)

    return sorted(tuple(str(norm(r[i])) for i in order) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = e.queries()[name](spark, SF)
    cur = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(cur.fetchall(), cols)
