"""Every registered matrix query runs, and has the columns of its SQL."""

from __future__ import annotations

import duckdb
import pytest

from depmatrix.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Whole analyses that other queries run as well; test_matrices has them.
SLOW = {"process_metrics", "process_tears", "process_metrics_supp_chain", "process_tears_supp_chain", "cluster_metrics", "cluster_sequence"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - SLOW))
def test_query(name, spark, duck):
    got = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        got.limit(1).collect()
        return
    want = duck.execute(sql)
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    columns = sorted(got.columns)
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    names = [d[0] for d in want.description]
    assert rows == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


def _plain(x):
    """As text, so that nulls sort; numbers of equal value look alike."""
    return "" if x is None else f"{float(x):.6f}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
