"""Every query runs; those with a SQL twin give the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import by_name, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {"full_training_run", "trained_cascade_decisions", "calibrated_scores", "selection_cascade", "model_comparison"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    want = by_name([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_fitted_queries_give_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
