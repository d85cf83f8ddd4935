"""Every registered query against its DuckDB oracle (or rows-only when there is none) at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import duck, rows_of

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"month", "total_sales", "avg_sales", "record_count", "change_pct", "direction"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(got) >= 0
        return
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, got) == rows_of(dcols, want)
