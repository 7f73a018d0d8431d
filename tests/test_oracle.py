"""Every registered query runs; those with an oracle match DuckDB at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import canon, close, duck_con, type_mismatches

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows and len(set(df.columns)) == len(df.columns)
        assert any(v is not None for v in rows[0])
        return
    rel = con.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert type_mismatches(df.dtypes, rel.columns, rel.types) == []
    assert len(rows) == len(drows)
    assert close(canon(df.columns, rows), canon(rel.columns, drows))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 1000 and len(df.columns) == 7
