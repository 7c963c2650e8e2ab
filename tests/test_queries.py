"""Every query of the registry against its SQL, on the smallest tables; those without SQL must run and give rows."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from cellmill import queries as own


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sf, con, name):
    df = own.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    if name in own.ORACLES:
        assert differences(df, con, own.ORACLES[name]) == ""
    else:
        assert not df.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
