import pytest

import __spark_entry__ as entry
from compare import differences, duck
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
ROWS_ONLY = {"gr_sgc_predict"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_but_the_trained_one():
    assert set(registry.queries()) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(registry.queries()) <= set(entry.queries())


def test_entry(spark):
    answer = entry.entry(spark)
    assert answer.columns == ["st", "p"] and answer.count() == 3


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query(spark, con, key):
    df = entry.queries()[key](spark, SF)
    if key in SQL:
        assert differences(df, con, SQL[key], []) is None
    else:
        assert df.count()
