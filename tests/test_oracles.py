"""Every registered query against its SQL oracle on the smallest sample."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
# Empty by nature at this scale: every item of the sample has a vector.
MAY_BE_EMPTY = {"c4_items_without_vectors", "j8_embed_missing"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    found = differences(df, con, sql)
    if name in MAY_BE_EMPTY:
        found = [x for x in found if x != "no rows"]
    assert not found, found


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
