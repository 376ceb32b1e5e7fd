from __future__ import annotations

import pytest
from harness import both, database

from spindle.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, con, name):
    ours, theirs = both(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])
    assert ours and ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "place", "symbol", "section", "tokens", "state"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
