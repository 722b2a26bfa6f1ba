import os

import pytest

from oracle import SMALL, assert_same
from weft.queries import CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_query_equals_sql(spark, name):
    assert_same(spark, CORE.queries[name], CORE.sql[name])


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_query_runs(spark, name):
    assert CORE.queries[name](spark, SMALL).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
