import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import SMALL, assert_same  # noqa: E402
from weft.llm.queries import LLM  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_query_equals_sql(spark, name):
    assert_same(spark, LLM.queries[name], LLM.sql[name])


@pytest.mark.parametrize("name", sorted(set(LLM.queries) - set(LLM.sql)))
def test_query_runs(spark, name):
    assert LLM.queries[name](spark, SMALL).count() >= 0
