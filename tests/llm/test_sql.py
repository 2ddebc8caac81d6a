"""Queries that SQL can express, on whole tables."""

import pytest

from docketry.llm.oracle import llm_oracles
from docketry.llm.queries import llm_queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    _, problems = differences(spark, connect(SF), llm_queries()[name], llm_oracles()[name], SF)
    assert not problems, "\n".join(problems)
