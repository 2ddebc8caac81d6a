"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from docketry.plans.oracle import all_oracles
from docketry.plans.queries import all_queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    _, problems = differences(spark, con, all_queries()[name], all_oracles()[name], SF)
    assert not problems, "\n".join(problems)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["point_id", "label", "rank", "score"]
    assert found.count() == 10


def test_every_query_has_sql():
    assert all_queries().keys() == all_oracles().keys()
    assert all_queries().keys() <= entry.queries().keys()
