"""What the plans of the registered queries must not contain."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLAIN = [n for n in sorted(entry.queries()) if not n.startswith(("src_", "stream_", "batch_", "roundtrip", "collection", "file_"))]


@pytest.mark.parametrize("name", PLAIN)
def test_no_pair_products(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scores_are_computed_once_and_after_the_filter(spark):
    plan = entry.queries()["search_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("score(") == 1
    assert plan.index("ArrowEvalPython") < plan.index("FileScan")
    assert "TakeOrderedAndProject" in plan
