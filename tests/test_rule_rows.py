"""Rules reach the nodes as one row."""

from sieveline.catalogue import QUERIES


def test_nodes_are_not_made_once_for_each_partition_of_the_rules(spark, sf):
    plan = QUERIES["security_rule_match"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
