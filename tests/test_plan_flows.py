"""Flows told where a plan's calls meet, held against flows that travel along bindings by joins."""

import random

import pytest

from sieveline.catalogue import QUERIES
from sieveline.operators import capabilities as cp


def test_flows_of_random_plans_are_those_of_the_joins(spark):
    rng = random.Random(7)
    some = lambda values: sorted(v for v in values if rng.random() < 0.4)
    level = lambda: rng.choice([*cp.SENSITIVITY, None])
    names = [f"r{k}" for k in range(6)]
    resources = spark.createDataFrame([(r, rng.choice(["credential", "file", "message_box"]), level(), rng.choice(["unverified_tool", "local_repository", None]), rng.choice([None, some(cp.OUTWARD)])) for r in names], "resource_id string, kind string, sensitivity string, trust_domain string, allowed_sinks array<string>")
    tools = spark.createDataFrame([(f"t{k}", "s", rng.choice(["unverified_tool", "local_repository"]), some([*cp.SINKS, "credential_access", "environment_read"]), some(names), some(names), level()) for k in range(8)], "tool_id string, server_id string, trust_domain string, capabilities array<string>, resources_read array<string>, resources_written array<string>, output_sensitivity string")
    calls, bindings = [], []
    for plan in range(12):
        n = rng.randint(1, 12)
        calls += [(plan, k, 100 * plan + k, f"t{rng.randrange(9)}") for k in range(1, n + 1)]  # t8 is no tool
        bindings += [(plan, *sorted(rng.sample(range(1, n + 1), 2))) for _ in range(rng.randint(0, n)) if n > 1]
    calls = spark.createDataFrame(calls, "plan_id long, ordinal int, call_id long, tool_id string")
    bindings = spark.createDataFrame(bindings, "plan_id long, from_ordinal int, to_ordinal int")
    for most in (64, 5):
        want = cp.flows(calls, cp.provenance(calls, bindings, tools, resources), tools, resources, most)
        got = cp.plan_flows(calls, bindings, tools, resources, max_flows=most)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


@pytest.mark.parametrize("name", ["flow_explanations", "live_explanations", "policy_decisions", "capability_manifest", "approval_match"])
def test_only_calls_and_flows_of_a_plan_are_sent(spark, sf, name):
    """Nothing is shuffled by calls or by single flows."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [line for line in plan if "Exchange hashpartitioning" in line]
    assert sent and not any("ordinal" in line or "flow_id" in line for line in sent)
