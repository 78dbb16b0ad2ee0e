"""Small tasks: sets compared one by one, many tasks streamed through one task of Spark, and keys sent instead of nodes."""

import pytest
from test_selection import graph_problem, tasks_of_all_sizes

from sieveline.catalogue import QUERIES
from sieveline.operators import problem, selection


def test_exact_compares_a_few_sets_without_a_search(monkeypatch):
    cases = [graph_problem(seed, 6 + seed % 10, allowance=12) for seed in range(40)]
    searched = [(p.total(c), round(p.objective(c), 9)) for p in cases for c in [p.exact()]]
    monkeypatch.setattr(problem, "max_closure", None)
    assert [(p.total(c), round(p.objective(c), 9)) for p in cases for c in [p.exact()]] == searched
    monkeypatch.undo()
    monkeypatch.setattr(problem, "FEW", 0)
    assert [(p.total(c), round(p.objective(c), 9)) for p in cases for c in [p.exact()]] == searched


def test_brute_force_builds_no_table_of_all_subsets(monkeypatch):
    cases = [graph_problem(seed, 3 + seed % 9, allowance=10) for seed in range(40)]
    monkeypatch.setattr(problem, "FEW", 0)
    every = [p.brute() for p in cases]
    monkeypatch.undo()
    monkeypatch.setattr(problem, "np", None)
    assert [p.brute() for p in cases] == every


def test_tasks_may_lie_across_batches(spark):
    rows = tasks_of_all_sizes(spark)
    whole = sorted(map(tuple, selection.select(rows, "task", 12).chosen.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, selection.select(rows.coalesce(1), "task", 12).chosen.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["density_graph_budget", "dependency_order"])
def test_graphs_of_tasks_are_made_where_their_keys_have_met(spark, sf, name):
    """Neither nodes nor lists of dependencies are shuffled: seven exchanges of keys for lines, orders, customers and suppliers."""
    plan = exchanges(QUERIES[name](spark, sf))
    assert len(plan) <= 7 and not any("node" in line for line in plan)
