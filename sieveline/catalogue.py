"""All registered queries and their SQL."""

from __future__ import annotations

from sieveline.plans import capability_plans, compile_plans, evidence_plans, graph_plans, graph_tasks, incremental_plans, metric_plans, plan_file_plans, policy_plans, selection_plans, staged_plans, text_plans
from sieveline.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "capability_plans", "compile_plans", "evidence_plans", "graph_plans", "graph_tasks", "incremental_plans", "metric_plans", "plan_file_plans", "policy_plans", "selection_plans", "staged_plans", "text_plans"]
