"""The whole compilation as one chain of DataFrames: policy, supersession, analysis, selection with dependencies, rendering, the exact budget.

Tasks are rows of a table, so that many are compiled at once: ``tasks`` has task_id, terms and, if wanted, the instructions system, developer, policy, tools
and user. What they take of the budget once rendered is overhead; the rest is the task's allowance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import graph, policy, render, selection
from sieveline.store import stored

INSTRUCTIONS = ("system", "developer", "policy", "tools", "user")


@dataclass
class Compilation:
    """selected: task_id, node_id, rank, cost, used. rendered: task_id, text, tokens. record: how each task was solved. trimmed: what the exact
    budget took out again, with its evidence. overflow: tasks (CTX510) whose instructions and mandatory nodes don't fit; they have no text."""

    selected: DataFrame
    rendered: DataFrame
    source_map: DataFrame
    diagnostics: DataFrame
    blocked: DataFrame
    record: DataFrame
    trimmed: DataFrame
    overflow: DataFrame


def compile_tasks(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, rules: DataFrame, anchor: str, budget: int, strategy: str = "auto", mandatory: DataFrame | None = None, barred: DataFrame | None = None) -> Compilation:
    """nodes: task_id, node_id, uri, kind, content, created_at, trust_domain, sensitivity, instruction_authority, security_sink, semantic_score.
    mandatory and barred: task_id, node_id.

    Nodes are candidates of the task in their ``task_id``, and an edge belongs to each task that has both its ends. Policy and supersession come before
    analysis and token counts; a node that either takes out stays in the graph and isn't eligible, nor is what needs it. A task with a
    blocking action on any of its nodes gets no selection and no text."""
    by, keys = "task_id", ["task_id", "node_id"]
    found = stored(policy.with_signals(nodes))
    links = stored(graph.within_groups(edges, found, by))
    matched = policy.match_rules(found, rules)
    flows = policy.flows(found, links, rules, by)
    both = matched.select(*keys, "rule_id", "action").unionByName(flows.select(*keys, "rule_id", "action"))
    secured = policy.apply_actions(found, policy.decisions(both))
    blocked = stored(secured.where("blocked").select(*keys))
    gone = graph.supersession(links, by)[0].select(*keys)
    if barred is not None:
        gone = gone.unionByName(barred.select(*keys))
    given = [F.coalesce(F.col(c), F.lit("")) if c in tasks.columns else F.lit("") for c in INSTRUCTIONS]
    messages = render.instruction_messages(*given)
    sized = tasks.join(blocked.select(by).distinct(), by, "left_anti").select(by, "terms", *[m.alias(f"m_{role}") for role, m in messages], render.fixed_tokens(messages).alias("overhead"))
    sized = stored(sized.withColumn("allowance", F.greatest(F.lit(0), budget - F.col("overhead"))))
    segment = render.segment(F.col("node_id"), F.col("kind"), F.col("uri"), F.col("content"))
    open_nodes = secured.join(sized, by).join(gone.distinct().withColumn("gone", F.lit(True)), keys, "left")
    analysed = open_nodes.select(*keys, "uri", "content", segment.alias("segment"), tx.token_count(segment).alias("cost"), tx.relevance_by_terms(F.col("content"), F.col("terms")).alias("relevance"), tx.freshness(F.col("created_at"), F.to_timestamp(F.lit(anchor))).alias("freshness"), "semantic_score", "allowance", "overhead", (F.col("eligible") & F.col("gone").isNull()).alias("allowed"))
    valued = stored(analysed.withColumn("value", tx.base_value(relevance=F.col("relevance"), freshness=F.col("freshness"))))
    needs = links.where(F.col("edge_type").isin(*graph.DEPENDENCY)).select(by, "src", "dst")
    deps = needs.where("src <> dst").groupBy(by, F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    none = F.array().cast(f"array<{dict(nodes.dtypes)['node_id']}>")
    items = valued.drop("content", "segment", "overhead").join(deps, keys, "left").withColumn("deps", F.coalesce("deps", none))
    must = mandatory.select(*keys).distinct() if mandatory is not None else None
    if must is not None:
        items = items.join(must.withColumn("mandatory", F.lit(True)), keys, "left").withColumn("mandatory", F.coalesce("mandatory", F.lit(False)))
    done = selection.select(items, by, "allowance", strategy)
    segments = done.chosen.join(valued.select(*keys, "uri", "content", "segment", "cost", "overhead"), keys).withColumn("tokens", F.col("cost"))
    enforced = stored(render.enforce(segments, needs, must if must is not None else segments.select(*keys).limit(0), by, budget, F.col("overhead") + render.ROLE_TOKENS))
    overflow = enforced.where("code = 'CTX510'").select(by).distinct()
    fit = stored(enforced.where("kept").join(overflow, by, "left_anti"))
    used = F.sum("cost").over(selection.Window.partitionBy(by).orderBy("rank").rowsBetween(selection.Window.unboundedPreceding, 0))
    selected = fit.select(*keys, "rank", "cost", used.cast("long").alias("used"))
    context = fit.groupBy(by).agg(render.joined("segment", "rank").alias("context"))
    texts = sized.join(overflow, by, "left_anti").join(context, by, "left")
    text = render.generic_chat([*[(role, F.col(f"m_{role}")) for role, _ in messages], ("user", F.col("context"))])
    rendered = texts.select(by, text.alias("text")).withColumn("tokens", tx.token_count(F.col("text")))
    infeasible = done.record.where("status = 'infeasible'").select(by)
    return Compilation(selected, rendered.join(infeasible, by, "left_anti"), render.source_map(fit, by), policy.diagnostics(found, matched, flows), blocked, done.record, enforced.where("code IS NOT NULL").select(*keys, "kept", "iteration", "tokens_before", "tokens_after", "code"), overflow)
