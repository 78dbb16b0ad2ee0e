"""Sources by name, so that a compilation takes any: each gives nodes, edges and diagnostics or problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources import decoding, files, incident, tool_results
from sieveline.sources.rules import apply_rules

Adapter = Callable[[SparkSession, str], tuple[DataFrame, DataFrame, DataFrame]]
#: What nodes of a source are unless it or a rule says otherwise.
DEFAULTS = {"trust_domain": "local_repository", "sensitivity": "internal", "instruction_authority": "none"}
TASK, LABELS = "task_id string, task string, token_budget int, root string", "task_id string, required array<struct<uri:string,start_line:int,end_line:int>>"


def _repository(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, diagnostics = files.parse(files.discover(spark, root))
    return nodes, files.code_edges(nodes), diagnostics


def _tool_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = tool_results.load_results(spark, root)
    return nodes, edges, nodes.select(F.lit(None).cast("string").alias("code"), F.col("uri").alias("path")).limit(0)


ADAPTERS: dict[str, Adapter] = {"repository": _repository, "incident": incident.load, "tool_results": _tool_results}


def load(spark: SparkSession, adapter: str, root: str, rules: list[dict[str, str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (with the facts that the rules set), edges and problems of a source."""
    if adapter not in ADAPTERS:
        raise ValueError(f"no source adapter {adapter}; there are {sorted(ADAPTERS)}")
    nodes, edges, problems = ADAPTERS[adapter](spark, root)
    if rules:
        own = {fact: F.col(fact) for fact in DEFAULTS if fact in nodes.columns}
        nodes = apply_rules(nodes.drop(*own), rules, DEFAULTS)
    return nodes, edges, problems


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """A policy file (JSON with comment lines) as rows of rules."""
    from sieveline.operators.policy import RULE

    return decoding.read_commented(spark, path, f"rules array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>").select(F.explode("rules").alias("r")).select("r.*")


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """The public part of benchmark tasks: <root>/<task>/public/task.yaml, written as JSON."""
    return spark.read.schema(TASK).option("multiLine", "true").option("mode", "FAILFAST").json(f"{root}/*/public/task.yaml")


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """The evaluator's part, read by evaluation only: <root>/<task>/evaluator/labels.yaml."""
    return spark.read.schema(LABELS).option("multiLine", "true").option("mode", "FAILFAST").json(f"{root}/*/evaluator/labels.yaml")
