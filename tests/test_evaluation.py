"""Metrics of runs, what manifests and suites must agree on, rule files and the contents of incidents."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import evidence, execution, metrics, policy
from sieveline.sources import incident, rules


def test_run_metrics_and_empty_runs(spark):
    chosen = spark.createDataFrame([("t", "n1", 1, "a.py", 1, 2, 20), ("t", "n2", 2, "a.py", 2, 3, 20), ("t", "n3", 3, "z.py", 1, 1, 10)], "run string, node_id string, rank int, uri string, start_line int, end_line int, tokens int")
    span = "run string, uri string, start_line int, end_line int"
    required = spark.createDataFrame([("t", "a.py", 1, 4), ("none", "b.py", 1, 1)], span)
    accepted = spark.createDataFrame([("t", "c.py", 1, 1)], span)
    needs = spark.createDataFrame([("t", "a.py", "z.py"), ("t", "a.py", "c.py")], "run string, src string, dst string")
    runs = spark.createDataFrame([("t",), ("none",), ("idle",)], "run string")
    found = {r.run: r.asDict() for r in metrics.run_metrics(runs, chosen, required, accepted, needs, "run", 100).collect()}
    assert found["t"] == {"run": "t", "file_recall": 1.0, "file_precision": 0.5, "span_recall": 0.75, "dependency_coverage": 0.5, "useful_ratio": 0.6, "redundant_ratio": 0.2, "unsupported_ratio": 0.2, "budget_use": 0.5}
    assert found["idle"] == {"run": "idle", **metrics.EMPTY}
    assert (found["none"]["file_recall"], found["none"]["span_recall"], found["none"]["file_precision"]) == (0.0, 0.0, 1.0)
    empty = metrics.run_metrics(runs, chosen.limit(0), required.limit(0), accepted.limit(0), needs.limit(0), "run", 100)
    assert all(r.asDict() == {"run": r.run, **metrics.EMPTY} for r in empty.collect())


def manifest(spark, nodes=("a", "b", "c")):
    rows = lambda ids: spark.createDataFrame([(1, n) for n in ids], "build int, node_id string")
    builds = spark.createDataFrame([(1, 100, 80, 60, 40, "p")], "build int, budget int, source_allowance int, before_tokens int, final_tokens int, policy string").withColumn("policy_identity", evidence.policy_identity(F.col("policy")))
    trims = spark.createDataFrame([(1, 1, "c", 60, 40)], "build int, iteration int, node_id string, tokens_before int, tokens_after int")
    codes = spark.createDataFrame([(1, "CTX210", "x")], "build int, code string, node_id string")
    return evidence.Manifest("build", builds, rows(nodes), rows(["a", "b"]), rows(["x"]), rows(["a"]), rows(["b"]), rows([]), rows(["x"]), trims, codes, codes.select("build", "code"))


def test_manifests(spark):
    sealed = manifest(spark).sealed()
    assert evidence.manifest_problems(sealed).count() == 0
    first, second = sealed.builds.first().build_id, manifest(spark, ("c", "b", "a")).sealed().builds.first().build_id
    assert first == second and first.startswith("sha256:")
    found = lambda m: {r.problem for r in evidence.manifest_problems(m).collect()}
    assert found(replace(sealed, builds=sealed.builds.withColumn("budget", F.lit(30)))) == {"build_identity", "final_over_budget", "allowance_over_budget"}
    assert found(replace(sealed, excluded=sealed.excluded.limit(0))) == {"build_identity", "barred_not_excluded", "superseded_not_excluded"}
    assert found(replace(sealed, diagnostics=sealed.diagnostics.limit(0))) == {"build_identity", "security_code_absent"}
    assert found(replace(sealed, trims=sealed.trims.limit(0))) == {"build_identity", "untrimmed_counts"}
    assert found(replace(sealed, blocked=sealed.mandatory)) == {"build_identity", "blocked_node"}
    assert found(replace(manifest(spark), builds=manifest(spark).builds.withColumn("policy", F.lit("q")).withColumn("build_id", F.lit(None).cast("string")))) == {"build_identity", "policy_identity"}
    assert found(replace(sealed, forced=sealed.excluded, mandatory=sealed.excluded)) == {"build_identity", "forced_absent", "mandatory_absent"}


def test_suites(spark):
    calls = spark.createDataFrame([(1, "p", 0, "a", "invoked", False), (1, "p", 1, "b", "blocked", True), (1, "q", 0, "b", "blocked", None), (1, "q", 1, "c", "drifted", True), (2, "r", 0, "a", "stopped", True)], "suite int, plan_id string, place long, call_id string, status string, leaked boolean")
    flows = spark.createDataFrame([(1, "p", "f1", "pending"), (1, "q", "f1", "pending"), (1, "q", "f2", "blocked")], "suite int, plan_id string, flow_id string, status string")
    found = {r.suite: r for r in execution.suite(calls, flows, "suite").collect()}
    assert (found[1].n_plans, found[1].n_passed, found[1].n_invoked, found[1].n_drifted, found[1].n_blocked, found[1].n_blocked_calls, found[1].n_approvals, found[1].n_leaks) == (2, 1, 1, 1, 2, 1, 1, 1)
    assert (found[2].n_passed, found[2].n_stopped, found[2].n_approvals) == (1, 1, 0) and found[1].identity != found[2].identity
    again = {r.suite: r.identity for r in execution.suite(calls.orderBy(F.desc("call_id")).repartition(3), flows, "suite").collect()}
    assert again == {k: r.identity for k, r in found.items()}
    assert execution.suite(calls.limit(0), flows.limit(0), "suite").count() == 0


def test_ground_truth(spark):
    spans = spark.createDataFrame([("t", "a", 1, 3, "why"), ("t", "a", 1, 4, "why"), ("t", "b", 0, 1, " "), ("t", "c", 2, 1, None)], "task string, uri string, start_line int, end_line int, reason string")
    sources = spark.createDataFrame([("a", 3), ("c", 0)], "uri string, n_lines int")
    changed = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "b")], "task string, uri string")
    found = sorted((r.uri, r.end_line, r.problem) for r in metrics.span_problems(spans, sources, changed, "task").collect())
    assert found == [("a", 4, "beyond_source"), ("b", 1, "bad_bounds"), ("b", 1, "no_reason"), ("b", 1, "no_source"), ("b", 1, "unchanged_source"), ("c", 1, "bad_bounds"), ("c", 1, "no_reason"), ("c", 1, "unchanged_source")]
    tasks = spark.createDataFrame([(str(k), k % 2, ["tight"]) for k in range(4)], "task_id string, n_dependencies int, tags array<string>")
    assert {r.problem for r in metrics.suite_problems(tasks, ["tight", "wide"]).collect()} == {"few_tasks", "no_task:wide"}


def test_rule_files():
    text = '[[source_rules]]\nglob = "docs/*"\nsensitivity = "sensitive"\n[[source_rules]]\nglob = "*.key"\ntrust_domain = "external_content"\n'
    assert rules.read_rules(text) == [{"glob": "docs/*", "sensitivity": "sensitive"}, {"glob": "*.key", "trust_domain": "external_content"}] and rules.read_rules("other = 1") == []
    for wrong, told in (('source_rules = 3', "array"), ('source_rules = [3]', "table"), ('[[source_rules]]\nglob = "*"\nowner = "x"', "unknown keys: owner"), ('[[source_rules]]\nglob = 3', "texts: glob"), ('[[source_rules]]\nsensitivity = "secret"', "glob"), ('[[source_rules]]\nglob = "*"\nsensitivity = "public"', "sensitivity")):
        with pytest.raises(ValueError, match=told):
            rules.read_rules(wrong)


def test_incident_contents(spark, tmp_path):
    files = {"a.json": '{"b": 1,\r\n "a": [1, {"d": null, "c": "x"}]}', "b.jsonl": '{"z": 1, "y": true}\n\n [2 , 3]\n', "c.json": "{oops", "d.jsonl": '{"a": 1}\n{', "e.md": '{"b": 1}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    sources = [{"alias": name[0], "path": name, "kind": "document"} for name in files]
    (tmp_path / "incident.json").write_text(json.dumps({"incident_id": "i", "sources": sources, "relationships": []}))
    nodes, _, problems = incident.load(spark, str(tmp_path))
    assert {r.alias: r.content for r in nodes.collect()} == {"a": '{"a":[1,{"c":"x","d":null}],"b":1}', "b": '{"y":true,"z":1}\n[2,3]', "e": '{"b": 1}'}
    assert sorted((r.what, r.alias) for r in problems.collect()) == [("not_json", "c"), ("not_json", "d")]
    with pytest.raises(ValueError, match="revision"):
        incident.load(spark, str(tmp_path), "main")


def test_analysis_and_dominance(spark):
    found = tx.analysis(F.lit("A key, a lock"), F.array(F.lit("key"), F.lit("door")), F.lit(None).cast("timestamp"), F.to_timestamp(F.lit("2024-01-01")))
    row = spark.range(1).select(*[v.alias(k) for k, v in found.items()]).first()
    assert (row.relevance, row.freshness, row.token_count, row.trust, row.risk, row.redundancy) == (0.5, 0.0, 5, 0.0, 0.0, 0.0)
    pair = lambda a, b: spark.range(1).select(policy.dominance(F.lit(a), F.lit(b)).alias("d")).first().d
    assert pair("system_policy", "user_instruction") and pair("tool", "tool") and not pair("user_instruction", "developer_instruction")
