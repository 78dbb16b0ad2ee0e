"""Plans as JSON: both forms of bindings, and every structural error as a row."""

import json

from sieveline.sources import plan_files

VERSION = {"major": 1, "minor": 0}


def scanned(spark, **texts):
    return plan_files.scan(spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in texts.items()], "file string, text string"))


def errors(plans):
    return sorted(((r.file, r.place, r.input_name, r.code) for r in plans.errors.collect()), key=repr)


def test_both_forms_of_bindings(spark):
    calls = [
        {"call_id": "one", "tool_id": "reader", "input_bindings": {"r": {"resource_id": "r"}, "s": "resource:s"}, "literal_inputs": {"x": 1, "y": {"z": 2}}, "requested_approvals": ["ticket-1"]},
        {"call_id": "two", "tool_id": "sender", "input_bindings": {"v": {"call_id": "one", "output": "value"}, "w": "call:one.value.deep", "x": "call:one", "y": "call:one.", "z": {"call_id": "one"}}},
    ]
    plans = scanned(spark, a={"schema_version": VERSION, "plan_id": "p", "calls": calls}, b={"schema_version": VERSION, "plan_id": "empty", "calls": []})
    assert errors(plans) == [] and {(r.file, r.plan_id) for r in plans.plans.collect()} == {("a", "p"), ("b", "empty")}
    assert [(r.place, r.call_id, r.tool_id, r.n_literals, r.approvals) for r in plans.calls.orderBy("place").collect()] == [(0, "one", "reader", 2, ["ticket-1"]), (1, "two", "sender", 0, [])]
    assert {(r.call_id, r.input_name, r.kind, r.resource_id, r.source_call, r.output_name) for r in plans.bindings.collect()} == {
        ("one", "r", "resource", "r", None, None), ("one", "s", "resource", "s", None, None), ("two", "v", "call_output", None, "one", "value"), ("two", "w", "call_output", None, "one", "value.deep"),
        ("two", "x", "call_output", None, "one", "output"), ("two", "y", "call_output", None, "one", "output"), ("two", "z", "call_output", None, "one", "output"),
    }


def test_every_structural_error_is_a_row(spark):
    bad = [{"call_id": "x", "tool_id": "reader", "input_bindings": {"v": "nonsense", "n": 3, "o": {"resource_id": 5}}, "literal_inputs": [], "requested_approvals": "bad"}, "not-an-object", {"call_id": "", "input_bindings": []}, {"tool_id": 7, "call_id": "y"}]
    plans = scanned(spark, a="{", b="[]", c="3", d={"plan_id": "p", "calls": "none"}, e={"plan_id": "", "schema_version": "1.0", "calls": bad}, f={"plan_id": 4, "schema_version": {"major": 2, "minor": 0}}, g=None, h={"plan_id": "p", "schema_version": {"major": 1}, "calls": []})
    assert errors(plans) == sorted(
        [
            ("a", None, None, "not_json"), ("b", None, None, "not_an_object"), ("c", None, None, "not_an_object"), ("d", None, None, "no_schema_version"), ("d", None, None, "calls_not_a_list"), ("e", None, None, "plan_id"), ("e", None, None, "schema_version_not_an_object"),
            ("e", 0, "n", "binding"), ("e", 0, "o", "binding"), ("e", 0, "v", "binding"), ("e", 0, None, "literals_not_an_object"), ("e", 0, None, "approvals_not_a_list"), ("e", 1, None, "call_not_an_object"), ("e", 2, None, "call_id"), ("e", 2, None, "tool_id"), ("e", 2, None, "bindings_not_an_object"), ("e", 3, None, "tool_id"),
            ("f", None, None, "plan_id"), ("f", None, None, "schema_version_unknown"), ("f", None, None, "calls_not_a_list"), ("g", None, None, "not_json"), ("h", None, None, "schema_version_unknown"),
        ], key=repr)
    assert {(r.place, r.call_id, r.tool_id) for r in plans.calls.where("file = 'e'").collect()} == {(0, "x", "reader"), (2, "<invalid-call-2>", "<invalid-tool-2>"), (3, "y", "<invalid-tool-3>")}
    assert scanned(spark, a="{").calls.isEmpty()


def test_references_are_checked(spark):
    calls = [{"call_id": "one", "tool_id": "t", "input_bindings": {"a": "resource:r", "b": "resource:q", "c": "call:two", "d": "call:one", "e": "call:zero"}}, {"call_id": "two", "tool_id": "u", "input_bindings": {"a": "call:one"}}, {"call_id": "one", "tool_id": "t"}]
    plans = scanned(spark, p={"schema_version": VERSION, "plan_id": "p", "calls": calls})
    found = plan_files.reference_errors(plans, spark.createDataFrame([("t",)], "tool_id string"), spark.createDataFrame([("r",)], "resource_id string"))
    assert {(r.place, r.input_name, r.code) for r in found.collect()} == {(0, "b", "unknown_resource"), (0, "c", "call_not_before"), (0, "d", "call_not_before"), (0, "e", "unknown_call"), (1, None, "unknown_tool"), (2, None, "duplicate_call")}


def test_approvals_and_their_errors(spark):
    base = {"approval_id": "a", "plan_id": "p", "flow_identity": "f", "approver_identity": "user:x", "approver_trust_domain": "user_instruction", "approved": True}
    rows = {"ok": base, "bare": {k: v for k, v in base.items() if k != "approver_trust_domain"} | {"approved": False, "evidence_uri": None}, "uri": base | {"evidence_uri": "u"}, "list": [], "cut": "{", "few": {"approval_id": "x"}, "yes": base | {"approved": "yes"}, "number": base | {"evidence_uri": 123}, "who": base | {"approver_trust_domain": "nobody", "plan_id": ""}}
    texts = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in rows.items()], "file string, text string")
    good, wrong = plan_files.scan_approvals(texts, ("user_instruction", "system_policy"))
    assert {(r.file, r.approver_domain, r.approved, r.evidence_uri) for r in good.collect()} == {("ok", "user_instruction", True, None), ("bare", "user_instruction", False, None), ("uri", "user_instruction", True, "u")}
    found = {}
    for r in wrong.collect():
        found.setdefault(r.file, set()).add(r.code)
    assert found == {"list": {"not_an_object"}, "cut": {"not_json"}, "few": {"plan_id", "flow_identity", "approver_identity", "approved"}, "yes": {"approved"}, "number": {"evidence_uri"}, "who": {"unknown_domain", "plan_id"}}
