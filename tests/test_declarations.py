"""Declarations in their three forms, missing fields, and errors as rows."""

import json

import pytest

from sieveline.sources import declarations

TOOL = {"tool_id": "t", "server_id": "s", "trust_domain": "verified_tool", "capabilities": ["file_read"], "resources_read": ["r"], "resources_written": [], "possible_output_sensitivity": "internal", "side_effecting": False, "allows_execution": False, "allows_network": False}
RESOURCE = {"resource_id": "r", "kind": "file", "sensitivity": "secret", "trust_domain": "local_repository", "allowed_sinks": [], "allowed_actions": ["read"]}


def without(raw, *names, **more):
    return {k: v for k, v in raw.items() if k not in names} | more


def scanned(spark, **texts):
    return declarations.scan(spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in texts.items()], "file string, text string"))


def test_three_forms_and_missing_fields(spark):
    tools, resources, errors = scanned(spark, a=[{"type": "tool", **without(TOOL, tool_id="z")}, {"type": "resource", **RESOURCE}], b={"tools": [TOOL, without(TOOL, "possible_output_sensitivity", tool_id="t", side_effecting=None)], "resources": [without(RESOURCE, "allowed_actions", resource_id="q")]}, c=without(RESOURCE, resource_id="solo"), d=without(TOOL, tool_id="one", resources_read=["r", "nowhere"], allows_network="no"), e={"tools": []})
    assert errors.isEmpty()
    assert sorted((r.file, r.place, r.tool_id, r.missing_fields, r.side_effecting) for r in tools.collect()) == [("a", 0, "z", [], False), ("b", 0, "t", [], False), ("b", 1, "t", ["possible_output_sensitivity", "side_effecting"], None), ("d", 0, "one", [], False)]
    assert sorted((r.file, r.resource_id, r.missing_fields) for r in resources.collect()) == [("a", "r", []), ("b", "q", ["allowed_actions"]), ("c", "solo", [])]
    assert tools.where("tool_id = 'one'").first().allows_network is None
    assert {(r.id, r.problem, r.detail) for r in declarations.problems(tools, resources).collect()} == {("t", "duplicate_tool", None), ("t", "missing_field", "possible_output_sensitivity"), ("t", "missing_field", "side_effecting"), ("q", "missing_field", "allowed_actions"), ("one", "undeclared_resource", "nowhere")}


def test_malformed_declarations_are_rows(spark):
    _, _, errors = scanned(spark, a="{", b="3", c={"tools": "bad", "resources": []}, d=["x", without(TOOL, tool_id="")], e=without(TOOL, capabilities="bad"), f=without(RESOURCE, resource_id="", allowed_sinks="bad"), g=without(TOOL, "server_id", resources_read=None))
    assert sorted(((r.file, r.place, r.code) for r in errors.collect()), key=repr) == sorted([("a", None, "not_json"), ("b", None, "not_an_object"), ("c", None, "not_lists"), ("d", 0, "declaration_not_an_object"), ("d", 1, "tool_id"), ("e", 0, "capabilities"), ("f", 0, "resource_id"), ("f", 0, "allowed_sinks"), ("g", 0, "server_id"), ("g", 0, "resources_read")], key=repr)


def test_folders_need_a_tool_and_no_error(spark, tmp_path):
    (tmp_path / "resource.json").write_text(json.dumps(RESOURCE, indent=1))
    with pytest.raises(ValueError):
        declarations.load(spark, str(tmp_path))
    (tmp_path / "tool.json").write_text(json.dumps(TOOL, indent=1))
    tools, resources, found = declarations.load(spark, str(tmp_path))
    assert tools.count() == 1 and resources.count() == 1 and found.isEmpty()
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        declarations.load(spark, str(tmp_path))
