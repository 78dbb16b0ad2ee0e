"""Capability plans as JSON texts, taken apart with VARIANT: calls, bindings, and every structural error as a row.

A text that is no JSON object gives its error alone; other errors don't stop what can be read. Places count from 0. A call without an id or a
tool gets the name ``<invalid-call-N>`` or ``<invalid-tool-N>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.store import stored

#: Fixed value: the version of plans that is understood.
MAJOR, MINOR = 1, 0
RESOURCE, CALL = "resource:", "call:"


@dataclass
class Plans:
    """plans: file, plan_id. calls: file, place, call_id, tool_id, n_literals, approvals. bindings: file, place, call_id, input_name, kind (resource,
    call_output), resource_id, source_call, output_name. errors: file, place, input_name, code."""

    plans: DataFrame
    calls: DataFrame
    bindings: DataFrame
    errors: DataFrame


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def text_at(value: Column, path: str) -> Column:
    """The string at a path; null where it's missing, empty or something else."""
    inner = F.try_variant_get(value, path, "variant")
    return F.when(kind_of(inner) == "STRING", F.nullif(F.try_variant_get(value, path, "string"), F.lit("")))


def _is(value: Column, kind: str) -> Column:
    """Whether it has that kind; a missing one counts."""
    return value.isNull() | (kind_of(value) == kind)


def scan(texts: DataFrame) -> Plans:
    """texts: file, text."""
    whole = stored(texts.select("file", F.try_parse_json("text").alias("v")).withColumn("kind", kind_of(F.col("v"))))
    fine = whole.where("kind = 'OBJECT'")
    at = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    read = stored(fine.select("file", text_at(F.col("v"), "$.plan_id").alias("plan_id"), at("schema_version").alias("version"), at("calls").alias("calls")))
    error = lambda df, condition, code, place=None, name=None: df.where(F.coalesce(condition, F.lit(True))).select("file", (F.lit(None) if place is None else F.col(place)).cast("int").alias("place"), (F.lit(None) if name is None else F.col(name)).cast("string").alias("input_name"), F.lit(code).alias("code"))
    number = lambda name: F.try_variant_get("version", f"$.{name}", "int")
    version = F.col("version")
    is_list = kind_of(F.col("calls")) == "ARRAY"
    errors = [
        error(whole, F.col("v").isNull(), "not_json"), error(whole.where("v IS NOT NULL"), F.col("kind") != "OBJECT", "not_an_object"),
        error(read, F.col("plan_id").isNull(), "plan_id"), error(read, version.isNull(), "no_schema_version"), error(read.where("version IS NOT NULL"), kind_of(version) != "OBJECT", "schema_version_not_an_object"),
        error(read.where(kind_of(version) == "OBJECT"), ~((number("major") == MAJOR) & (number("minor") == MINOR)), "schema_version_unknown"), error(read, ~F.coalesce(is_list, F.lit(False)), "calls_not_a_list"),
    ]
    items = read.where(is_list).select("file", F.posexplode(F.try_variant_get("calls", "$", "array<variant>")).alias("place", "c"))
    of = lambda name: F.try_variant_get("c", f"$.{name}", "variant")
    objects = stored(items.where(kind_of(F.col("c")) == "OBJECT").select("file", "place", text_at(F.col("c"), "$.call_id").alias("call_id"), text_at(F.col("c"), "$.tool_id").alias("tool_id"), of("input_bindings").alias("bindings"), of("literal_inputs").alias("literals"), of("requested_approvals").alias("approvals")))
    errors += [
        error(items, kind_of(F.col("c")) != "OBJECT", "call_not_an_object", "place"), error(objects, F.col("call_id").isNull(), "call_id", "place"), error(objects, F.col("tool_id").isNull(), "tool_id", "place"),
        error(objects, ~_is(F.col("bindings"), "OBJECT"), "bindings_not_an_object", "place"), error(objects, ~_is(F.col("literals"), "OBJECT"), "literals_not_an_object", "place"), error(objects, ~_is(F.col("approvals"), "ARRAY"), "approvals_not_a_list", "place"),
    ]
    invalid = lambda name, what: F.coalesce(F.col(name), F.concat(F.lit(f"<invalid-{what}-"), F.col("place").cast("string"), F.lit(">")))
    size = F.coalesce(F.size(F.when(kind_of(F.col("literals")) == "OBJECT", F.try_variant_get("literals", "$", "map<string,variant>"))), F.lit(0))
    listed = F.coalesce(F.when(kind_of(F.col("approvals")) == "ARRAY", F.try_variant_get("approvals", "$", "array<string>")), F.array().cast("array<string>"))
    calls = objects.select("file", "place", invalid("call_id", "call").alias("call_id"), invalid("tool_id", "tool").alias("tool_id"), size.cast("long").alias("n_literals"), listed.alias("approvals"))
    named = objects.where(kind_of(F.col("bindings")) == "OBJECT").select("file", "place", invalid("call_id", "call").alias("call_id"), F.explode(F.try_variant_get("bindings", "$", "map<string,variant>")).alias("input_name", "b"))
    is_text, is_object = kind_of(F.col("b")) == "STRING", kind_of(F.col("b")) == "OBJECT"
    plain = F.when(is_text, F.try_variant_get("b", "$", "string"))
    typed = lambda path: F.when(is_object & (kind_of(F.try_variant_get("b", path, "variant")) == "STRING"), F.try_variant_get("b", path, "string"))
    after = F.substr(plain, F.lit(len(CALL) + 1))
    dotted = F.instr(after, ".")
    resource = F.coalesce(F.when(plain.startswith(RESOURCE), F.substr(plain, F.lit(len(RESOURCE) + 1))), typed("$.resource_id"))
    source = F.coalesce(F.when(plain.startswith(CALL), F.when(dotted > 0, F.left(after, dotted - 1)).otherwise(after)), typed("$.call_id"))
    output = F.coalesce(F.when(plain.startswith(CALL) & (dotted > 0), F.nullif(F.substr(after, dotted + 1), F.lit(""))), typed("$.output"), F.lit("output"))
    told = stored(named.select("file", "place", "call_id", "input_name", resource.alias("resource_id"), source.alias("source_call"), output.alias("output_name")))
    kind = F.when(F.col("resource_id").isNotNull(), "resource").when(F.col("source_call").isNotNull(), "call_output")
    marked = told.withColumn("kind", kind)
    errors.append(error(marked, F.col("kind").isNull(), "binding", "place", "input_name"))
    linked = F.col("kind") == "call_output"
    bindings = marked.where("kind IS NOT NULL").select("file", "place", "call_id", "input_name", "kind", "resource_id", F.when(linked, F.col("source_call")).alias("source_call"), F.when(linked, F.col("output_name")).alias("output_name"))
    found = errors[0]
    for more in errors[1:]:
        found = found.unionAll(more)
    return Plans(read.select("file", F.coalesce("plan_id", F.lit("<invalid-plan-id>")).alias("plan_id")), calls, bindings, found)


def reference_errors(plans: Plans, tools: DataFrame, resources: DataFrame) -> DataFrame:
    """file, place, input_name, code: calls of unknown tools, bindings to unknown resources and to calls that don't come before, and call ids that come twice.
    tools: tool_id; resources: resource_id."""
    none = lambda kind: F.lit(None).cast(kind)
    unknown_tool = plans.calls.join(tools.select("tool_id").distinct(), "tool_id", "left_anti").select("file", "place", none("string").alias("input_name"), F.lit("unknown_tool").alias("code"))
    unknown = plans.bindings.where("kind = 'resource'").join(resources.select("resource_id").distinct(), "resource_id", "left_anti").select("file", "place", "input_name", F.lit("unknown_resource"))
    before = plans.calls.select("file", F.col("call_id").alias("source_call"), F.col("place").alias("source_place")).groupBy("file", "source_call").agg(F.min("source_place").alias("source_place"))
    later = plans.bindings.where("kind = 'call_output'").join(before, ["file", "source_call"], "left").where("source_place IS NULL OR source_place >= place").select("file", "place", "input_name", F.when(F.col("source_place").isNull(), "unknown_call").otherwise("call_not_before").alias("code"))
    twice = plans.calls.groupBy("file", "call_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = plans.calls.join(twice, ["file", "call_id"]).where("place > first").select("file", "place", none("string"), F.lit("duplicate_call"))
    return unknown_tool.unionAll(unknown).unionAll(later).unionAll(repeated)


#: Fixed value: the domain of an approver who names none.
APPROVER_DOMAIN = "user_instruction"
NAMED = ("approval_id", "plan_id", "flow_identity", "approver_identity")


def scan_approvals(texts: DataFrame, domains: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """texts: file, text. file, approval_id, plan_id, flow_identity, approver_identity, approver_domain, approved, evidence_uri of the approvals without errors; and file, code for
    each error: not_json, not_an_object, the name of a field that isn't a text (a boolean, for approved), unknown_domain (not one of ``domains``)."""
    whole = texts.select("file", F.try_parse_json("text").alias("v")).withColumn("kind", kind_of(F.col("v")))
    at = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    kind = lambda name: F.coalesce(kind_of(at(name)), F.lit("VOID"))
    domain = F.when(kind("approver_trust_domain") == "VOID", APPROVER_DOMAIN).otherwise(F.coalesce(text_at(F.col("v"), "$.approver_trust_domain"), F.lit("")))
    fine = F.col("kind") == "OBJECT"
    found = {"not_json": F.col("v").isNull(), "not_an_object": F.col("v").isNotNull() & ~F.coalesce(fine, F.lit(False))}
    inside = {name: text_at(F.col("v"), f"$.{name}").isNull() for name in NAMED} | {"approved": kind("approved") != "BOOLEAN", "evidence_uri": ~kind("evidence_uri").isin("VOID", "STRING"), "unknown_domain": ~domain.isin(*domains)}
    tests = [F.when(condition, F.lit(code)) for code, condition in found.items()] + [F.when(fine & condition, F.lit(code)) for code, condition in inside.items()]
    told = stored(whole.select("file", F.array_compact(F.array(*tests)).alias("codes"), *[text_at(F.col("v"), f"$.{name}").alias(name) for name in NAMED], domain.alias("approver_domain"), F.try_variant_get("v", "$.approved", "boolean").alias("approved"), F.try_variant_get("v", "$.evidence_uri", "string").alias("evidence_uri")))
    return told.where(F.size("codes") == 0).drop("codes"), told.select("file", F.explode("codes").alias("code"))
