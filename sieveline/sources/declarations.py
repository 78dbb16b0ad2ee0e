"""Declarations of tools and resources as JSON texts, taken apart with VARIANT: a list, an object of ``tools`` and ``resources``, or a single declaration.

A declaration is a resource if its type says so or it has a resource_id, else a tool. Fields that are missing or null are listed with it and
are a diagnostic; what has the wrong form is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.plan_files import kind_of, text_at
from sieveline.store import stored

#: The fields that a declaration should have, the domains of one that names none, and the code of an incomplete one.
TOOL_FIELDS = ("tool_id", "server_id", "trust_domain", "capabilities", "resources_read", "resources_written", "possible_output_sensitivity", "side_effecting", "allows_execution", "allows_network")
RESOURCE_FIELDS = ("resource_id", "kind", "sensitivity", "trust_domain", "allowed_sinks", "allowed_actions")
TOOL_DOMAIN, RESOURCE_DOMAIN, RESOURCE_SENSITIVITY = "unverified_tool", "local_repository", "internal"
INCOMPLETE = "CTX441"
LISTS = {"tool": ("capabilities", "resources_read", "resources_written"), "resource": ("allowed_sinks", "allowed_actions")}
TEXTS = {"tool": ("tool_id", "server_id"), "resource": ("resource_id", "kind")}


def _present(name: str) -> Column:
    return F.coalesce(kind_of(F.try_variant_get("d", f"$.{name}", "variant")), F.lit("VOID")) != "VOID"


def scan(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts: file, text. Tools, resources (each with file, place and missing_fields), and errors (file, place, code)."""
    whole = stored(texts.select("file", F.try_parse_json("text").alias("v")).withColumn("form", kind_of(F.col("v"))))
    at = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    parts = whole.withColumns({"tools": at("tools"), "resources": at("resources")})
    grouped = F.coalesce(F.col("form") == "OBJECT", F.lit(False)) & (F.col("tools").isNotNull() | F.col("resources").isNotNull())
    listed = lambda c: F.coalesce(kind_of(F.col(c)) == "ARRAY", F.lit(False))
    wrong_group = grouped & ((F.col("tools").isNotNull() & ~listed("tools")) | (F.col("resources").isNotNull() & ~listed("resources")))
    items = lambda df, c, kind: df.select("file", F.lit(kind).alias("told"), F.posexplode(F.try_variant_get(c, "$", "array<variant>")).alias("place", "d"))
    single = parts.where((F.col("form") == "OBJECT") & ~grouped).select("file", F.lit(None).cast("string").alias("told"), F.lit(0).alias("place"), F.col("v").alias("d"))
    fine = parts.where(grouped & ~wrong_group)
    every = single.unionAll(items(parts.where("form = 'ARRAY'"), "v", None)).unionAll(items(fine.where(listed("tools")), "tools", "tool")).unionAll(items(fine.where(listed("resources")), "resources", "resource"))
    is_resource = (F.coalesce(text_at(F.col("d"), "$.type"), F.lit("")) == "resource") | F.try_variant_get("d", "$.resource_id", "variant").isNotNull()
    told = stored(every.withColumn("form", kind_of(F.col("d"))).withColumn("kind", F.coalesce("told", F.when(is_resource, "resource").otherwise("tool"))))
    objects = told.where("form = 'OBJECT'")
    checks = []
    for kind in ("tool", "resource"):
        own = F.col("kind") == kind
        checks += [F.when(own & text_at(F.col("d"), f"$.{name}").isNull(), F.lit(name)) for name in TEXTS[kind]]
        absent = lambda name: F.try_variant_get("d", f"$.{name}", "variant").isNull()
        checks += [F.when(own & ~absent(name) & F.coalesce(kind_of(F.try_variant_get("d", f"$.{name}", "variant")) != "ARRAY", F.lit(True)), F.lit(name)) for name in LISTS[kind]]
    marked = stored(objects.withColumn("codes", F.array_compact(F.array(*checks))))
    error = lambda df, code: df.select("file", F.lit(None).cast("int").alias("place"), F.lit(code).alias("code"))
    errors = error(whole.where("v IS NULL"), "not_json").unionAll(error(whole.where("v IS NOT NULL AND coalesce(form, '') NOT IN ('OBJECT', 'ARRAY')"), "not_an_object")).unionAll(error(parts.where(wrong_group), "not_lists"))
    errors = errors.unionAll(told.where("coalesce(form, '') <> 'OBJECT'").select("file", "place", F.lit("declaration_not_an_object"))).unionAll(marked.select("file", "place", F.explode("codes")))
    good = marked.where(F.size("codes") == 0)
    text = lambda name, default=None: F.coalesce(text_at(F.col("d"), f"$.{name}"), F.lit(default)).alias(name)
    array = lambda name: F.coalesce(F.try_variant_get("d", f"$.{name}", "array<string>"), F.array().cast("array<string>")).alias(name)
    flag = lambda name: F.when(kind_of(F.try_variant_get("d", f"$.{name}", "variant")) == "BOOLEAN", F.try_variant_get("d", f"$.{name}", "boolean")).alias(name)
    missing = lambda names: F.array_compact(F.array(*[F.when(~_present(n), F.lit(n)) for n in names])).alias("missing_fields")
    tools = good.where("kind = 'tool'").select("file", "place", text("tool_id"), text("server_id"), text("trust_domain", TOOL_DOMAIN), *map(array, LISTS["tool"]), text("possible_output_sensitivity"), *map(flag, ("side_effecting", "allows_execution", "allows_network")), missing(TOOL_FIELDS))
    resources = good.where("kind = 'resource'").select("file", "place", text("resource_id"), text("kind"), text("sensitivity", RESOURCE_SENSITIVITY), text("trust_domain", RESOURCE_DOMAIN), text("owner"), *map(array, LISTS["resource"]), missing(RESOURCE_FIELDS))
    return tools, resources, errors


def problems(tools: DataFrame, resources: DataFrame) -> DataFrame:
    """id, problem, detail, code: declarations that come twice, lack fields, or name resources that nothing declares."""
    twice = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(name).alias("problem"), F.lit(None).cast("string").alias("detail"))
    lacking = lambda df, key: df.select(F.col(key).alias("id"), F.lit("missing_field"), F.explode("missing_fields"))
    named = tools.select("tool_id", F.explode(F.array_union("resources_read", "resources_written")).alias("resource_id")).distinct()
    undeclared = named.join(resources.select("resource_id"), "resource_id", "left_anti").select(F.col("tool_id").alias("id"), F.lit("undeclared_resource"), "resource_id")
    found = twice(tools, "tool_id", "duplicate_tool").unionAll(twice(resources, "resource_id", "duplicate_resource")).unionAll(lacking(tools, "tool_id")).unionAll(lacking(resources, "resource_id")).unionAll(undeclared)
    return found.withColumn("code", F.lit(INCOMPLETE))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tools, resources and problems of all JSON files below a folder. A malformed declaration, or no tool at all, is an error."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    tools, resources, errors = scan(files)
    wrong = errors.orderBy("file", "place", "code").first()
    if wrong is not None:
        raise ValueError(f"{wrong['file']}: {wrong['code']}")
    if tools.isEmpty():
        raise ValueError("no tool is declared")
    return tools, resources, problems(tools, resources)
