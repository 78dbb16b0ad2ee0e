"""Recorded tool results and capability declarations in JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = """server string, tool string, result_id string, trust_domain string, sensitivity string,
content array<struct<node_id:string,text:string,trust_domain:string,sensitivity:string,security_sink:string>>, edges array<struct<source:string,target:string,type:string>>"""
DECLARATION = """tool_id string, server_id string, resource_id string, kind string, trust_domain string, sensitivity string, capabilities array<string>, resources_read array<string>,
resources_written array<string>, possible_output_sensitivity string, allowed_sinks array<string>"""


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (a row for each content item) and the taints and enables edges; a result never has authority."""
    rows = spark.read.schema(RESULT).option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    items = rows.select("*", F.posexplode("content").alias("place", "c"))
    uri = F.concat(F.lit("mcp://"), "server", F.lit("/tools/"), "tool", F.lit("/results/"), "result_id")
    name = F.coalesce("c.node_id", F.format_string("mcp-%s-%04d", "result_id", "place"))
    nodes = items.select(
        name.alias("node_id"), F.lit("tool_result").alias("kind"), uri.alias("uri"), F.col("c.text").alias("content"),
        F.coalesce("c.trust_domain", "trust_domain", F.lit("unverified_tool")).alias("trust_domain"), F.coalesce("c.sensitivity", "sensitivity", F.lit("public")).alias("sensitivity"),
        F.lit("none").alias("instruction_authority"), F.col("c.security_sink").alias("security_sink"),
    )
    edges = rows.select(F.explode("edges").alias("e")).where("e.type IN ('taints', 'enables')").select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("edge_type"))
    return nodes, edges


def load_declarations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tools, resources, and problems (code, id): duplicate ids, resources that tools name and nothing declares (CTX441)."""
    rows = spark.read.schema(DECLARATION).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    tools, resources = rows.where("tool_id IS NOT NULL").drop("resource_id"), rows.where("tool_id IS NULL AND resource_id IS NOT NULL").select("resource_id", "kind", "sensitivity", "trust_domain", "allowed_sinks")
    named = tools.select(F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("resources_read", "resources_written")])).alias("resource_id")).distinct()
    twice = rows.groupBy(F.coalesce("tool_id", "resource_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("code"), "id")
    return tools, resources, twice.unionAll(named.join(resources, "resource_id", "left_anti").select(F.lit("CTX441"), "resource_id"))
