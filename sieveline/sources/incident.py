"""Incident bundles: a manifest names files (sources) and relationships between their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import normalize_newlines
from sieveline.sources.files import discover

MANIFEST = """incident_id string, title string, task string, time_anchor string,
sources array<struct<alias:string,path:string,kind:string,created_at:string,trust_domain:string,sensitivity:string,instruction_authority:string>>,
relationships array<struct<source:string,target:string,type:string,evidence:string>>"""


def canonical_content(path: Column, text: Column) -> Column:
    """JSON files in canonical form (sorted keys, no white space between), line by line where a line is a value; other texts unchanged. Null
    where the JSON can't be read."""
    low, one = F.lower(path), lambda value: F.to_json(F.try_parse_json(value))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line)) > 0), one)
    joined = F.when(~F.exists(lines, lambda line: line.isNull()), F.array_join(lines, "\n"))
    return F.when(low.endswith(".json"), one(text)).when(low.endswith(".jsonl"), joined).otherwise(text)


def load(spark: SparkSession, root: str, revision: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and problems (what, alias): duplicate aliases, files that are missing, outside or no JSON though so named, relationships
    without ends or evidence. A bundle is what it retains: it has no revisions."""
    if revision is not None:
        raise ValueError("an incident has no revisions")
    manifest = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(f"{root}/incident.json")
    sources = manifest.select("incident_id", F.explode("sources").alias("s")).select("incident_id", "s.*")
    files = discover(spark, root, include_hidden=True).select(F.col("path").alias("file"), F.col("content").cast("string").alias("raw"))
    contained = ~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))")
    joined = sources.join(files, (F.col("file") == F.regexp_replace("path", r"^(\./)+", "")) & contained, "left")
    joined = joined.withColumn("content", canonical_content(F.col("path"), normalize_newlines(F.col("raw"))))
    content = F.col("content")
    uri = F.concat(F.lit("incident://"), "incident_id", F.lit("/"), "path")
    identity = F.concat(F.lit("incident-"), F.substring(F.sha2(F.concat_ws("\n", "incident_id", uri, "kind", content), 256), 1, 24))
    nodes = joined.where("content IS NOT NULL").select(
        identity.alias("node_id"), "alias", "kind", uri.alias("uri"), "content", F.to_timestamp("created_at").alias("created_at"),
        F.coalesce("trust_domain", F.lit("retrieved_document")).alias("trust_domain"), F.coalesce("sensitivity", F.lit("internal")).alias("sensitivity"), F.coalesce("instruction_authority", F.lit("none")).alias("instruction_authority"),
    )
    relations = manifest.select(F.explode("relationships").alias("r")).select("r.*")
    ends = nodes.select("alias", "node_id")
    edges = (
        relations.join(ends.select(F.col("alias").alias("source"), F.col("node_id").alias("src")), "source")
        .join(ends.select(F.col("alias").alias("target"), F.col("node_id").alias("dst")), "target")
        .where(F.length(F.trim(F.coalesce("evidence", F.lit("")))) > 0)
        .select("src", "dst", F.col("type").alias("edge_type"), "evidence")
    )
    twice = sources.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_alias").alias("what"), "alias")
    absent = joined.where("raw IS NULL").select(F.lit("no_file"), "alias")
    unread = joined.where("raw IS NOT NULL AND content IS NULL").select(F.lit("not_json"), "alias")
    known = ends.select(F.col("alias").alias("known"))
    loose = relations.select(F.explode(F.array("source", "target")).alias("alias")).join(known, F.col("alias") == F.col("known"), "left_anti").select(F.lit("unknown_alias"), "alias")
    unproven = relations.where(F.length(F.trim(F.coalesce("evidence", F.lit("")))) == 0).select(F.lit("no_evidence"), "source")
    return nodes, edges, twice.unionAll(absent).unionAll(unread).unionAll(loose).unionAll(unproven).distinct()
