"""A persisted graph with what a compilation decided: exported once, then compared and explained without its sources and without selecting again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import evidence
from sieveline.operators.stores import Tables

#: The version of the tables below; a reader takes artifacts of its own major version.
MAJOR, MINOR = 1, 0
SCHEMAS = {
    "nodes": "node_id string, kind string, uri string, content_hash string",
    "edges": "src string, dst string, edge_type string",
    "decisions": "node_id string, rank long, reason string",
    "codes": "node_id string, code string",
    "facts": "name string, value string",
}


def export(spark: SparkSession, path: str, parts: dict[str, DataFrame], facts: dict[str, str]) -> int:
    """Adds a version of the artifact: nodes, edges, decisions (a rank for what was chosen, a reason for what wasn't), codes, and facts such as
    the task and the budget. Earlier versions stay readable."""
    tables = Tables(spark, path, SCHEMAS)
    told = spark.createDataFrame(sorted({**facts, "schema": f"{MAJOR}.{MINOR}"}.items()), SCHEMAS["facts"])
    version = tables.version()
    return tables.commit(version, {**parts, "facts": told}, tables.state(version))


def read(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    tables = Tables(spark, path, SCHEMAS)
    version = tables.version() if version is None else version
    found = {name: tables.read(name, version) for name in SCHEMAS}
    row = found["facts"].where("name = 'schema'").first()
    if row is None or int(row["value"].split(".")[0]) != MAJOR:
        raise ValueError(f"no artifact of version {MAJOR}: {row and row['value']}")
    return found


def fingerprint(artifact: dict[str, DataFrame]) -> DataFrame:
    """One row, fingerprint: of all tables as sets of rows."""
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(df.columns))).alias("row")) for name, df in sorted(artifact.items())]
    return evidence.identity(reduce(DataFrame.unionAll, rows), "part", "row").select(F.col("identity").alias("fingerprint"))


def compare(one: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """part, only_first, only_second for each table, and a row 'whole' that is 0 and 0 exactly if the fingerprints are one."""
    parts = [evidence.differences(one[name], other[name]).select(F.lit(name).alias("part"), "only_first", "only_second") for name in SCHEMAS]
    unlike = (F.col("fingerprint") != F.col("other")).cast("long")
    whole = fingerprint(one).crossJoin(fingerprint(other).withColumnRenamed("fingerprint", "other"))  # one row each
    return reduce(DataFrame.unionAll, [*parts, whole.select(F.lit("whole").alias("part"), unlike.alias("only_first"), unlike.alias("only_second"))])


def explain(artifact: dict[str, DataFrame]) -> DataFrame:
    """node_id, status, reason, codes, related of every node, from what is stored."""
    decided = artifact["decisions"]
    return evidence.explain(artifact["nodes"], decided.where("rank IS NOT NULL"), decided.where("rank IS NULL").select("node_id", "reason"), artifact["codes"], artifact["edges"])
