"""Evidence of a build: manifest, commit, verification against the sources as they are now, rebuild, consistency, explanation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.operators.graph import neighbours
from sieveline.operators.incremental import differences, snapshot_diff
from sieveline.store import stored

MANIFEST = "_manifest"


def identity(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a hash of the rows as a set, whatever their order or partitions, and their number."""
    row_hash = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    parts = [F.sum(F.conv(F.substring(row_hash, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]
    return rows.agg(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts], F.count(F.lit(1)).cast("string")), 256)).alias("identity"), F.count(F.lit(1)).alias("n_rows"))


def prints(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """by, print: a hash of each group's rows as a set, as ``identity`` gives for all rows."""
    row_hash = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    parts = [F.sum(F.conv(F.substring(row_hash, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]
    return rows.groupBy(by).agg(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts], F.count(F.lit(1)).cast("string")), 256).alias("print"))


def commit(artifact: DataFrame, nodes: DataFrame, path: str, **facts: str) -> None:
    """Writes a build into a folder of its own, then the manifest that names it. Readers see the build before until the new
    manifest stands; a build without a manifest is none, whatever stopped it."""
    spark, build = artifact.sparkSession, uuid.uuid4().hex
    artifact.write.parquet(f"{path}/builds/{build}/artifact")
    nodes.select("node_id", "content_hash").write.parquet(f"{path}/builds/{build}/nodes")
    kept = spark.read.parquet(f"{path}/builds/{build}/artifact")
    row = identity(kept, *kept.columns).select(F.unix_micros(F.current_timestamp()).alias("committed"), F.lit(build).alias("build"), "*", *[F.lit(v).alias(k) for k, v in sorted(facts.items())])
    row.coalesce(1).write.mode("append").json(f"{path}/{MANIFEST}")


def latest(spark: SparkSession, path: str) -> dict:
    """The manifest of the last committed build."""
    return spark.read.json(f"{path}/{MANIFEST}").orderBy(F.desc("committed"), "build").first().asDict()


def read_build(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Artifact, nodes and manifest of the last committed build."""
    manifest = latest(spark, path)
    folder = f"{path}/builds/{manifest['build']}"
    return spark.read.parquet(f"{folder}/artifact"), spark.read.parquet(f"{folder}/nodes"), manifest


def verify(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """code, node_id: CTX610 where the artifact isn't the one of the manifest, CTX600 for each node that differs now."""
    artifact, nodes, manifest = read_build(spark, path)
    changed = identity(artifact, *artifact.columns).where(F.col("identity") != manifest["identity"]).select(F.lit("CTX610").alias("code"), F.lit(None).cast("string").alias("node_id"))
    drift = snapshot_diff(nodes, current.select("node_id", "content_hash"), "node_id").where("status <> 'unchanged'")
    return changed.unionAll(drift.select(F.lit("CTX600"), F.col("node_id").cast("string")))


def rebuild(spark: SparkSession, path: str, current: DataFrame, build_again: Callable[[], DataFrame], **facts: str) -> DataFrame:
    """Verifies the last build against the sources and the wanted facts, builds again, and commits if nothing differs.

    Returns what differs: codes of the verification, CTX720 for each fact that isn't the recorded one, CTX700 for rows that
    only one of the two artifacts has."""
    artifact, nodes, manifest = read_build(spark, path)
    again = build_again()
    facts_now = [k for k, v in sorted(facts.items()) if manifest.get(k) != v]
    other = spark.createDataFrame([("CTX720", k) for k in facts_now], "code string, node_id string")
    counts = differences(artifact, again).select(F.explode(F.array("only_first", "only_second")).alias("n")).where("n > 0")
    found = stored(verify(spark, path, current).unionAll(other).unionAll(counts.select(F.lit("CTX700"), F.lit(None).cast("string"))))
    if found.isEmpty():
        commit(again, current, path, **facts)
    return found


@dataclass
class Manifest:
    """What builds record of themselves, for many builds at once (``by`` names the build in every table).

    builds: by, budget, source_allowance, before_tokens, final_tokens, policy (its text), policy_identity and, once sealed, build_id. The sets hold by, node_id:
    selected (by the optimizer), final (emitted), excluded, mandatory, forced (by dependencies), blocked and barred (by security).
    trims: by, iteration, node_id, tokens_before, tokens_after, a row for each removed node. diagnostics: by, code, node_id.
    security_codes: by, code."""

    by: str
    builds: DataFrame
    selected: DataFrame
    final: DataFrame
    excluded: DataFrame
    mandatory: DataFrame
    forced: DataFrame
    blocked: DataFrame
    barred: DataFrame
    trims: DataFrame
    diagnostics: DataFrame
    security_codes: DataFrame

    def identities(self) -> DataFrame:
        """by, due_id: a hash of everything recorded of each build but its id, whatever the order of rows."""
        facts = self.builds.drop("build_id")
        parts = {"builds": facts} | {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("by", "builds")}
        printed = [prints(df, self.by, *df.columns).select(self.by, F.lit(name).alias("part"), "print") for name, df in parts.items()]
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "print"))), lambda x: F.concat_ws("=", x["part"], x["print"])), ",")
        return reduce(DataFrame.unionAll, printed).groupBy(self.by).agg(F.concat(F.lit("sha256:"), F.sha2(listed, 256)).alias("due_id"))

    def sealed(self) -> Manifest:
        """The same with each build's id."""
        facts = self.builds.drop("build_id")
        return replace(self, builds=stored(facts.join(self.identities().withColumnRenamed("due_id", "build_id"), self.by)))


def policy_identity(policy: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(policy, 256))


def manifest_problems(m: Manifest) -> DataFrame:
    """by, problem, n: where the parts of a sealed manifest contradict each other, seventeen ways."""
    by, keys = m.by, [m.by, "node_id"]
    counted = lambda df, name: df.groupBy(by).agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    flagged = lambda df, condition, name: df.where(condition).select(by, F.lit(name).alias("problem"), F.lit(1).cast("long").alias("n"))
    missing = lambda df, within, name, on=keys: counted(df.select(*on).distinct().join(within, on, "left_anti"), name)
    order = Window.partitionBy(by).orderBy("iteration")
    steps = m.trims.select(by, "iteration", "tokens_before", "tokens_after").distinct()
    chained = steps.join(m.builds.select(by, "before_tokens", "final_tokens"), by).withColumns({"place": F.row_number().over(order), "due": F.coalesce(F.lag("tokens_after").over(order), "before_tokens"), "next": F.lead("iteration").over(order)})
    trimmed, removed = m.trims.select(*keys), m.selected.select(*keys).join(m.final, keys, "left_anti")
    untrimmed = m.builds.join(steps.select(by).distinct(), by, "left_anti")
    superseded = m.diagnostics.where("code = 'CTX210' AND node_id IS NOT NULL")
    # the delta is compared in builds that trimmed; the others are held by their counts
    delta = removed.join(steps.select(by).distinct(), by, "left_semi")
    return reduce(
        DataFrame.unionAll,
        [
            flagged(m.builds.join(m.identities(), by, "left"), ~F.col("build_id").eqNullSafe(F.col("due_id")), "build_identity"),
            flagged(m.builds, "final_tokens > budget", "final_over_budget"),
            flagged(m.builds, "source_allowance > budget", "allowance_over_budget"),
            missing(m.final, m.selected, "final_unselected"),
            missing(m.forced, m.selected, "forced_absent"),
            missing(m.mandatory, m.final, "mandatory_absent"),
            counted(m.excluded.select(*keys).distinct().join(m.selected, keys, "left_semi"), "excluded_selected"),
            flagged(m.builds, ~F.col("policy_identity").eqNullSafe(policy_identity(F.col("policy"))), "policy_identity"),
            counted(m.blocked.select(*keys).distinct(), "blocked_node"),
            missing(m.barred, m.excluded, "barred_not_excluded"),
            missing(m.security_codes, m.diagnostics, "security_code_absent", [by, "code"]),
            missing(superseded, m.excluded, "superseded_not_excluded"),
            counted(chained.where("iteration <> place"), "trim_gap"),
            counted(chained.where("tokens_before <> due"), "trim_chain"),
            counted(chained.where("next IS NULL AND tokens_after <> final_tokens"), "trim_end"),
            counted(trimmed.exceptAll(delta).unionAll(delta.exceptAll(trimmed)), "trim_delta"),
            flagged(untrimmed, "before_tokens <> final_tokens", "untrimmed_counts"),
        ],
    )


def explain(nodes: DataFrame, selected: DataFrame, reasons: DataFrame, codes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, status, reason, codes, related: what the stored evidence says of each node; nothing is selected again.

    nodes: node_id; selected: node_id; reasons: node_id, reason of those left out; codes: node_id, code; edges: src, dst."""
    one = lambda df, name: df.withColumnRenamed("node_id", f"{name}_node")
    around = neighbours(edges).where("neighbour <> node_id").groupBy("node_id").agg(F.array_sort(F.collect_set("neighbour")).alias("related"))
    coded = codes.groupBy("node_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    chosen = selected.select("node_id", F.lit(True).alias("chosen")).distinct()
    joined = nodes.select("node_id")
    for name, part in (("s", chosen), ("r", reasons), ("c", coded), ("n", around)):
        joined = joined.join(one(part, name), F.col("node_id") == F.col(f"{name}_node"), "left").drop(f"{name}_node")
    status = F.when(F.col("chosen"), "included").when(F.col("reason").isNotNull(), "excluded").otherwise("unknown")
    return joined.select("node_id", status.alias("status"), F.when(F.col("chosen"), None).otherwise(F.col("reason")).alias("reason"), "codes", "related")
