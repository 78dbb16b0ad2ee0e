"""Evidence about selections: why a node was left out, what retrieval ranked, the simple baseline, and rollups over sources."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import artifact, evidence, graph, incremental, metrics, selection
from sieveline.plans import selection_plans as sp
from sieveline.plans.metric_plans import _SPANS, spans
from sieveline.plans.text_plans import _RELEVANCE, TERMS, TOKENS_SQL
from sieveline.queries import query
from sieveline.sources import decoding, tables
from sieveline.store import read_table, shared_dir, stored

_WALKED = f"{sp._ITEMS}, {sp._walk('i', 'lang', sp._STABLE.format('relevance'), sp.ALLOWANCE)}"


@query(f"""WITH RECURSIVE {_WALKED} SELECT i0.lang, CASE WHEN i0.copy > 1 THEN 'superseded' WHEN s.node_id IS NOT NULL THEN 'selected' WHEN i0.cost > {sp.ALLOWANCE} THEN 'infeasible_constraints' ELSE 'not_selected_under_objective' END AS reason, count(*) AS n_nodes
FROM i0 LEFT JOIN s ON s.lang = i0.lang AND s.node_id = i0.node_id GROUP BY ALL""")
def selection_reasons(spark, sf_dir):
    """Every document's reason, from stored evidence: the copies' edges, the costs and the walk."""
    rows = sp.items(spark, sf_dir)
    chosen = selection.relevance_greedy(rows, "lang", sp.ALLOWANCE).select(F.col("node_id").alias("chosen_id"))
    reason = F.when(F.col("chosen_id").isNotNull(), "selected").when(F.col("cost") > sp.ALLOWANCE, "infeasible_constraints").otherwise("not_selected_under_objective")
    kept = rows.join(chosen, F.col("node_id") == F.col("chosen_id"), "left").select("lang", reason.alias("reason"))
    gone = graph.supersession(tables.copy_edges(spark, sf_dir))[0].select(F.col("node_id").alias("doc_id"))
    copies = read_table(spark, sf_dir, "documents").join(gone, "doc_id", "left_semi").select("lang", F.lit("superseded"))
    return kept.unionAll(copies).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""WITH {_SPANS}, n AS (SELECT DISTINCT uri, unnest(range(start_line, end_line + 1)) AS line FROM req), k AS (SELECT doc_id, {_RELEVANCE} AS relevance FROM documents),
t AS (SELECT d.*, row_number() OVER (PARTITION BY uri ORDER BY round(-k.relevance, 9), d.doc_id) AS place FROM d JOIN k USING (doc_id)), c AS (SELECT doc_id, uri, place, unnest(range(start_line, end_line + 1)) AS line FROM t WHERE place <= 10)
SELECT uri, doc_id, place::INT AS place, count(n.line) AS overlap_lines FROM c LEFT JOIN n USING (uri, line) GROUP BY ALL""")
def retrieval_trace(spark, sf_dir):
    """The ten best candidates of each source by relevance, and how many required lines each covers, attached afterwards."""
    chosen, required, _ = spans(spark, sf_dir)
    text = read_table(spark, sf_dir, "documents").select("doc_id", F.round(-tx.relevance(F.col("text"), TERMS), 9).alias("falling"))
    ranked = chosen.where("strategy = 'all'").join(text, "doc_id").withColumn("place", F.row_number().over(Window.partitionBy("uri").orderBy("falling", "doc_id"))).where("place <= 10")
    need = metrics.lines(required).distinct().withColumn("hit", F.lit(1))
    covered = metrics.lines(ranked, "doc_id", "place").join(need, ["uri", "line"], "left")
    return covered.groupBy("uri", "doc_id", "place").agg(F.count("hit").alias("overlap_lines"))


@query("SELECT conv_id, turn AS node_id FROM conversations JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE length(text) % 3 = 0 GROUP BY conv_id) USING (conv_id) WHERE turn <= last")
def baseline_selection(spark, sf_dir):
    """The simple baseline: relevant nodes (here by length) and all they depend on."""
    turns = read_table(spark, sf_dir, "conversations")
    node = F.concat_ws(".", "conv_id", "turn")
    seeds = turns.where(F.length("text") % 3 == 0).select(node.alias("node_id"))
    reached = graph.closure(tables.conversation_edges(spark, sf_dir), seeds)
    parts = F.split("node_id", r"\.")
    return reached.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("node_id"))


@query(f"""WITH c AS (SELECT source, {TOKENS_SQL} AS cost, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents)
SELECT source, round(count(*) FILTER (copy > 1) / count(*), 6) AS superseded_ratio, coalesce(sum(cost) FILTER (copy > 1), 0)::BIGINT AS saved_tokens FROM c GROUP BY source""")
def superseded_exclusion(spark, sf_dir):
    """What leaving out superseded documents saves each source."""
    gone = graph.supersession(tables.copy_edges(spark, sf_dir))[0].select("node_id").withColumn("gone", F.lit(1))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", tx.token_count(F.col("text")).alias("cost"))
    joined = docs.join(gone, F.col("doc_id") == F.col("node_id"), "left")
    saved = F.coalesce(F.sum(F.when(F.col("gone") == 1, F.col("cost"))), F.lit(0)).alias("saved_tokens")
    return joined.groupBy("source").agg(F.round(F.count("gone") / F.count(F.lit(1)), 6).alias("superseded_ratio"), saved)


@query(f"""WITH RECURSIVE {_WALKED}, a AS (SELECT doc_id FROM documents), e AS (SELECT x.node_id AS src, y.node_id AS dst FROM i0 x JOIN i0 y ON y.copy = 1 AND x.copy > 1 JOIN documents dx ON dx.doc_id = x.node_id JOIN documents dy ON dy.doc_id = y.node_id WHERE dx.text = dy.text),
b AS (SELECT src AS n, dst AS o FROM e UNION SELECT dst, src FROM e), r AS (SELECT n, string_agg(o, ',' ORDER BY o) AS related FROM b GROUP BY n)
SELECT i0.node_id, CASE WHEN s.node_id IS NOT NULL THEN 'included' ELSE 'excluded' END AS status, CASE WHEN s.node_id IS NOT NULL THEN NULL WHEN i0.copy > 1 THEN 'superseded' WHEN i0.cost > {sp.ALLOWANCE} THEN 'infeasible_constraints' ELSE 'not_selected_under_objective' END AS reason,
CASE WHEN i0.copy > 1 THEN 'CTX210' END AS codes, r.related FROM i0 LEFT JOIN s ON s.lang = i0.lang AND s.node_id = i0.node_id LEFT JOIN r ON r.n = i0.node_id""")
def node_explanations(spark, sf_dir):
    """What the stored evidence says of every document: chosen or why not, diagnostics, copies and what they are copies of."""
    rows = sp.items(spark, sf_dir)
    chosen = stored(selection.relevance_greedy(rows, "lang", sp.ALLOWANCE).select("node_id"))
    edges = stored(tables.copy_edges(spark, sf_dir))
    gone = graph.supersession(edges)[0].select("node_id")
    left = rows.select("node_id", F.when(F.col("cost") > sp.ALLOWANCE, "infeasible_constraints").otherwise("not_selected_under_objective").alias("reason")).unionAll(gone.select("node_id", F.lit("superseded")))
    nodes = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    told = evidence.explain(nodes, chosen, left, gone.select("node_id", F.lit("CTX210").alias("code")), edges)
    return told.select("node_id", "status", "reason", F.array_join("codes", ",").alias("codes"), F.array_join("related", ",").alias("related"))


def recorded(spark, sf_dir):
    """Manifests of conversations that left out every third turn, but record turn 2 alone; ids and some parts are wrong in some conversations."""
    rows = stored(sp.turns(spark, sf_dir))
    final = rows.where("node_id % 3 <> 2")
    sums = rows.groupBy("conv_id").agg(F.sum("cost").alias("before_tokens")).join(final.groupBy("conv_id").agg(F.sum("cost").alias("final_tokens")), "conv_id")
    policy = F.concat(F.lit("policy of "), F.col("conv_id").cast("string"))
    stated = F.when(F.col("conv_id") % 13 == 0, F.lit("another")).otherwise(evidence.policy_identity(policy))
    builds = stored(sums.select("conv_id", F.lit(400).alias("budget"), F.when(F.col("conv_id") % 7 == 0, 401).otherwise(400).alias("source_allowance"), "before_tokens", "final_tokens", policy.alias("policy"), stated.alias("policy_identity")))
    removed = rows.where("node_id = 2 AND conv_id % 17 <> 0").join(builds, "conv_id")
    before = F.when(F.col("conv_id") % 3 == 0, F.col("before_tokens") + 1).otherwise(F.col("before_tokens"))
    after = F.when(F.col("conv_id") % 19 == 0, F.col("final_tokens") - 1).otherwise(F.col("final_tokens"))
    trims = removed.select("conv_id", F.when(F.col("conv_id") % 23 == 0, 2).otherwise(1).alias("iteration"), "node_id", before.alias("tokens_before"), after.alias("tokens_after"))
    nodes = lambda condition: rows.where(condition).select("conv_id", "node_id")
    code = lambda condition, name: rows.where(condition).select("conv_id", F.lit(name).alias("code"), "node_id")
    excluded = nodes("(conv_id % 5 = 0 AND node_id = 0) OR (conv_id % 2 = 0 AND node_id = 1)")
    diagnostics = code("node_id = 1 AND conv_id % 29 < 15", "CTX210").unionAll(code("conv_id % 31 <> 0 AND node_id = 0", "CTX410"))
    barred = nodes("conv_id % 4 = 0 AND node_id IN (0, 1)")
    chosen = rows.where("NOT (conv_id % 2 = 0 AND node_id = 1)")
    return evidence.Manifest("conv_id", builds, chosen.select("conv_id", "node_id"), final.select("conv_id", "node_id"), excluded, nodes("node_id = 2"), nodes("node_id = 1"), nodes("conv_id % 37 = 0 AND node_id = 0"), barred, trims, diagnostics, code("node_id = 0", "CTX410").select("conv_id", "code"))


_EX = "((conv_id % 5 = 0 AND node_id = 0) OR (conv_id % 2 = 0 AND node_id = 1))"


@query(f"""WITH {sp._TURNS}, k AS (SELECT conv_id, sum(cost)::BIGINT AS total, coalesce((sum(cost) FILTER (node_id % 3 <> 2))::BIGINT, 0) AS short, bool_or(node_id = 2) AND conv_id % 17 <> 0 AS trimmed FROM t GROUP BY conv_id HAVING count(*) FILTER (node_id % 3 <> 2) > 0),
p AS (SELECT conv_id, 'build_identity' AS problem FROM k WHERE conv_id % 11 = 0 UNION ALL SELECT conv_id, 'final_over_budget' FROM k WHERE short > 400 UNION ALL SELECT conv_id, 'allowance_over_budget' FROM k WHERE conv_id % 7 = 0
UNION ALL SELECT conv_id, 'final_unselected' FROM t WHERE conv_id % 2 = 0 AND node_id = 1 UNION ALL SELECT conv_id, 'forced_absent' FROM t WHERE conv_id % 2 = 0 AND node_id = 1 UNION ALL SELECT conv_id, 'mandatory_absent' FROM t WHERE node_id = 2
UNION ALL SELECT conv_id, 'excluded_selected' FROM t WHERE conv_id % 5 = 0 AND node_id = 0 UNION ALL SELECT conv_id, 'policy_identity' FROM k WHERE conv_id % 13 = 0 UNION ALL SELECT conv_id, 'blocked_node' FROM t WHERE conv_id % 37 = 0 AND node_id = 0
UNION ALL SELECT conv_id, 'barred_not_excluded' FROM t WHERE conv_id % 4 = 0 AND node_id IN (0, 1) AND NOT {_EX} UNION ALL SELECT conv_id, 'security_code_absent' FROM t WHERE conv_id % 31 = 0 AND node_id = 0
UNION ALL SELECT conv_id, 'superseded_not_excluded' FROM t WHERE node_id = 1 AND conv_id % 29 < 15 AND NOT {_EX} UNION ALL SELECT conv_id, 'trim_gap' FROM k WHERE trimmed AND conv_id % 23 = 0 UNION ALL SELECT conv_id, 'trim_chain' FROM k WHERE trimmed AND conv_id % 3 = 0
UNION ALL SELECT conv_id, 'trim_end' FROM k WHERE trimmed AND conv_id % 19 = 0 UNION ALL SELECT t.conv_id, 'trim_delta' FROM t JOIN k USING (conv_id) WHERE trimmed AND node_id % 3 = 2 AND node_id > 2 UNION ALL SELECT conv_id, 'untrimmed_counts' FROM k WHERE NOT trimmed AND short <> total)
SELECT conv_id, problem, count(*) AS n FROM p GROUP BY ALL""")
def manifest_consistency(spark, sf_dir):
    """Every contradiction inside every manifest; the ids of some were altered after they were sealed."""
    sealed = recorded(spark, sf_dir).sealed()
    altered = sealed.builds.withColumn("build_id", F.when(F.col("conv_id") % 11 == 0, F.lit("sha256:0")).otherwise(F.col("build_id")))
    return evidence.manifest_problems(replace(sealed, builds=altered))


@query("SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, count(DISTINCT lang) AS n_tasks FROM documents")
def selection_determinism(spark, sf_dir):
    """The selection from rows in two orders and partitionings, one of them with the labels beside: they must not differ."""
    rows = sp.items(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    labelled = rows.join(labels, F.col("node_id") == F.col("l_id"), "left").repartitionByRange(13, F.desc("node_id"))
    one, other = (selection.density_greedy(df, "lang", sp.ALLOWANCE) for df in (rows.repartition(5, "node_id"), labelled))
    n = read_table(spark, sf_dir, "documents").agg(F.count_distinct("lang").alias("n_tasks"))
    return incremental.differences(one, other).crossJoin(n)  # one row each


@query("""SELECT event_id, CASE WHEN event_id % 6 = 1 THEN 'not_an_object' WHEN event_id % 6 = 2 THEN 'unknown_field' WHEN event_id % 6 = 3 THEN 'wrong_type' WHEN event_id % 6 = 4 THEN 'missing_field' WHEN event_id % 6 = 5 THEN 'unsupported_version' ELSE 'ok' END AS outcome FROM events""")
def strict_decoding(spark, sf_dir):
    """Events as envelopes, of which five in six are wrong in some way."""
    k = F.get_json_object("props", "$.k")
    cases = [F.concat(F.lit('{"schema_version":"1.0","k":'), k, F.lit("}")), F.concat(F.lit("["), k, F.lit("]")), F.concat(F.lit('{"schema_version":"1.0","more":1,"k":'), k, F.lit("}")), F.concat(F.lit('{"schema_version":"1.0","k":"'), k, F.lit('x"}')), F.lit('{"schema_version":"1.0"}'), F.concat(F.lit('{"schema_version":"2.0","k":'), k, F.lit("}"))]
    rows = read_table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*cases), (F.col("event_id") % 6 + 1).cast("int")).alias("raw"))
    return decoding.strict(rows, "raw", {"schema_version": "string", "k": "bigint"}, ("1.0", "1.1")).select("event_id", "outcome")


@query("""WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents), n AS (SELECT first, list(DISTINCT doc_id::VARCHAR ORDER BY doc_id::VARCHAR) AS copies FROM f WHERE doc_id <> first GROUP BY first)
SELECT doc_id::VARCHAR AS node_id, CASE WHEN doc_id <> f.first THEN 'excluded' WHEN doc_id % 3 = 0 THEN 'included' ELSE 'unknown' END AS status, CASE WHEN doc_id <> f.first THEN 'superseded' END AS reason, CASE WHEN doc_id <> f.first THEN 'CTX120' END AS codes,
CASE WHEN doc_id <> f.first THEN f.first::VARCHAR ELSE array_to_string(n.copies, ',') END AS related FROM f LEFT JOIN n ON n.first = f.doc_id""")
def artifact_explanations(spark, sf_dir):
    """Documents exported with their copies and what was decided, then explained from the stored artifact alone."""
    path = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    nodes = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node_id"), F.lit("document").alias("kind"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("uri"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    edges = stored(tables.copy_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "edge_type"))
    gone = edges.select(F.col("src").alias("node_id"))
    chosen = nodes.where("doc_id % 3 = 0").join(gone, "node_id", "left_anti").select("node_id", F.col("doc_id").alias("rank"), F.lit(None).cast("string").alias("reason"))
    left = gone.select("node_id", F.lit(None).cast("long").alias("rank"), F.lit("superseded").alias("reason"))
    artifact.export(spark, path, {"nodes": nodes, "edges": edges, "decisions": chosen.unionByName(left), "codes": gone.select("node_id", F.lit("CTX120").alias("code"))}, {"task": "documents"})
    return artifact.explain(artifact.read(spark, path)).select("node_id", "status", "reason", F.array_join("codes", ",").alias("codes"), F.array_join("related", ",").alias("related"))
