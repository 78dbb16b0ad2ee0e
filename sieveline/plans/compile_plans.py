"""The chain of compilation on the given tables: each source is a task over its documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.operators import policy
from sieveline.plans.compile import Compilation, compile_tasks
from sieveline.plans.text_plans import _RELEVANCE, TERMS, TOKENS_SQL
from sieveline.queries import query
from sieveline.store import read_table, stored

BUDGET, ANCHOR = 2500, "2024-01-01 00:00:00"
SYSTEM, POLICY = "Answer from the context only.", "Name the nodes that you cite."
RULES = [("keep-out", 0, True, "exclude", "CTX410", ["external_content"], [], [], []), ("no-leak", 1, True, "block_compilation", "CTX430", [], ["confidential"], [], [])]


def compiled(spark, sf_dir, strategy: str) -> Compilation:
    """Of each five documents of a source the later ones need the first, the fourth and fifth also the one before; copies within a source are
    superseded by the first; German documents are kept out, and one confidential document stops its source."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL")
    place = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("place")
    ids = stored(docs.select("doc_id", F.col("source").alias("task_id"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"), place))
    node = lambda c: F.format_string("d%09d", c)
    nothing = lambda kind: F.lit(None).cast(kind)
    nodes = docs.select(
        F.col("source").alias("task_id"), node(F.col("doc_id")).alias("node_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), F.lit("document").alias("kind"), F.col("text").alias("content"), nothing("timestamp").alias("created_at"),
        F.when(F.col("lang") == "de", "external_content").otherwise("repository").alias("trust_domain"), F.when(F.col("doc_id") % 400 == 7, "confidential").otherwise("public").alias("sensitivity"), F.lit("none").alias("instruction_authority"), nothing("string").alias("security_sink"), nothing("double").alias("semantic_score"),
    )
    offsets = F.expr("CASE place % 5 WHEN 0 THEN array() WHEN 1 THEN array(1) WHEN 2 THEN array(2) ELSE array(place % 5, 1) END")
    asked = ids.select("task_id", F.col("doc_id").alias("src_id"), F.explode(offsets).alias("back"), "place").withColumn("at", F.col("place") - F.col("back"))
    needs = asked.join(ids.select("task_id", F.col("place").alias("at"), F.col("doc_id").alias("dst_id")), ["task_id", "at"]).select("task_id", node(F.col("src_id")).alias("src"), node(F.col("dst_id")).alias("dst"), F.lit("requires").alias("edge_type"))
    first = ids.groupBy("task_id", "h", "s").agg(F.min("doc_id").alias("first_id"))
    copies = ids.join(first, ["task_id", "h", "s"]).where("doc_id > first_id").select("task_id", node(F.col("doc_id")).alias("src"), node(F.col("first_id")).alias("dst"), F.lit("supersedes").alias("edge_type"))
    text = lambda value: F.lit(value)
    tasks = ids.select("task_id").distinct().select("task_id", F.array(*map(F.lit, TERMS)).alias("terms"), text(SYSTEM).alias("system"), text(POLICY).alias("policy"), F.concat(F.lit("Summarise "), F.col("task_id")).alias("user"))
    return compile_tasks(nodes, needs.unionByName(copies), tasks, spark.createDataFrame(RULES, policy.RULE), ANCHOR, BUDGET, strategy)


_HEAD = f"'<<<GENERIC_CHAT version=1>>>' || chr(10) || '<<<ROLE system>>>' || chr(10) || '{SYSTEM}' || chr(10) || '<<<END_ROLE>>>' || chr(10) || '<<<ROLE developer>>>' || chr(10) || '{POLICY}' || chr(10) || '<<<END_ROLE>>>' || chr(10) || '<<<ROLE user>>>' || chr(10) || 'Summarise ' || task || chr(10) || '<<<END_ROLE>>>' || chr(10)"
_END = "'<<<GENERATION_PROMPT role=assistant>>>' || chr(10)"
_COMPILED = f"""d AS MATERIALIZED (SELECT doc_id, text, source AS task, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, min(doc_id) OVER (PARTITION BY source, text) AS first_id, bool_or(doc_id % 400 = 7) OVER (PARTITION BY source) AS stopped FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
n AS MATERIALIZED (SELECT task, place, doc_id, printf('d%09d', doc_id) AS node_id, {_RELEVANCE} AS relevance, '<<<CONTEXT node_id=' || printf('d%09d', doc_id) || ' kind=document source=doc://' || doc_id || '>>>' || chr(10) || text || chr(10) || '<<<END_CONTEXT>>>' AS segment,
 lang IS DISTINCT FROM 'de' AND doc_id = first_id AS allowed FROM d WHERE NOT stopped),
c AS MATERIALIZED (SELECT *, {TOKENS_SQL.replace("text", "segment")} AS cost FROM n),
o AS MATERIALIZED (SELECT task, {TOKENS_SQL.replace("text", f"({_HEAD} || {_END})")} AS overhead FROM (SELECT DISTINCT task FROM n)),
cl AS MATERIALIZED (SELECT task, place, unnest(CASE place % 5 WHEN 0 THEN [place] WHEN 1 THEN [place, place - 1] WHEN 2 THEN [place, place - 2] WHEN 3 THEN [place, place - 3, place - 1] ELSE [place, place - 4, place - 1, place - 2] END) AS part FROM c),
ok AS MATERIALIZED (SELECT a.task, a.place, bool_and(c.allowed) AS fine, list(a.part) AS parts FROM cl a JOIN c ON c.task = a.task AND c.place = a.part GROUP BY ALL),
q AS MATERIALIZED (SELECT c.task, c.place, ok.parts, row_number() OVER (PARTITION BY c.task ORDER BY round(-relevance, 9), cost, 'doc://' || doc_id, node_id) AS n FROM c JOIN ok USING (task, place) WHERE ok.fine),
w AS (SELECT task, 0::BIGINT AS n, []::BIGINT[] AS sel, 0::BIGINT AS used FROM o
 UNION ALL SELECT task, n, CASE WHEN fits THEN list_concat(sel, fresh) ELSE sel END, CASE WHEN fits THEN used + more ELSE used END FROM (
  SELECT w.task, q.n, w.sel, w.used, coalesce(list(c.place) FILTER (NOT list_contains(w.sel, c.place)), []) AS fresh, coalesce(sum(c.cost) FILTER (NOT list_contains(w.sel, c.place)), 0)::BIGINT AS more, w.used + more <= {BUDGET} - any_value(o.overhead) AS fits
  FROM w JOIN q ON q.task = w.task AND q.n = w.n + 1 JOIN c ON c.task = q.task AND list_contains(q.parts, c.place) JOIN o ON o.task = w.task GROUP BY w.task, q.n, w.sel, w.used)),
s AS MATERIALIZED (SELECT task, unnest(sel) AS place FROM (SELECT task, arg_max(sel, n) AS sel FROM w GROUP BY task)),
e AS MATERIALIZED (SELECT s.task, s.place, list(cl.part) FILTER (cl.part <> s.place) AS needs, any_value(c.cost) AS cost, round(-any_value(relevance), 9) AS k, any_value(node_id) AS node_id, any_value(doc_id) AS doc_id FROM s JOIN cl USING (task, place) JOIN c USING (task, place) GROUP BY s.task, s.place),
r AS (SELECT DISTINCT task, []::BIGINT[] AS done FROM e UNION ALL SELECT task, list_append(done, place) FROM (SELECT r.task, r.done, e.place, row_number() OVER (PARTITION BY r.task ORDER BY k, cost, 'doc://' || doc_id, node_id) AS turn FROM r JOIN e ON e.task = r.task AND NOT list_contains(r.done, e.place) AND list_has_all(r.done, coalesce(e.needs, []))) WHERE turn = 1),
rk AS MATERIALIZED (SELECT task, unnest(done) AS place, generate_subscripts(done, 1)::BIGINT AS rank FROM (SELECT task, arg_max(done, len(done)) AS done FROM r GROUP BY task)),
tu AS (SELECT rk.task, rk.place, any_value(rk.rank) AS rank, max(x.rank) AS turn FROM rk JOIN cl USING (task, place) JOIN rk x ON x.task = rk.task AND x.place = cl.part GROUP BY rk.task, rk.place),
b AS MATERIALIZED (SELECT tu.*, c.cost, c.node_id, c.segment, overhead + 15 + sum(c.cost) OVER (PARTITION BY tu.task ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {BUDGET} AS kept FROM tu JOIN c USING (task, place) JOIN o USING (task))"""


@query(f"WITH RECURSIVE {_COMPILED} SELECT task AS task_id, node_id, kept FROM b")
def compile_selection(spark, sf_dir):
    """What is chosen for each source by relevance with dependencies, and whether the exact budget leaves it."""
    done = compiled(spark, sf_dir, "relevance_greedy")
    return done.selected.select("task_id", "node_id", F.lit(True).alias("kept")).unionByName(done.trimmed.where("NOT kept").select("task_id", "node_id", "kept"))


@query(f"""WITH RECURSIVE {_COMPILED}, x AS (SELECT task, string_agg(segment, chr(10) || chr(10) ORDER BY rank) AS context, sum(cost)::BIGINT AS used, count(*) AS n_nodes FROM b WHERE kept GROUP BY task),
y AS (SELECT o.task, coalesce(n_nodes, 0) AS n_nodes, coalesce(used, 0) AS used, {_HEAD.replace("task", "o.task")} || coalesce('<<<ROLE user>>>' || chr(10) || context || chr(10) || '<<<END_ROLE>>>' || chr(10), '') || {_END} AS text FROM o LEFT JOIN x ON x.task = o.task)
SELECT task AS task_id, n_nodes, used, {TOKENS_SQL} AS tokens, sha256(text) AS text_sha256 FROM y""")
def compiled_texts(spark, sf_dir):
    """The rendered text of each source: instructions, task and context within the budget."""
    done = compiled(spark, sf_dir, "relevance_greedy")
    sums = done.selected.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("cost").alias("used"))
    return done.rendered.join(sums, "task_id", "left").select("task_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("used", F.lit(0)).alias("used"), "tokens", F.sha2("text", 256).alias("text_sha256"))
