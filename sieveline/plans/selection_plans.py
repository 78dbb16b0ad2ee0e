"""Selection strategies on the given tables: documents by language, events by type, turns by conversation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import graph, metrics, render, selection
from sieveline.plans.text_plans import _RELEVANCE, TERMS, TOKENS_SQL
from sieveline.queries import query
from sieveline.sources import tables
from sieveline.store import read_table, stored

ALLOWANCE = 5000
_ITEMS = f"""i0 AS MATERIALIZED (SELECT doc_id AS node_id, lang, 'doc://' || source || '/' || doc_id AS uri, {TOKENS_SQL} AS cost, {_RELEVANCE} AS relevance,
row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy, CASE WHEN source LIKE 'src1%' THEN 0.0 ELSE 0.2 END AS trust FROM documents),
i AS MATERIALIZED (SELECT *, round(relevance + trust, 12) AS value FROM i0 WHERE copy = 1)"""


def _walk(table: str, by: str, order: str, allowance: int, where: str = "true") -> str:
    """A greedy walk in SQL, one recursion step an item."""
    return f"""o AS MATERIALIZED (SELECT {by}, node_id, cost, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS n FROM {table} WHERE cost <= {allowance} AND {where}),
w AS (SELECT {by}, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS node_id, 0::BIGINT AS cost, false AS taken FROM o GROUP BY {by}
UNION ALL SELECT o.{by}, o.n, CASE WHEN w.used + o.cost <= {allowance} THEN w.used + o.cost ELSE w.used END, o.node_id, o.cost, w.used + o.cost <= {allowance} FROM w JOIN o ON o.{by} = w.{by} AND o.n = w.n + 1),
s AS (SELECT {by}, node_id, cost, row_number() OVER (PARTITION BY {by} ORDER BY n) AS rank, used FROM w WHERE taken)"""


_STABLE = "round(-{0}, 9), round(-relevance, 9), cost, uri, node_id"
_FINAL = " SELECT lang, node_id, cost, rank, used FROM s"


def items(spark, sf_dir):
    """Documents that no copy supersedes, with cost, relevance and value, stored; one pass over the texts, which aren't kept."""
    trust = F.when(F.col("trust_domain") == "external_content", 0.0).otherwise(1.0)
    content = F.col("content")
    scored = stored(tables.document_nodes(spark, sf_dir).select("doc_id", "lang", "uri", tx.token_count(content).alias("cost"), tx.relevance(content, TERMS).alias("relevance"), trust.alias("trust"), tx.content_hash(content).alias("content_hash")))
    gone = graph.supersession(tables.copies(scored.select("doc_id", "content_hash")))[0].select(F.col("node_id").alias("gone_id"))
    kept = scored.join(gone, scored["doc_id"] == gone["gone_id"], "left_anti")
    return stored(kept.select(F.col("doc_id").alias("node_id"), "lang", "uri", "cost", "relevance", "trust", tx.base_value(relevance=F.col("relevance"), trust=F.col("trust")).alias("value")))


@query(f"WITH RECURSIVE {_ITEMS}, {_walk('i', 'lang', 'uri, node_id', ALLOWANCE)}{_FINAL}")
def naive_budget(spark, sf_dir):
    return selection.naive(items(spark, sf_dir), "lang", ALLOWANCE)


@query(f"WITH RECURSIVE {_ITEMS}, {_walk('i', 'lang', _STABLE.format('relevance'), ALLOWANCE)}{_FINAL}")
def relevance_budget(spark, sf_dir):
    return selection.relevance_greedy(items(spark, sf_dir), "lang", ALLOWANCE)


@query(f"WITH RECURSIVE {_ITEMS}, {_walk('i', 'lang', _STABLE.format('value / greatest(1, cost)'), ALLOWANCE, 'value > 0')}{_FINAL}")
def density_budget(spark, sf_dir):
    return selection.density_greedy(items(spark, sf_dir), "lang", ALLOWANCE)


_EVENTS = """e AS MATERIALIZED (SELECT event_id AS node_id, event_type, lpad(user_id::VARCHAR, 8, '0') AS uri, (1 + length(props))::BIGINT AS cost, 0.0 AS relevance,
1 / (1 + greatest(0, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 1e6 / 86400) AS freshness FROM events)"""


@query(f"WITH RECURSIVE {_EVENTS}, {_walk('e', 'event_type', _STABLE.format('freshness'), 400)} SELECT event_type, node_id, cost, rank, used FROM s")
def recency_budget(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    fresh = tx.freshness(F.col("ts"), F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    rows = events.select(F.col("event_id").alias("node_id"), "event_type", F.lpad(F.col("user_id").cast("string"), 8, "0").alias("uri"), (1 + F.length("props")).cast("long").alias("cost"), F.lit(0.0).alias("relevance"), fresh.alias("freshness"))
    return selection.recency(rows, "event_type", 400)


_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], a.v), 6)"


@query(f"""WITH RECURSIVE {_ITEMS}, a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
k AS MATERIALIZED (SELECT i.*, {_COSINE} AS semantic_score FROM i JOIN embeddings e ON e.vec_id = i.node_id, a), {_walk('k', 'lang', _STABLE.format('semantic_score'), ALLOWANCE)}{_FINAL}""")
def topk_semantic_budget(spark, sf_dir):
    """Documents that have a vector, by cosine to the first vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    anchor = vectors.agg(F.min_by("embedding", "vec_id").alias("anchor"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    cosine = dot("embedding", "anchor") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("anchor", "anchor")))
    scored = vectors.crossJoin(anchor).select("vec_id", F.round(cosine, 6).alias("semantic_score"))  # one anchor row
    both = items(spark, sf_dir).join(scored, F.col("node_id") == F.col("vec_id"))
    return selection.top_k(both, "lang", ALLOWANCE)


_TURNS = f"t AS MATERIALIZED (SELECT conv_id, turn AS node_id, role, text, {TOKENS_SQL} AS cost, 1::DOUBLE + length(text) % 17 AS value FROM conversations)"


def turns(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    deps = F.when(F.col("turn") > 0, F.array(F.col("turn") - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.select("conv_id", F.col("turn").alias("node_id"), "role", tx.token_count(F.col("text")).alias("cost"), (1.0 + F.length("text") % 17).alias("value"), F.lit(0.0).alias("relevance"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("uri"), deps.alias("deps"))


@query(f"""WITH RECURSIVE {_TURNS}, p AS MATERIALIZED (SELECT conv_id, node_id AS j, cost, (sum(cost) OVER w)::BIGINT AS tc, sum(value) OVER w AS tv FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY node_id)),
w AS (SELECT DISTINCT conv_id, -1::BIGINT AS k, 0::BIGINT AS c, 0::DOUBLE AS v FROM t
UNION ALL SELECT conv_id, j, tc, tv FROM (SELECT w.conv_id, p.j, p.tc, p.tv, row_number() OVER (PARTITION BY w.conv_id ORDER BY round((p.tv - w.v + 0.1 * (p.j - greatest(w.k, 0))) / greatest(1, p.tc - w.c), 12) DESC, round(p.tv - w.v + 0.1 * (p.j - greatest(w.k, 0)), 12) DESC, p.cost, p.j) AS n
FROM w JOIN p ON p.conv_id = w.conv_id AND p.j > w.k AND p.tc <= 400) WHERE n = 1)
SELECT t.conv_id, t.node_id, t.node_id + 1 AS rank FROM t JOIN (SELECT conv_id, max(k) AS k FROM w GROUP BY conv_id) m ON m.conv_id = t.conv_id AND t.node_id <= m.k""")
def density_closure_budget(spark, sf_dir):
    """Density greedy where each turn needs the one before it: what a step takes is always a beginning of the conversation."""
    return selection.solve(turns(spark, sf_dir), "conv_id", 400)


_BEST = "b AS (SELECT conv_id, max_by(node_id, (objective, -total)) AS last FROM p WHERE total <= 400 GROUP BY conv_id)"
_PREFIXES = f"{_TURNS}, p AS (SELECT *, sum(cost) OVER w AS total, round(sum(value) OVER w + 0.1::DOUBLE * (row_number() OVER w - 1), 9) AS objective FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY node_id))"


@query(f"WITH {_PREFIXES}, b AS (SELECT conv_id, max(node_id) AS last FROM p WHERE total <= 400 GROUP BY conv_id) SELECT p.conv_id, round(p.objective, 6) AS objective, p.total::BIGINT AS cost, p.node_id + 1 AS n_chosen FROM p JOIN b ON b.conv_id = p.conv_id AND b.last = p.node_id")
def brute_force_budget(spark, sf_dir):
    """All closed subsets of each conversation; as values are positive, the longest beginning that fits is the best."""
    found = selection.brute_force(turns(spark, sf_dir), "conv_id", 400).where(F.size("chosen") > 0)
    return found.select("conv_id", F.round("objective", 6).alias("objective"), "cost", F.size("chosen").cast("long").alias("n_chosen"))


@query(f"WITH {_PREFIXES}, b AS (SELECT conv_id, max(node_id) AS last FROM p WHERE total <= 400 GROUP BY conv_id) SELECT t.conv_id, t.node_id, 'brute_force' AS strategy FROM t JOIN b ON b.conv_id = t.conv_id AND t.node_id <= b.last")
def auto_selection(spark, sf_dir):
    """Each conversation solved by the strategy that the cascade names for its size."""
    return selection.select_auto(turns(spark, sf_dir), "conv_id", 400).select("conv_id", "node_id", "strategy")


@query(f"""WITH {_TURNS}, p AS (SELECT *, sum(cost) OVER w AS total, sum(value) OVER w + 0.1::DOUBLE * (row_number() OVER w - 1) AS objective FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY node_id))
SELECT conv_id, max(objective) AS objective, count(*) AS n_chosen FROM p WHERE total <= 400 GROUP BY conv_id""")
def exact_closure_budget(spark, sf_dir):
    """The best closed set of turns; since each turn needs the one before it, SQL can try the beginnings of a conversation."""
    rows = turns(spark, sf_dir)
    chosen = selection.solve(rows, "conv_id", 400, selection.Problem.exact)
    totals = chosen.join(rows, ["conv_id", "node_id"]).groupBy("conv_id").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n_chosen"))
    return totals.select("conv_id", (F.col("v") + 0.1 * (F.col("n_chosen") - 1)).alias("objective"), "n_chosen")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, (1 + length(text) // 50)::BIGINT AS cost, (1 + length(text) % 17)::BIGINT AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS best FROM o GROUP BY conv_id
UNION SELECT conv_id, n, used, max(best) FROM (SELECT o.conv_id, o.n, r.used + k * o.cost AS used, r.best + k * o.value AS best FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1, (VALUES (0), (1)) AS c(k)) WHERE used <= 30 GROUP BY ALL)
SELECT conv_id, max(best) AS best, max(best) AS chosen_value, true AS fits FROM r WHERE conv_id IN (SELECT conv_id FROM o WHERE cost <= 30) GROUP BY conv_id""")
def knapsack_dp(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node_id"), (1 + F.floor(F.length("text") / 50)).alias("cost"), (1 + F.length("text") % 17).cast("long").alias("value"))
    found = stored(selection.knapsack(rows, "conv_id", 30))
    priced = found.select("conv_id", F.explode("chosen").alias("node_id")).join(rows, ["conv_id", "node_id"]).groupBy("conv_id").agg(F.sum("value").alias("chosen_value"), (F.sum("cost") <= 30).alias("fits"))
    return found.select("conv_id", "best").join(priced, "conv_id")


@query(f"""WITH {_TURNS}, m AS (SELECT conv_id FROM t WHERE node_id = 3), k AS (SELECT conv_id, sum(cost)::BIGINT AS cost, bool_or(role = 'system') AS barred FROM t WHERE node_id <= 3 AND conv_id IN (FROM m) GROUP BY conv_id)
SELECT conv_id, 'CTX530' AS code, CASE WHEN barred THEN 'mandatory_closure_not_allowed' ELSE 'mandatory_closure_exceeds_allowance' END AS reason, cost FROM k WHERE barred OR cost > 300""")
def mandatory_feasibility(spark, sf_dir):
    """Turn 3 is mandatory and system turns aren't allowed: its closure must be allowed and fit."""
    rows = stored(turns(spark, sf_dir))
    return selection.mandatory_problems(rows, "conv_id", rows.where("node_id = 3"), rows.where("role <> 'system'"), 300)


@query(f"""WITH {_TURNS}, s AS (SELECT * FROM t WHERE cost < 150) SELECT s.conv_id, round(sum(s.value) + 0.1::DOUBLE * count(d.node_id), 6) AS objective FROM s LEFT JOIN s d ON d.conv_id = s.conv_id AND d.node_id = s.node_id - 1 GROUP BY s.conv_id""")
def objective_value(spark, sf_dir):
    """Values of the short turns, and the dependency bonus for pairs that are both chosen."""
    chosen = turns(spark, sf_dir).where("cost < 150")
    needed = chosen.select(F.col("conv_id").alias("dep_conv"), F.col("node_id").alias("dep_id"))
    pairs = chosen.join(needed, (F.col("conv_id") == F.col("dep_conv")) & (F.col("node_id") - 1 == F.col("dep_id")), "left").select("conv_id", "value", "dep_id")
    return pairs.groupBy("conv_id").agg(F.round(F.sum("value") + tx.DEPENDENCY_WEIGHT * F.count("dep_id"), 6).alias("objective"))


@query(f"""WITH {_TURNS}, s AS (SELECT * FROM t WHERE cost < 150), ok AS (SELECT * FROM s WHERE conv_id % 10 <> 0)
SELECT conv_id, 'duplicate' AS violation, count(*) AS n FROM s WHERE (conv_id + node_id) % 9 = 4 GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 'unknown', 1 FROM s WHERE conv_id % 10 = 0
UNION ALL SELECT conv_id, 'blocked', count(*) FROM s WHERE role = 'system' GROUP BY conv_id UNION ALL SELECT conv_id, 'mandatory', 1 FROM t WHERE node_id = 1 AND cost >= 150
UNION ALL SELECT t.conv_id, 'dependency', count(*) FROM t JOIN (SELECT conv_id, max(node_id) AS last FROM ok GROUP BY conv_id) l ON l.conv_id = t.conv_id AND t.node_id < l.last WHERE cost >= 150 GROUP BY t.conv_id
UNION ALL SELECT conv_id, 'allowance', 1 FROM ok GROUP BY conv_id HAVING sum(cost) > 200""")
def selection_violations(spark, sf_dir):
    """Short turns as a selection, some twice, some of no conversation."""
    rows = stored(turns(spark, sf_dir))
    chosen = rows.where("cost < 150").select("conv_id", "node_id")
    twice = chosen.where("(conv_id + node_id) % 9 = 4")
    strange = chosen.where("conv_id % 10 = 0").select("conv_id", F.lit(999).cast("long").alias("node_id")).distinct()
    return selection.violations(rows, "conv_id", chosen.unionAll(twice).unionAll(strange), rows.where("node_id = 1"), rows.where("role = 'system'"), 200)


@query("""SELECT 'missing_analysis' AS problem, doc_id AS node_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unknown_configured', c FROM (SELECT DISTINCT doc_id * 3 AS c FROM labels) WHERE c NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unknown_analysis', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def problem_validation(spark, sf_dir):
    """Documents as nodes, labels as their analyses."""
    nodes = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    labels = read_table(spark, sf_dir, "labels")
    return selection.problem_differences(nodes, labels.select(F.col("doc_id").alias("node_id")), labels.select((F.col("doc_id") * 3).alias("node_id")))


@query("""WITH RECURSIVE n AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events), e AS MATERIALIZED (SELECT DISTINCT user_id || ':' || event_type AS src, user_id || ':' || next_type AS dst FROM n WHERE next_type IS NOT NULL AND next_type <> event_type),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), v AS (SELECT src AS x FROM e UNION SELECT dst FROM e),
c AS (SELECT v.x, least(v.x, coalesce(min(a.dst), v.x)) AS part FROM v LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src) a ON a.src = v.x GROUP BY v.x),
d AS (SELECT DISTINCT y.part FROM e JOIN c z ON z.x = e.src JOIN c y ON y.x = e.dst WHERE z.part <> y.part) SELECT max(x) AS node_id FROM c WHERE part NOT IN (FROM d) GROUP BY part""")
def canonical_seeds(spark, sf_dir):
    """A least set of each user's types of events from which the rest follows."""
    edges = tables.transition_edges(spark, sf_dir).where("src <> dst").select("src", "dst").distinct()
    chosen = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().select("node_id", F.col("node_id").alias("rank"), F.lit(False).alias("mandatory"))
    return selection.canonical_seeds(chosen, edges)


@query(f"""WITH {_ITEMS}, g AS (SELECT lang, value, relevance, count(*) AS n_nodes, min(node_id) AS first_node FROM i GROUP BY ALL HAVING count(*) > 1)
SELECT lang, round(value, 6) AS value, round(relevance, 6) AS relevance, n_nodes, first_node, row_number() OVER (PARTITION BY lang ORDER BY value DESC, relevance DESC, first_node)::INT AS ordinal FROM g QUALIFY ordinal <= 8""")
def tie_groups(spark, sf_dir):
    found = selection.tie_groups(items(spark, sf_dir), "lang")
    return found.select("lang", F.round("value", 6).alias("value"), F.round("relevance", 6).alias("relevance"), "n_nodes", "first_node", "ordinal")


@query("""WITH k AS (SELECT 'conversation:' || conv_id AS task, count(*) AS n, count(*) FILTER (turn > 0) AS e FROM conversations GROUP BY conv_id UNION ALL SELECT 'nation:' || c_nationkey, count(*), 0 FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'lang:' || lang, count(*), 0 FROM documents GROUP BY lang UNION ALL SELECT 'user:' || user_id, count(*), count(*) - 1 FROM events GROUP BY user_id)
SELECT task, CASE WHEN n <= 16 THEN 'brute_force' WHEN e = 0 AND n <= 256 THEN 'dynamic_programming' WHEN n <= 120 AND e <= 2000 THEN 'ilp' WHEN e > 0 THEN 'graph_closure_greedy' ELSE 'density_greedy' END AS strategy FROM k""")
def cascade_choice(spark, sf_dir):
    """Conversations and users have dependencies (on the turn or event before), nations' customers and languages' documents none."""
    counted = lambda df, kind, key, edges: df.groupBy(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("task")).agg(F.count(F.lit(1)).alias("n_optional"), edges.alias("n_edges"), F.lit(True).alias("feasible"))
    t, none = lambda name: read_table(spark, sf_dir, name), F.max(F.lit(0)).cast("long")
    rows = counted(t("conversations"), "conversation", "conv_id", F.count_if(F.col("turn") > 0)).unionAll(counted(t("customer"), "nation", "c_nationkey", none)).unionAll(counted(t("documents"), "lang", "lang", none)).unionAll(counted(t("events"), "user", "user_id", F.count(F.lit(1)) - 1))
    return selection.cascade(rows, 400).select("task", "strategy")


_SELECTED = f"{_ITEMS}, {_walk('i', 'lang', _STABLE.format('relevance'), ALLOWANCE)}, g AS (SELECT s.*, i.uri, d.text, '<<<CONTEXT node_id=' || s.node_id || ' kind=document source=' || i.uri || '>>>' || chr(10) || d.text || chr(10) || '<<<END_CONTEXT>>>' AS segment FROM s JOIN i USING (lang, node_id) JOIN documents d ON d.doc_id = s.node_id)"


def selected_segments(spark, sf_dir, *scores: str):
    """The chosen documents with their segments; contents are looked up for the chosen only."""
    rows = items(spark, sf_dir)
    chosen = selection.relevance_greedy(rows, "lang", ALLOWANCE).join(rows.select("node_id", "uri", *scores), "node_id")
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    return chosen.join(texts, "node_id").withColumn("segment", render.segment(F.col("node_id").cast("string"), F.lit("document"), F.col("uri"), F.col("content")))


@query(f"WITH RECURSIVE {_SELECTED} SELECT lang, node_id, cost, rank, used, round(i.relevance, 6) AS relevance, sha256(segment) AS segment_sha256 FROM g JOIN i USING (lang, node_id)".replace("SELECT lang, node_id, cost, rank, used, round", "SELECT g.lang, g.node_id, g.cost, g.rank, g.used, round"))
def select_documents(spark, sf_dir):
    """The flagship: tokens, relevance, supersession, the greedy walk, and a rendered segment for each chosen document."""
    chosen = selected_segments(spark, sf_dir, "relevance")
    return chosen.select("lang", "node_id", "cost", "rank", "used", F.round("relevance", 6).alias("relevance"), F.sha2("segment", 256).alias("segment_sha256"))


@query(f"WITH RECURSIVE {_SELECTED} SELECT lang, length(string_agg(segment, chr(10) || chr(10) ORDER BY rank))::BIGINT AS n_chars, sha256('<<<GENERIC_CHAT version=1>>>' || chr(10) || '<<<ROLE user>>>' || chr(10) || string_agg(segment, chr(10) || chr(10) ORDER BY rank) || chr(10) || '<<<END_ROLE>>>' || chr(10) || '<<<GENERATION_PROMPT role=assistant>>>' || chr(10)) AS rendered_sha256 FROM g GROUP BY lang")
def rendered_segments(spark, sf_dir):
    """Each language's context as a generic chat; what is joined is bounded by the allowance."""
    text = render.joined("segment", "rank")
    done = selected_segments(spark, sf_dir).groupBy("lang").agg(text.alias("context"))
    return done.select("lang", F.length("context").cast("long").alias("n_chars"), F.sha2(render.generic_chat([("user", F.col("context"))]), 256).alias("rendered_sha256"))


@query(f"WITH RECURSIVE {_SELECTED} SELECT lang, node_id, start_char, start_char + length(segment) AS end_char, start_char + length(segment) - length(text) - 18 AS content_start FROM (SELECT *, coalesce(sum(length(segment) + 2) OVER (PARTITION BY lang ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM g)")
def source_map_offsets(spark, sf_dir):
    return render.source_map(selected_segments(spark, sf_dir), "lang").select("lang", "node_id", "start_char", "end_char", "content_start")


@query(f"WITH RECURSIVE {_SELECTED} SELECT lang, node_id, rank FROM (SELECT *, sum({TOKENS_SQL.replace('text', 'segment')}) OVER (PARTITION BY lang ORDER BY rank) AS total FROM g) WHERE total + 15 <= {ALLOWANCE}")
def budget_trim(spark, sf_dir):
    """Rendering adds tokens that no cost counts; what then overflows is dropped from the end."""
    return render.trim(selected_segments(spark, sf_dir), "lang", ALLOWANCE, render.ROLE_TOKENS).select("lang", "node_id", "rank")


_ENFORCED = f"""{_TURNS}, m AS (SELECT *, max(CASE WHEN node_id > 0 THEN xor(node_id, 1) END) OVER (PARTITION BY conv_id ORDER BY node_id) AS turn, node_id = 0 AS safe FROM t),
x AS (SELECT conv_id, node_id, cost, turn, safe, {render.ROLE_TOKENS} + coalesce(sum(CASE WHEN safe THEN cost END) OVER (PARTITION BY conv_id), 0) AS fixed, sum(cost) OVER (PARTITION BY conv_id, safe ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own, sum(cost) OVER (PARTITION BY conv_id, safe, turn) AS of_turn FROM m),
k AS (SELECT *, safe OR fixed + own <= 300 AS kept FROM x), y AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, kept ORDER BY turn DESC) AS later FROM k)"""


@query(f"WITH {_ENFORCED} SELECT conv_id, node_id, kept, CASE WHEN NOT kept THEN later END::INT AS iteration, CASE WHEN NOT kept THEN fixed + own END::BIGINT AS tokens_before, CASE WHEN NOT kept THEN fixed + own - of_turn END::BIGINT AS tokens_after, CASE WHEN fixed > 300 THEN 'CTX510' WHEN NOT kept THEN 'CTX500' END AS code FROM y")
def budget_enforcement(spark, sf_dir):
    """Neighbouring turns are rendered the wrong way round, so that what goes first takes turns with it that stand before it. Turn 0 is mandatory."""
    rows = stored(turns(spark, sf_dir))
    ranked = rows.select("conv_id", "node_id", F.col("node_id").bitwiseXOR(F.lit(1)).alias("rank"), F.col("cost").alias("tokens"))
    links = rows.select("conv_id", F.col("node_id").alias("src"), F.explode("deps").alias("dst"))
    done = render.enforce(ranked, links, rows.where("node_id = 0"), "conv_id", 300, render.ROLE_TOKENS)
    return done.select("conv_id", "node_id", "kept", "iteration", "tokens_before", "tokens_after", "code")


@query(f"""WITH {_TURNS}, s AS (SELECT * FROM t WHERE cost < 150) SELECT DISTINCT conv_id, 'unknown' AS problem, 999 AS node_id FROM s WHERE conv_id % 10 = 0 UNION ALL SELECT conv_id, 'blocked', node_id FROM s WHERE role = 'system'
UNION ALL SELECT s.conv_id, 'dependency', s.node_id - 1 FROM s JOIN t ON t.conv_id = s.conv_id AND t.node_id = s.node_id - 1 WHERE t.cost >= 150""")
def lowering_validation(spark, sf_dir):
    rows = stored(turns(spark, sf_dir))
    chosen = rows.where("cost < 150").select("conv_id", "node_id")
    strange = chosen.where("conv_id % 10 = 0").select("conv_id", F.lit(999).cast("long").alias("node_id")).distinct()
    links = rows.select("conv_id", F.col("node_id").alias("src"), F.explode("deps").alias("dst"))
    return render.lowering_problems(chosen.unionAll(strange), rows, rows.where("role = 'system'"), links, "conv_id")


@query(f"WITH RECURSIVE {_ITEMS}, {_walk('i', 'lang', _STABLE.format('relevance'), ALLOWANCE)} SELECT lang, sum(cost)::BIGINT AS used_tokens, round(sum(cost) / {ALLOWANCE}, 6) AS budget_use FROM s GROUP BY lang")
def budget_utilisation(spark, sf_dir):
    used = metrics.budget_use(selection.relevance_greedy(items(spark, sf_dir), "lang", ALLOWANCE), "lang", ALLOWANCE)
    return used.select("lang", "used_tokens", F.round("budget_use", 6).alias("budget_use"))
