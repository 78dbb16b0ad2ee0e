"""Metrics of selections on the given tables. A document's lines are blocks of 500 characters; of a source's documents those
labelled good are required, and the neighbours (next id) of a required one are accepted. Spans run over the source's lines:
documents that start close to each other share some."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import metrics, selection
from sieveline.plans import selection_plans as sp
from sieveline.plans.text_plans import LINES_SQL
from sieveline.queries import query
from sieveline.sources import tables
from sieveline.store import read_table, stored

#: A strategy is a rule of choice, so that one query evaluates several at once.
STRATEGIES = {"short": "n_chars < 1500", "even": "doc_id % 2 = 0", "all": "true"}
_SPANS = """d AS MATERIALIZED (SELECT doc_id, source AS uri, (doc_id % 97)::INT AS start_line, (doc_id % 97 + n_chars // 500)::INT AS end_line, (1 + n_chars // 4)::BIGINT AS tokens, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)),
s AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, * FROM d WHERE {v}" for k, v in STRATEGIES.items()) + """),
st AS (SELECT DISTINCT strategy FROM s), req AS (SELECT strategy, d.* FROM d, st WHERE quality = 1),
acc AS (SELECT strategy, d.* FROM d, st WHERE doc_id - 1 IN (SELECT doc_id FROM d WHERE quality = 1)), fine AS (FROM req UNION ALL FROM acc)"""
_LINES = "SELECT strategy, uri, unnest(range(start_line, end_line + 1)) AS line FROM {0}"


def spans(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    start = (F.col("doc_id") % 97).cast("int")
    end = (F.col("doc_id") % 97 + F.floor(F.col("n_chars") / 500)).cast("int")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.col("doc_id").alias("node_id"), F.col("doc_id").alias("rank"), F.col("source").alias("uri"), start.alias("start_line"), end.alias("end_line"), (1 + F.floor(F.col("n_chars") / 4)).alias("tokens"), "n_chars", "quality")
    names = F.array_compact(F.array(*[F.when(F.expr(rule.replace(" = ", " == ")), F.lit(name)) for name, rule in STRATEGIES.items()]))
    chosen = rows.withColumn("strategy", F.explode(names))
    each = F.explode(F.array(*[F.lit(s) for s in STRATEGIES]))
    good = rows.where("quality = 1")
    required = good.withColumn("strategy", each)
    accepted = rows.join(good.select((F.col("doc_id") + 1).alias("doc_id")), "doc_id", "left_semi").withColumn("strategy", each)
    return chosen, required, accepted


@query(f"""WITH {_SPANS}, n AS (SELECT DISTINCT strategy, uri FROM req), h AS (SELECT DISTINCT strategy, uri FROM s),
r AS (SELECT n.strategy, count(h.uri) / count(*) AS file_recall FROM n LEFT JOIN h USING (strategy, uri) GROUP BY n.strategy),
x AS (SELECT DISTINCT strategy, uri FROM fine), p AS (SELECT h.strategy, count(x.uri) / count(*) AS file_precision FROM h LEFT JOIN x USING (strategy, uri) GROUP BY h.strategy)
SELECT strategy, round(file_recall, 6) AS file_recall, round(file_precision, 6) AS file_precision FROM r JOIN p USING (strategy)""")
def file_recall_precision(spark, sf_dir):
    chosen, required, accepted = spans(spark, sf_dir)
    found = metrics.file_metrics(chosen, required, accepted, "strategy")
    return found.select("strategy", F.round("file_recall", 6).alias("file_recall"), F.round("file_precision", 6).alias("file_precision"))


@query(f"""WITH {_SPANS}, n AS (SELECT DISTINCT * FROM ({_LINES.format('req')})), h AS (SELECT DISTINCT * FROM ({_LINES.format('s')}))
SELECT n.strategy, round(count(h.line) / count(*), 6) AS span_recall FROM n LEFT JOIN h USING (strategy, uri, line) GROUP BY n.strategy""")
def span_recall(spark, sf_dir):
    chosen, required, _ = spans(spark, sf_dir)
    return metrics.span_recall(chosen, required, "strategy").select("strategy", F.round("span_recall", 6).alias("span_recall"))


@query(f"""WITH {_SPANS}, n AS (SELECT DISTINCT * FROM ({_LINES.format('fine')})), c AS (SELECT strategy, uri, doc_id, tokens / (end_line - start_line + 1) AS share, unnest(range(start_line, end_line + 1)) AS line FROM s),
m AS (SELECT c.*, n.line IS NOT NULL AS good, row_number() OVER (PARTITION BY c.strategy, c.uri, c.line ORDER BY doc_id) AS turn FROM c LEFT JOIN n ON n.strategy = c.strategy AND n.uri = c.uri AND n.line = c.line)
SELECT strategy, round(coalesce(sum(share) FILTER (good AND turn = 1), 0) / sum(share), 6) AS useful_ratio, round(coalesce(sum(share) FILTER (good AND turn > 1), 0) / sum(share), 6) AS redundant_ratio, round(coalesce(sum(share) FILTER (NOT good), 0) / sum(share), 6) AS unsupported_ratio FROM m GROUP BY strategy""")
def useful_redundant_unsupported(spark, sf_dir):
    chosen, required, accepted = spans(spark, sf_dir)
    names = ("useful_ratio", "redundant_ratio", "unsupported_ratio")
    return metrics.token_ratios(chosen, required.unionByName(accepted), "strategy").select("strategy", *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {_SPANS} SELECT strategy, uri, count(DISTINCT line) AS n_lines, count(*) AS n_line_units FROM ({_LINES.format('s')}) GROUP BY ALL")
def line_units(spark, sf_dir):
    chosen, *_ = spans(spark, sf_dir)
    return metrics.lines(chosen, "strategy").groupBy("strategy", "uri").agg(F.count_distinct("line").alias("n_lines"), F.count(F.lit(1)).alias("n_line_units"))


_DEPS = "dep AS (SELECT strategy, a.source AS src, b.source AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1, st WHERE a.lang <> b.lang)"


@query(f"""WITH {_SPANS}, {_DEPS}, h AS (SELECT DISTINCT strategy, uri FROM s) SELECT dep.strategy, round(count(*) FILTER (x.uri IS NOT NULL AND y.uri IS NOT NULL) / count(*), 6) AS dependency_coverage
FROM dep LEFT JOIN h x ON x.strategy = dep.strategy AND x.uri = dep.src LEFT JOIN h y ON y.strategy = dep.strategy AND y.uri = dep.dst GROUP BY dep.strategy""")
def dependency_coverage(spark, sf_dir):
    """A document depends on the next one if that has another language."""
    chosen, *_ = spans(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("dst"), F.col("lang").alias("next_lang"))
    pairs = docs.join(following, "doc_id").where("lang <> next_lang").select(F.explode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("strategy"), F.col("source").alias("src"), "dst")
    return metrics.dependency_coverage(chosen, pairs, "strategy").select("strategy", F.round("dependency_coverage", 6).alias("dependency_coverage"))


_RUN = "strategy || '|' || uri"


@query(f"""WITH {_SPANS}, n AS (SELECT DISTINCT * FROM ({_LINES.format('req')})), h AS (SELECT DISTINCT * FROM ({_LINES.format('s')})),
r AS (SELECT n.strategy, n.uri, count(h.line) / count(*) AS recall FROM n LEFT JOIN h USING (strategy, uri, line) GROUP BY ALL), b AS (SELECT strategy, uri, sum(tokens)::BIGINT AS used FROM s GROUP BY ALL)
SELECT strategy, (sum(round(coalesce(recall, 1) * 1000000)::BIGINT) // count(*))::BIGINT / 1000000 AS mean_recall, (sum(used) * 10 // count(*))::BIGINT / 1000000 AS mean_budget_use, count(*) AS n_runs FROM b LEFT JOIN r USING (strategy, uri) GROUP BY strategy""")
def strategy_means(spark, sf_dir):
    """Unweighted means over runs; a run is a strategy's choice of one source's documents. Means are whole millionths, summed as whole
    numbers and rounded down, so that they depend neither on the order of additions nor on ties."""
    chosen, required, _ = spans(spark, sf_dir)
    run = lambda df: df.withColumn("run", F.concat_ws("|", "strategy", "uri"))
    recall = metrics.span_recall(run(chosen), run(required), "run").withColumnRenamed("run", "r_run")
    use = metrics.budget_use(run(chosen).withColumn("cost", F.col("tokens")), "run", 100_000)
    rows = use.join(recall, F.col("run") == F.col("r_run"), "left").select(F.substring_index("run", "|", 1).alias("strategy"), F.coalesce("span_recall", F.lit(1.0)).alias("recall"), "used_tokens")
    return metrics.means(rows, "strategy", {"mean_recall": F.round(F.col("recall") * 1e6), "mean_budget_use": F.col("used_tokens") * 10})


@query(f"""WITH {sp._TURNS}, k AS (SELECT conv_id, max(node_id) AS last, sum(cost) FILTER (node_id <= 3) AS cost, bool_or(role = 'system' AND node_id <= 3) AS barred, sum(cost) FILTER (node_id = 0) AS first FROM t GROUP BY conv_id)
SELECT CASE WHEN last >= 3 AND (barred OR cost > 300) THEN 'infeasible' WHEN first <= 300 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n_tasks FROM k GROUP BY 1""")
def suite_status(spark, sf_dir):
    """Conversations as tasks: infeasible where what is mandatory isn't allowed or doesn't fit, failed where nothing fits."""
    rows = stored(sp.turns(spark, sf_dir))
    wrong = selection.mandatory_problems(rows, "conv_id", rows.where("node_id = 3"), rows.where("role <> 'system'"), 300).select(F.col("conv_id").alias("w_conv"), "code")
    chosen = selection.solve(rows, "conv_id", 300).select(F.col("conv_id").alias("c_conv")).distinct()
    tasks = rows.select("conv_id").distinct().join(wrong, F.col("conv_id") == F.col("w_conv"), "left").join(chosen, F.col("conv_id") == F.col("c_conv"), "left")
    status = F.when(F.col("code").isNotNull(), "infeasible").when(F.col("c_conv").isNotNull(), "completed").otherwise("failed")
    return tasks.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_tasks"))


@query("""WITH e AS (SELECT c.conv_id, c.turn FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
r AS (SELECT c.conv_id, count(e.turn) / count(*) AS v FROM conversations c LEFT JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn GROUP BY c.conv_id),
x AS (SELECT conv_id, count(*) FILTER (length(text) >= 300) / count(*) AS v FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id),
y AS (SELECT conv_id, count(*) FILTER ((length(text) % 3 = 0) = (turn % 2 = 0)) / count(*) AS v FROM conversations GROUP BY conv_id)
SELECT c.conv_id, round(coalesce(r.v, 1), 6) AS relation_coverage, round(coalesce(x.v, 1), 6) AS superseded_exclusion, round(coalesce(y.v, 1), 6) AS security_correctness FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id) LEFT JOIN x USING (conv_id) LEFT JOIN y USING (conv_id)""")
def incident_metrics(spark, sf_dir):
    """Conversations as incidents: replies wanted to every turn, even turns as superseded, short turns as selected."""
    turns = read_table(spark, sf_dir, "conversations")
    wanted = turns.select("conv_id", F.concat_ws(".", "conv_id", "turn").alias("src"), F.concat_ws(".", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("dst"), F.lit("responds_to").alias("edge_type"))
    edges = tables.conversation_edges(spark, sf_dir).withColumn("conv_id", F.substring_index("src", ".", 1).cast("long"))
    node = turns.select("conv_id", F.col("turn").alias("node_id"), "text")
    act = lambda condition: F.when(condition, "redact").otherwise("none").alias("action")
    found = metrics.incident_metrics(edges, wanted, node.where("node_id % 2 = 0"), node.where(F.length("text") < 300), node.select("conv_id", "node_id", act(F.length("text") % 3 == 0)), node.select("conv_id", "node_id", act(F.col("node_id") % 2 == 0)), "conv_id")
    return found.select("conv_id", *[F.round(n, 6).alias(n) for n in ("relation_coverage", "superseded_exclusion", "security_correctness")])


_CHOSEN = " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, lang, node_id, cost, rank FROM (WITH RECURSIVE {sp._walk('i', 'lang', order, sp.ALLOWANCE, where)} SELECT lang, node_id, cost, rank FROM s)"
    for name, order, where in (("density_greedy", sp._STABLE.format("value / greatest(1, cost)"), "value > 0"), ("naive", "uri, node_id", "true"), ("relevance_greedy", sp._STABLE.format("relevance"), "true"))
)
_RUNS = f"""{sp._ITEMS}, a AS MATERIALIZED ({_CHOSEN}),
d AS MATERIALIZED (SELECT doc_id, lang, source AS uri, (doc_id % 97)::INT AS start_line, (doc_id % 97 + n_chars // 500)::INT AS end_line, quality FROM documents LEFT JOIN labels USING (doc_id)),
st AS (SELECT unnest(['density_greedy', 'naive', 'relevance_greedy']) AS strategy), rn AS MATERIALIZED (SELECT strategy, lang FROM st, (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL)),
req AS (SELECT strategy, d.* FROM d, st WHERE quality = 1), acc AS (SELECT strategy, d.* FROM d, st WHERE doc_id - 1 IN (SELECT doc_id FROM d WHERE quality = 1)),
se AS MATERIALIZED (SELECT a.strategy, a.lang, a.node_id, a.rank, a.cost AS tokens, d.uri, d.start_line, d.end_line FROM a JOIN d ON d.doc_id = a.node_id),
nf AS (SELECT DISTINCT strategy, lang, uri FROM req), ff AS (FROM nf UNION SELECT strategy, lang, uri FROM acc), hf AS (SELECT DISTINCT strategy, lang, uri FROM se),
nl AS (SELECT DISTINCT strategy, lang, uri, unnest(range(start_line, end_line + 1)) AS line FROM req), fl AS MATERIALIZED (FROM nl UNION SELECT DISTINCT strategy, lang, uri, unnest(range(start_line, end_line + 1)) FROM acc),
sl AS MATERIALIZED (SELECT strategy, lang, uri, node_id, rank, tokens / (end_line - start_line + 1) AS share, unnest(range(start_line, end_line + 1)) AS line FROM se), hl AS (SELECT DISTINCT strategy, lang, uri, line FROM sl),
dp AS (SELECT st.strategy, x.lang, x.uri AS src, y.uri AS dst FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 AND y.lang = x.lang, st),
m1 AS (SELECT nf.strategy, nf.lang, count(hf.uri) / count(*) AS v FROM nf LEFT JOIN hf USING (strategy, lang, uri) GROUP BY ALL), m2 AS (SELECT hf.strategy, hf.lang, count(ff.uri) / count(*) AS v FROM hf LEFT JOIN ff USING (strategy, lang, uri) GROUP BY ALL),
m3 AS (SELECT nl.strategy, nl.lang, count(hl.line) / count(*) AS v FROM nl LEFT JOIN hl USING (strategy, lang, uri, line) GROUP BY ALL),
m4 AS (SELECT dp.strategy, dp.lang, count(*) FILTER (x.uri IS NOT NULL AND y.uri IS NOT NULL) / count(*) AS v FROM dp LEFT JOIN hf x ON x.strategy = dp.strategy AND x.lang = dp.lang AND x.uri = dp.src LEFT JOIN hf y ON y.strategy = dp.strategy AND y.lang = dp.lang AND y.uri = dp.dst GROUP BY ALL),
tl AS (SELECT sl.*, fl.line IS NOT NULL AS good, row_number() OVER (PARTITION BY sl.strategy, sl.lang, sl.uri, sl.line ORDER BY rank, node_id) AS turn FROM sl LEFT JOIN fl ON fl.strategy = sl.strategy AND fl.lang = sl.lang AND fl.uri = sl.uri AND fl.line = sl.line),
m5 AS (SELECT strategy, lang, coalesce(sum(share) FILTER (good AND turn = 1), 0) / sum(share) AS u, coalesce(sum(share) FILTER (good AND turn > 1), 0) / sum(share) AS r, coalesce(sum(share) FILTER (NOT good), 0) / sum(share) AS x FROM tl GROUP BY ALL),
m6 AS (SELECT strategy, lang, sum(tokens) / {sp.ALLOWANCE} AS v FROM se GROUP BY ALL),
ms AS (SELECT rn.strategy, rn.lang, round(coalesce(m1.v, 1), 9) AS file_recall, round(coalesce(m2.v, 1), 9) AS file_precision, round(coalesce(m3.v, 1), 9) AS span_recall, round(coalesce(m4.v, 1), 9) AS dependency_coverage, round(coalesce(m5.u, 1), 9) AS useful_ratio,
 round(coalesce(m5.r, 0), 9) AS redundant_ratio, round(coalesce(m5.x, 0), 9) AS unsupported_ratio, round(coalesce(m6.v, 0), 9) AS budget_use
 FROM rn LEFT JOIN m1 USING (strategy, lang) LEFT JOIN m2 USING (strategy, lang) LEFT JOIN m3 USING (strategy, lang) LEFT JOIN m4 USING (strategy, lang) LEFT JOIN m5 USING (strategy, lang) LEFT JOIN m6 USING (strategy, lang))"""


def runs(spark, sf_dir):
    """strategy, lang and the metrics of each selection strategy's run over each language's documents, to nine places. A run must cover the
    lines of its language's good documents; those next to a good one are accepted; a document depends on the next one of its language."""
    items = sp.items(spark, sf_dir)
    strategies = {"density_greedy": selection.density_greedy, "naive": selection.naive, "relevance_greedy": selection.relevance_greedy}
    picked = [choose(items, "lang", sp.ALLOWANCE).select(F.lit(name).alias("strategy"), "node_id", "cost", "rank") for name, choose in strategies.items()]
    chosen = stored(reduce(DataFrame.unionAll, picked))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    line = (F.col("doc_id") % 97).cast("int")
    docs = read_table(spark, sf_dir, "documents").where("lang IS NOT NULL").join(labels, "doc_id", "left")
    rows = stored(docs.select("doc_id", "lang", F.col("source").alias("uri"), line.alias("start_line"), (F.col("doc_id") % 97 + F.floor(F.col("n_chars") / 500)).cast("int").alias("end_line"), "quality"))
    each = lambda df: df.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies)))).withColumn("run", run)
    run = F.concat_ws("|", "strategy", "lang")
    selected = stored(chosen.join(rows, F.col("node_id") == F.col("doc_id")).select(run.alias("run"), "node_id", "rank", "uri", "start_line", "end_line", F.col("cost").alias("tokens")))
    good = rows.where("quality = 1")
    accepted = rows.join(good.select((F.col("doc_id") + 1).alias("doc_id")), "doc_id", "left_semi")
    following = rows.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("uri").alias("dst"))
    needs = rows.join(following, ["doc_id", "lang"]).select("lang", F.col("uri").alias("src"), "dst")
    measured = metrics.run_metrics(each(rows.select("lang").distinct()), selected, each(good), each(accepted), each(needs), "run", sp.ALLOWANCE)
    return measured.select("strategy", "lang", *[F.round(name, 9).alias(name) for name in metrics.EMPTY])


@query(f"WITH RECURSIVE {_RUNS} SELECT strategy, lang, {', '.join(f'round({m}, 6) AS {m}' for m in metrics.EMPTY)} FROM ms")
def run_metrics(spark, sf_dir):
    """All metrics of each strategy's run over each language."""
    return runs(spark, sf_dir).select("strategy", "lang", *[F.round(name, 6).alias(name) for name in metrics.EMPTY])


@query(f"WITH RECURSIVE {_RUNS} SELECT strategy, {', '.join(f'(sum(round({m} * 1000000)::BIGINT) // count(*))::BIGINT / 1000000 AS {m}' for m in metrics.EMPTY)}, count(*) AS n_runs FROM ms GROUP BY strategy")
def strategy_report(spark, sf_dir):
    """The unweighted mean of every metric over a strategy's runs."""
    return metrics.means(runs(spark, sf_dir), "strategy", {name: F.round(F.col(name) * 1e6) for name in metrics.EMPTY})


@query(f"""WITH d AS (SELECT doc_id, source, 'doc://' || doc_id AS uri, doc_id % 40 AS start_line, doc_id % 40 + doc_id % 9 - 1 AS end_line, {LINES_SQL} AS n_lines FROM documents),
p AS (SELECT *, 'no_reason' AS problem FROM d WHERE doc_id % 11 = 0 UNION ALL SELECT *, 'bad_bounds' FROM d WHERE start_line < 1 OR end_line < start_line UNION ALL SELECT *, 'no_source' FROM d WHERE doc_id % 13 = 0
UNION ALL SELECT *, 'beyond_source' FROM d WHERE doc_id % 13 <> 0 AND end_line > greatest(1, n_lines) UNION ALL SELECT *, 'unchanged_source' FROM d WHERE doc_id % 7 = 0) SELECT source, uri, start_line::INT AS start_line, end_line::INT AS end_line, problem FROM p""")
def span_validation(spark, sf_dir):
    """A span of each document, held against the document's own lines: some have bad bounds or end beyond it, lack a reason, a source or a change."""
    docs = read_table(spark, sf_dir, "documents").where("source IS NOT NULL")
    rows = docs.select("doc_id", "source", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), tx.line_count(F.col("text")).alias("n_lines"))
    at = F.col("doc_id") % 40
    spans = rows.select("source", "uri", at.cast("int").alias("start_line"), (at + F.col("doc_id") % 9 - 1).cast("int").alias("end_line"), F.when(F.col("doc_id") % 11 == 0, " ").otherwise("needed").alias("reason"))
    return metrics.span_problems(spans, rows.where("doc_id % 13 <> 0").select("uri", "n_lines"), rows.where("doc_id % 7 <> 0"), "source")


@query("""WITH d AS (SELECT source, doc_id, doc_id % 97 AS s, doc_id % 97 + n_chars // 500 AS e FROM documents WHERE source IS NOT NULL), n AS (SELECT *, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM d WINDOW w AS (PARTITION BY source ORDER BY s, doc_id))
SELECT source, count(*) AS n_pairs, count(*) FILTER (least(e, e2) >= greatest(s, s2)) AS n_overlapping, sum(greatest(0, least(e, e2) - greatest(s, s2) + 1))::BIGINT AS shared_lines FROM n WHERE s2 IS NOT NULL GROUP BY source""")
def span_overlaps(spark, sf_dir):
    """How many lines each span shares with the one that starts next in its source."""
    line = F.col("doc_id") % 97
    rows = read_table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id", line.alias("s"), (line + F.floor(F.col("n_chars") / 500)).alias("e"))
    order = Window.partitionBy("source").orderBy("s", "doc_id")
    pairs = rows.select("source", "s", "e", F.lead("s").over(order).alias("s2"), F.lead("e").over(order).alias("e2")).where("s2 IS NOT NULL")
    shared = tx.overlap_lines(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))
    return pairs.select("source", shared.alias("shared")).groupBy("source").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("shared") > 0).alias("n_overlapping"), F.sum("shared").alias("shared_lines"))
