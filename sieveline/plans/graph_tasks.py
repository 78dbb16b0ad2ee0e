"""Selection on a graph that is no chain: lines need their order and their supplier, orders their customer, suppliers and customers
their nation, so that suppliers and nations are shared. Values of hubs are zero or below; costs and values are told by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.operators import selection
from sieveline.queries import query
from sieveline.store import read_table

CUSTOMER_ALLOWANCE, ORDER_ALLOWANCE = 25, 16
#: Values are whole tenths, so that sums and the bonus of a tenth for each dependency are exact.
_LINE = "(l_quantity::INT % 7)::BIGINT * 5 - 5"
_NODES = """y AS MATERIALIZED (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL),
l0 AS MATERIALIZED (SELECT o_custkey AS cust, o_orderkey AS ord, l_linenumber, l_suppkey, c_nationkey, s_nationkey, l_quantity FROM y JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
n AS MATERIALIZED (SELECT DISTINCT {0} AS task, 'l' || ord || ':' || l_linenumber AS node_id, 1 + (l_quantity::INT % 5)::BIGINT AS cost, """ + _LINE + """ AS v, ['o' || ord, 's' || l_suppkey] AS deps FROM l0
UNION ALL SELECT DISTINCT {0}, 'o' || ord, 2, (ord % 3) * 5 - 10, ['c' || cust] FROM l0 UNION ALL SELECT DISTINCT {0}, 's' || l_suppkey, 3, -3, ['n' || s_nationkey] FROM l0
UNION ALL SELECT DISTINCT {0}, 'c' || cust, 2, -2, ['n' || c_nationkey] FROM l0 UNION ALL SELECT DISTINCT {0}, 'n' || k, 1, -1, [] FROM (SELECT cust, ord, c_nationkey AS k FROM l0 UNION ALL SELECT cust, ord, s_nationkey FROM l0)),
g AS MATERIALIZED (SELECT *, v + len(deps) AS gain FROM n),
d AS MATERIALIZED (SELECT task, node_id, unnest(deps) AS dep FROM g),
cl AS MATERIALIZED (SELECT task, node_id AS root, node_id FROM g UNION SELECT a.task, a.node_id, a.dep FROM d a UNION SELECT a.task, a.node_id, b.dep FROM d a JOIN d b ON b.task = a.task AND b.node_id = a.dep UNION SELECT a.task, a.node_id, c.dep FROM d a JOIN d b ON b.task = a.task AND b.node_id = a.dep JOIN d c ON c.task = a.task AND c.node_id = b.dep)"""


def order_graph(spark: SparkSession, sf_dir: str, task: str) -> DataFrame:
    """task (``o_custkey`` or ``o_orderkey``), node_id, cost, value, relevance, uri, deps: each task's lines and what they need, in one partition."""
    t = lambda name: read_table(spark, sf_dir, name)
    # what is sent are keys; names and lists are made where a task's rows have met
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").cast("int").alias("quantity"))
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_nationkey")
    sold = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = selection.by_task(sold.select(F.col(task).cast("long").alias("task"), "o_custkey", "o_orderkey", "l_linenumber", "l_suppkey", "quantity", "c_nationkey", "s_nationkey"), "task")
    name = lambda letter, *keys: F.concat(F.lit(letter), F.concat_ws(":", *keys))
    quantity, none = F.col("quantity"), F.array().cast("array<string>")

    def kind(node, cost, tenths, deps):
        return F.struct(node.alias("node_id"), F.lit(cost).cast("long").alias("cost"), (F.lit(tenths).cast("long") / 10).alias("value"), deps.alias("deps"))

    kinds = F.array(
        kind(name("l", "o_orderkey", "l_linenumber"), 1 + quantity % 5, (quantity % 7) * 5 - 5, F.array(name("o", "o_orderkey"), name("s", "l_suppkey"))),
        kind(name("o", "o_orderkey"), 2, (F.col("o_orderkey") % 3) * 5 - 10, F.array(name("c", "o_custkey"))),
        kind(name("s", "l_suppkey"), 3, -3, F.array(name("n", "s_nationkey"))), kind(name("c", "o_custkey"), 2, -2, F.array(name("n", "c_nationkey"))),
        kind(name("n", "c_nationkey"), 1, -1, none), kind(name("n", "s_nationkey"), 1, -1, none),
    )
    nodes = rows.select("task", F.explode(kinds).alias("n")).select("task", "n.*").distinct()
    return nodes.withColumns({"relevance": F.lit(0.0), "uri": F.col("node_id")})


_DENSITY = f"""{_NODES.format("cust")},
w AS (SELECT DISTINCT task, []::VARCHAR[] AS sel, 0::BIGINT AS used FROM g UNION ALL
SELECT task, list_concat(sel, fresh), used + cost FROM (
  SELECT w.task, w.sel, w.used, c.root, list(c.node_id) AS fresh, sum(m.cost)::BIGINT AS cost, sum(m.gain)::BIGINT AS gain,
    row_number() OVER (PARTITION BY w.task ORDER BY -round(sum(m.gain) / 10 / greatest(1, sum(m.cost)), 12), -sum(m.gain), any_value(r.cost), c.root) AS turn
  FROM w JOIN cl c ON c.task = w.task AND NOT list_contains(w.sel, c.node_id) AND NOT list_contains(w.sel, c.root) JOIN g m ON m.task = c.task AND m.node_id = c.node_id JOIN g r ON r.task = c.task AND r.node_id = c.root
  GROUP BY w.task, w.sel, w.used, c.root HAVING w.used + sum(m.cost) <= {CUSTOMER_ALLOWANCE}) WHERE turn = 1 AND gain > 0),
s AS MATERIALIZED (SELECT task, unnest(sel) AS node_id FROM (SELECT task, arg_max(sel, len(sel)) AS sel FROM w GROUP BY task))"""


@query(f"WITH RECURSIVE {_DENSITY} SELECT task, node_id FROM s")
def density_graph_budget(spark, sf_dir):
    """Each customer's lines with what they need, by density of what a choice adds."""
    return selection.solve(order_graph(spark, sf_dir, "o_custkey"), "task", CUSTOMER_ALLOWANCE, placed=True).select("task", "node_id")


@query(f"""WITH RECURSIVE {_DENSITY}, q AS MATERIALIZED (SELECT s.task, s.node_id, g.cost, g.v, g.deps FROM s JOIN g USING (task, node_id)),
r AS (SELECT DISTINCT task, []::VARCHAR[] AS done FROM q UNION ALL SELECT task, list_append(done, node_id) FROM (SELECT r.task, r.done, q.node_id, row_number() OVER (PARTITION BY r.task ORDER BY -q.v, q.cost, q.node_id) AS turn FROM r JOIN q ON q.task = r.task AND NOT list_contains(r.done, q.node_id) AND list_has_all(r.done, q.deps)) WHERE turn = 1)
SELECT task, unnest(done) AS node_id, generate_subscripts(done, 1)::BIGINT AS rank FROM (SELECT task, arg_max(done, len(done)) AS done FROM r GROUP BY task)""")
def dependency_order(spark, sf_dir):
    """The order in which a choice is rendered: the best value (then the rest of the key) among nodes whose dependencies are out."""
    return selection.solve(order_graph(spark, sf_dir, "o_custkey"), "task", CUSTOMER_ALLOWANCE, placed=True).select("task", "node_id", "rank")


_SUBSETS = f"""{_NODES.format("ord")}, li AS (SELECT task, list(node_id ORDER BY node_id) AS ids FROM g WHERE node_id LIKE 'l%' GROUP BY task),
u AS (SELECT task, k, list_filter(ids, lambda x, i: (k >> (i - 1)) & 1 = 1) AS pick FROM li, LATERAL (SELECT unnest(range(1, 1 << len(ids))) AS k)),
e AS (SELECT DISTINCT u.task, u.k, c.node_id FROM (SELECT task, k, unnest(pick) AS root FROM u) u JOIN cl c ON c.task = u.task AND c.root = u.root),
o AS (SELECT e.task, e.k, sum(gain) AS gain, sum(cost) AS cost FROM e JOIN g USING (task, node_id) GROUP BY ALL HAVING sum(cost) <= {ORDER_ALLOWANCE}),
best AS (SELECT t.task, greatest(0, coalesce(max(gain), 0))::BIGINT AS gain, coalesce(arg_max(cost, (gain, -cost)) FILTER (gain > 0), 0)::BIGINT AS cost FROM (SELECT DISTINCT task FROM g) t LEFT JOIN o USING (task) GROUP BY t.task)"""


@query(f"WITH {_SUBSETS} SELECT task, gain / 10 AS objective, cost AS used, 'optimal' AS status, 0::DOUBLE AS gap FROM best")
def exact_graph_budget(spark, sf_dir):
    """The best closed set of each order, proved. SQL tries all sets of its lines, as nothing else is worth its cost."""
    rows = order_graph(spark, sf_dir, "o_orderkey")
    done = selection.select(rows, "task", ORDER_ALLOWANCE, "ilp").record
    return done.select("task", "objective", "used", "status", "gap")


_RECORD = f"""{_SUBSETS}, m AS (SELECT task, count(*) AS nodes FROM g GROUP BY task),
h AS (SELECT *, (sum(cost) OVER z)::BIGINT AS used, (sum(value) OVER z)::DOUBLE AS objective FROM (SELECT user_id, row_number() OVER x AS n, count(*) OVER (PARTITION BY user_id) AS nodes, 1 + event_id % 3 AS cost, (1 + event_id % 4)::DOUBLE + CASE WHEN row_number() OVER x > 1 THEN 0.1::DOUBLE ELSE 0 END AS value FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)) WINDOW z AS (PARTITION BY user_id ORDER BY n))"""


@query(f"""WITH {_RECORD}
SELECT 'order:' || task AS task, CASE WHEN nodes <= 16 THEN 'brute_force' ELSE 'ilp' END AS strategy, 'optimal' AS status, round(gain / 10, 6) AS objective, cost AS used FROM best JOIN m USING (task)
UNION ALL SELECT 'user:' || user_id, CASE WHEN max(nodes) <= 16 THEN 'brute_force' WHEN max(nodes) <= 120 THEN 'ilp' ELSE 'graph_closure_greedy' END, CASE WHEN max(nodes) <= 120 THEN 'optimal' ELSE 'heuristic' END, round(coalesce(max(objective) FILTER (used <= {ORDER_ALLOWANCE}), 0), 6), coalesce(max(used) FILTER (used <= {ORDER_ALLOWANCE}), 0)::BIGINT FROM h GROUP BY user_id""")
def selection_records(spark, sf_dir):
    """Orders with what they need, and users whose events each need the one before, by the cascade: strategy, status, objective and tokens of each task."""
    orders = order_graph(spark, sf_dir, "o_orderkey").withColumn("task", F.concat(F.lit("order:"), F.col("task").cast("string")))
    events = read_table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    id_of = lambda c: F.format_string("%012d", c)
    users = events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("task"), id_of(F.col("event_id")).alias("node_id"), (1 + F.col("event_id") % 3).alias("cost"), (1.0 + F.col("event_id") % 4).alias("value"), F.when(before.isNotNull(), F.array(id_of(before))).otherwise(F.array().cast("array<string>")).alias("deps"), F.lit(0.0).alias("relevance"), id_of(F.col("event_id")).alias("uri"))
    done = selection.select(orders.unionByName(users), "task", ORDER_ALLOWANCE).record
    return done.select("task", "strategy", "status", F.round("objective", 6).alias("objective"), "used")
