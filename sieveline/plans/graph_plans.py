"""Graph operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import graph
from sieveline.queries import query
from sieveline.sources import tables
from sieveline.store import read_table

_EDGES = """
edges AS MATERIALIZED (
  SELECT 'line:' || l_orderkey || '.' || l_linenumber AS src, 'order:' || l_orderkey AS dst FROM lineitem
  UNION ALL SELECT 'line:' || l_orderkey || '.' || l_linenumber, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'line:' || l_orderkey || '.' || l_linenumber, 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
_SEEDS = "seeds AS MATERIALIZED (SELECT 'order:' || o_orderkey AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"
_CLOSURE = f"WITH RECURSIVE {_EDGES.strip()}, {_SEEDS}, c AS (SELECT node_id FROM seeds UNION SELECT e.dst FROM c JOIN edges e ON e.src = c.node_id)"


def _seeds(spark, sf_dir):
    urgent = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return urgent.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node_id"))


@query("WITH " + _EDGES.strip() + " SELECT split_part(src, ':', 1) AS src_kind, split_part(dst, ':', 1) AS dst_kind, count(*) AS n_edges, count(DISTINCT dst) AS n_targets FROM edges GROUP BY ALL")
def fk_edges(spark, sf_dir):
    kind = lambda c: F.substring_index(c, ":", 1)
    edges = tables.record_edges(spark, sf_dir)
    return edges.groupBy(kind("src").alias("src_kind"), kind("dst").alias("dst_kind")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("dst").alias("n_targets"))


@query(_CLOSURE + " SELECT node_id FROM c")
def dependency_closure(spark, sf_dir):
    return graph.closure(graph.dependency_edges(tables.record_edges(spark, sf_dir)), _seeds(spark, sf_dir))


@query(_CLOSURE + " SELECT node_id FROM c WHERE node_id NOT IN (SELECT node_id FROM seeds)")
def forced_nodes(spark, sf_dir):
    return graph.forced(graph.dependency_edges(tables.record_edges(spark, sf_dir)), _seeds(spark, sf_dir))


@query("SELECT DISTINCT 'customer:' || (o_custkey + 40) AS node_id FROM orders WHERE o_custkey + 40 NOT IN (SELECT c_custkey FROM customer)")
def missing_seeds(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"))
    asked = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), (F.col("o_custkey") + 40).cast("string")).alias("node_id"))
    return graph.missing(customers, asked)


_TURNS = "t AS (SELECT c.conv_id || '.' || c.turn AS src, p.conv_id || '.' || p.turn AS dst, c.role AS src_role, p.role AS dst_role FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)"


@query(f"WITH {_TURNS} SELECT src, dst, 'responds_to' AS edge_type FROM t WHERE src_role IN ('user', 'assistant') AND dst_role IN ('user', 'assistant')")
def induced_subgraph(spark, sf_dir):
    kept = read_table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select(F.concat_ws(".", "conv_id", "turn").alias("node_id"))
    return graph.induced(tables.conversation_edges(spark, sf_dir), kept)


@query(f"""WITH RECURSIVE {_TURNS}, s AS MATERIALIZED (SELECT conv_id || '.' || turn AS node_id FROM conversations WHERE length(text) < 600),
e AS MATERIALIZED (SELECT src, dst FROM t WHERE src IN (FROM s) AND dst IN (FROM s)),
c AS (SELECT conv_id || '.' || turn AS node_id FROM conversations WHERE role = 'system' AND length(text) < 600 UNION SELECT e.src FROM c JOIN e ON e.dst = c.node_id) SELECT node_id FROM c""")
def dependents_cluster(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("role", F.length("text").alias("n"), F.concat_ws(".", "conv_id", "turn").alias("node_id"))
    selected = turns.where("n < 600").select("node_id")
    return graph.dependents(tables.conversation_edges(spark, sf_dir).select("src", "dst"), turns.where("role = 'system' AND n < 600").select("node_id"), selected)


_STEPS = "n AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events), e AS MATERIALIZED (SELECT DISTINCT user_id, user_id || ':' || event_type AS src, user_id || ':' || next_type AS dst FROM n WHERE next_type IS NOT NULL)"


@query(f"""WITH RECURSIVE {_STEPS}, r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst WHERE e.src <> e.dst),
m AS (SELECT DISTINCT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
SELECT src AS node_id, least(src, min(dst)) AS component FROM m GROUP BY src""")
def strong_components(spark, sf_dir):
    return graph.strong_components(tables.transition_edges(spark, sf_dir))


@query("SELECT CASE k WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'order' THEN 3 WHEN 'supplier' THEN 2 WHEN 'part' THEN 0 ELSE 4 END AS level, count(*) AS n_nodes FROM (SELECT DISTINCT split_part(x, ':', 1) AS k, x FROM (WITH " + _EDGES.strip() + " SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) GROUP BY 1")
def topo_levels(spark, sf_dir):
    edges = tables.record_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst")).distinct()
    return graph.levels(edges, nodes).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""WITH RECURSIVE {_STEPS}, p AS (SELECT user_id, [user_id || ':view'] AS path, user_id || ':view' AS here FROM events GROUP BY user_id
UNION ALL SELECT p.user_id, list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.src = p.here WHERE NOT list_contains(p.path, e.dst) AND len(p.path) <= 8 AND p.here <> p.user_id || ':purchase'),
f AS (SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY len(path), path) AS ordinal FROM p WHERE here = user_id || ':purchase')
SELECT user_id, array_to_string(path, '>') AS path, ordinal FROM f WHERE ordinal <= 32""")
def taint_paths(spark, sf_dir):
    """From what a user views to a purchase, over the types of events that led from one to the next."""
    edges = tables.transition_edges(spark, sf_dir)
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    node = lambda kind: F.concat(F.col("user_id").cast("string"), F.lit(f":{kind}")).alias("node_id")
    found = graph.taint_paths(edges, users.select("user_id", node("view")), users.select(node("purchase")), by="user_id")
    return found.select("user_id", F.array_join("path", ">").alias("path"), F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {_TURNS}, b AS (SELECT src AS node_id, dst AS neighbour FROM t UNION SELECT dst, src FROM t) SELECT node_id, count(*) AS n_neighbours, string_agg(neighbour, ',' ORDER BY neighbour) AS neighbours FROM b GROUP BY node_id")
def neighbour_sets(spark, sf_dir):
    found = graph.neighbours(tables.conversation_edges(spark, sf_dir))
    return found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_neighbours"), F.array_join(F.array_sort(F.collect_list("neighbour")), ",").alias("neighbours"))


@query("WITH " + _EDGES.strip() + ", d AS (SELECT src AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY node_id")
def node_degrees(spark, sf_dir):
    edges = tables.record_edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


_HASHED = "h AS (SELECT doc_id, source, lang, 'sha256:' || sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM documents)"


@query(f"WITH {_HASHED} SELECT doc_id AS node_id, successor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY content_hash) AS successor FROM h) WHERE doc_id <> successor")
def supersession_pairs(spark, sf_dir):
    return graph.supersession(tables.copy_edges(spark, sf_dir))[0]


@query(f"WITH {_HASHED} SELECT min(doc_id) AS node_id, content_hash FROM h GROUP BY content_hash")
def supersession_exclusion(spark, sf_dir):
    """The nodes that stay eligible."""
    gone = graph.supersession(tables.copy_edges(spark, sf_dir))[0].select("node_id")
    nodes = tables.document_nodes(spark, sf_dir).select(F.col("doc_id").alias("node_id"), "content")
    from sieveline.functions.text import content_hash

    return nodes.join(gone, "node_id", "left_anti").select("node_id", content_hash(F.col("content")).alias("content_hash"))


@query("SELECT x.doc_id AS src, b.doc_id AS dst, 'CTX200' AS code FROM documents x JOIN (SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text) b ON b.text = x.text WHERE x.source <> b.source")
def conflict_pairs(spark, sf_dir):
    """Equal documents from another source than the first of them contradict its provenance; reported, never blocking."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("dst"), F.min_by("source", "doc_id").alias("first_source"))
    edges = docs.join(first, "h").where("source <> first_source").select(F.col("doc_id").alias("src"), "dst", F.lit("contradicts").alias("edge_type"))
    others = tables.copy_edges(spark, sf_dir).select("src", "dst", "edge_type")  # of other types, which are no conflicts
    return graph.conflicts(edges.unionByName(others)).select("src", "dst", "code")


@query("WITH " + _EDGES.strip() + ", n AS (SELECT 'nation:' || n_nationkey AS node_id FROM nation) SELECT 'in' AS direction, dst AS node_id, split_part(src, ':', 1) AS other, count(*) AS n_edges FROM edges WHERE dst IN (FROM n) GROUP BY ALL UNION ALL SELECT 'out', src, split_part(dst, ':', 1), count(*) FROM edges WHERE src IN (FROM n) GROUP BY ALL")
def incident_edges(spark, sf_dir):
    """The edges into and out of each nation."""
    edges = tables.record_edges(spark, sf_dir)
    nations = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node_id"))
    counted = lambda df, way, own, other: df.groupBy(F.lit(way).alias("direction"), F.col(own).alias("node_id"), F.substring_index(other, ":", 1).alias("other")).agg(F.count(F.lit(1)).alias("n_edges"))
    return counted(graph.incoming(edges, nations, ("requires",)), "in", "dst", "src").unionAll(counted(graph.outgoing(edges, nations, ("requires",)), "out", "src", "dst"))


@query("WITH " + _EDGES.strip() + """, gone AS (SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0), nodes AS (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges)
SELECT 'node' AS what, split_part(node_id, ':', 1) AS kind, count(*) AS n FROM nodes WHERE node_id NOT IN (FROM gone) GROUP BY ALL
UNION ALL SELECT 'edge', split_part(src, ':', 1), count(*) FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) GROUP BY ALL
UNION ALL SELECT 'unknown', 'customer', count(*) FROM gone WHERE node_id NOT IN (FROM nodes)""")
def graph_removal(spark, sf_dir):
    """The record graph without customers in debt: their edges go with them."""
    edges = tables.record_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst")).distinct()
    gone = read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"))
    kept, left, unknown = graph.remove_nodes(nodes, edges, gone)
    counted = lambda df, what, column: df.groupBy(F.lit(what).alias("what"), F.substring_index(column, ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted(kept, "node", "node_id").unionAll(counted(left, "edge", "src")).unionAll(unknown.agg(F.lit("unknown"), F.lit("customer"), F.count(F.lit(1))))


@query("""SELECT CASE WHEN o_custkey % 5 = 0 THEN 'collision' ELSE 'kept' END AS outcome, count(*) AS n_nodes FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) GROUP BY 1""".replace("SELECT CASE", "WITH c AS (SELECT o_custkey FROM orders) SELECT CASE").replace("WHEN o_custkey % 5 = 0", "WHEN o_custkey % 5 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey IN (FROM c)"))
def graph_addition(spark, sf_dir):
    """Customers, to whom those of the orders are added; every fifth of these has other content under its id."""
    nodes = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("content_hash"))
    asked = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"))
    other = F.when((F.col("node_id") % 5 == 0) & F.col("node_id").isNotNull(), F.concat(F.col("node_id").cast("string"), F.lit("!"))).otherwise(F.col("node_id").cast("string"))
    all_nodes, collisions = graph.add_nodes(nodes, asked.select("node_id", F.sha2(other, 256).alias("content_hash")))
    wrong = collisions.withColumn("outcome", F.lit("collision"))
    joined = all_nodes.join(wrong, "node_id", "left").select(F.coalesce("outcome", F.lit("kept")).alias("outcome"))
    return joined.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_nodes"))


def _reply_graph(spark, sf_dir):
    """Assistant turns need the turn before; ids fall with turns, so that the order of ids runs against the dependencies."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", (1000 - F.col("turn")).alias("node_id"), "role")
    return turns.select("conv_id", "node_id"), turns.where("role = 'assistant'").select("conv_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))


@query("""WITH t AS (SELECT conv_id, turn, max(CASE WHEN role <> 'assistant' OR turn = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, 1000 - turn AS node_id, row_number() OVER (PARTITION BY conv_id ORDER BY block DESC, turn) AS place FROM t""")
def topological_order(spark, sf_dir):
    return graph.topological_order(*_reply_graph(spark, sf_dir), "conv_id")[0]


@query(f"""WITH RECURSIVE {_STEPS}, r AS (SELECT user_id, src, dst FROM e WHERE src <> dst UNION SELECT r.user_id, r.src, e.dst FROM r JOIN e ON e.src = r.dst WHERE e.src <> e.dst)
SELECT DISTINCT user_id, 'CTX320' AS code FROM r WHERE src = dst""")
def cycle_diagnostics(spark, sf_dir):
    """Users whose types of events lead round in a circle have no order."""
    edges = tables.transition_edges(spark, sf_dir).distinct()
    nodes = edges.select("user_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return graph.topological_order(nodes, edges, "user_id")[1]


@query("""WITH t AS (SELECT c.conv_id, c.turn FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)
SELECT conv_id || '.' || turn AS src, 'edge-' || substr(sha256('{"confidence":1.0,"edge_type":"responds_to","evidence":{"turn":' || turn || '},"schema_version":1,"source_node_id":"' || conv_id || '.' || turn || '","target_node_id":"' || conv_id || '.' || (turn - 1) || '"}'), 1, 24) AS edge_id FROM t""")
def edge_identities(spark, sf_dir):
    edges = tables.conversation_edges(spark, sf_dir)
    evidence = F.concat(F.lit('{"turn":'), F.substring_index("src", ".", -1), F.lit("}"))
    return edges.select("src", graph.edge_identity(F.col("src"), F.col("dst"), F.col("edge_type"), F.lit(1.0), evidence).alias("edge_id"))
