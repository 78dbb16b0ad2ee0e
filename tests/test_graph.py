"""Hand-checkable graphs: closures, cycles, order, taint."""

import random

import pytest

from sieveline.operators import graph


def edges(spark, *triples):
    return spark.createDataFrame([(a, b, k) for a, k, b in triples], "src string, dst string, edge_type string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def names(df, column="node_id"):
    return sorted(r[column] for r in df.collect())


def test_closure_forced_and_missing(spark):
    all_edges = edges(spark, ("a", "requires", "b"), ("b", "imports", "c"), ("a", "conflicts", "d"))
    links, seeds = graph.dependency_edges(all_edges), ids(spark, "a", "missing")
    nodes = ids(spark, "a", "b", "c", "d")
    known = seeds.join(nodes, "node_id", "left_semi")
    assert names(graph.closure(links, known)) == ["a", "b", "c"]
    assert names(graph.forced(links, known)) == ["b", "c"]
    assert names(graph.missing(nodes, seeds)) == ["missing"]


def test_cycles_whatever_the_order(spark):
    triples = [("a", "calls", "b"), ("b", "calls", "a"), ("c", "imports", "d"), ("d", "requires", "c")]
    for order in (triples, triples[::-1]):
        found = graph.strong_components(edges(spark, *order)).collect()
        assert sorted((r.node_id, r.component) for r in found) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert names(graph.closure(graph.dependency_edges(edges(spark, *triples)), ids(spark, "a"))) == ["a", "b"]
    assert graph.levels(edges(spark, *triples), ids(spark, "a", "b", "c", "d")).count() == 0


def test_levels_and_closure_by_seed(spark):
    chain = edges(spark, ("a", "requires", "b"), ("b", "requires", "c"))
    assert {r.node_id: r.level for r in graph.levels(chain, ids(spark, "a", "b", "c")).collect()} == {"c": 0, "b": 1, "a": 2}
    pairs = graph.closure_by_seed(chain, ids(spark, "a", "b")).collect()
    assert sorted((r.seed, r.node_id) for r in pairs) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c")]


def test_taint_paths_stop_at_the_sink(spark):
    flow = edges(spark, ("a", "taints", "c"), ("a", "taints", "b"), ("b", "enables", "a"), ("b", "taints", "sink"), ("c", "taints", "sink"))
    found = graph.taint_paths(flow, ids(spark, "a"), ids(spark, "sink"), 4, 8).collect()
    assert sorted(r.path for r in found) == [["a", "b", "sink"], ["a", "c", "sink"]]
    assert graph.taint_paths(flow, ids(spark, "a"), ids(spark, "sink"), 4, 1).first().path == ["a", "b", "sink"]


def test_supersession_and_subgraph(spark):
    replaced = edges(spark, ("old", "supersedes", "new"), ("x", "supersedes", "y"), ("x", "supersedes", "z"))
    good, wrong = graph.supersession(replaced)
    assert [(r.node_id, r.successor) for r in good.collect()] == [("old", "new")] and names(wrong) == ["x"]
    assert graph.induced(replaced, ids(spark, "x", "y", "old")).count() == 1
    cluster = graph.dependents(edges(spark, ("a", "requires", "b"), ("b", "requires", "c"), ("q", "requires", "c")).select("src", "dst"), ids(spark, "c"), ids(spark, "a", "b"))
    assert names(cluster) == ["a", "b", "c"]


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((12, 16), (40, 60), (25, 80)):
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        reach = {k: {k} for k in range(n)}
        for _ in range(n):
            for a, b in pairs:
                reach[a] |= reach[b]
        parts = {k: frozenset(j for j in range(n) if j in reach[k] and k in reach[j]) for k in range(n)}
        want = sorted((k, min(p)) for k, p in parts.items() if len(p) > 1)
        got = graph.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
        assert sorted((r.node_id, r.component) for r in got) == want


def test_edits_and_order(spark):
    nodes = spark.createDataFrame([("a", "1"), ("b", "2")], "node_id string, content_hash string")
    added = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("d", "4"), ("d", "5")], "node_id string, content_hash string")
    whole, wrong = graph.add_nodes(nodes, added)
    assert names(whole) == ["a", "b", "c"] and names(wrong) == ["b", "d"]
    all_edges = edges(spark, ("a", "calls", "b"), ("b", "imports", "c"), ("c", "calls", "a"))
    kept, left, unknown = graph.remove_nodes(whole, all_edges, ids(spark, "b", "zz"))
    assert names(kept) == ["a", "c"] and [(r.src, r.dst) for r in left.collect()] == [("c", "a")] and names(unknown) == ["zz"]
    assert names(graph.outgoing(all_edges, ids(spark, "b"), ("calls",)), "dst") == [] and names(graph.incoming(all_edges, ids(spark, "b")), "src") == ["a"]
    table = spark.createDataFrame([(1, "z"), (1, "b"), (1, "a"), (2, "p"), (2, "q")], "t long, node_id string")
    links = spark.createDataFrame([(1, "a", "z"), (2, "p", "q"), (2, "q", "p")], "t long, src string, dst string")
    order, cycles = graph.topological_order(table, links, "t")
    assert [r.node_id for r in order.orderBy("t", "place").collect()] == ["b", "z", "a"] and [(r.t, r.code) for r in cycles.collect()] == [(2, "CTX320")]
    with pytest.raises(Exception, match="too many nodes"):
        graph.topological_order(table, links, "t", most=2)
