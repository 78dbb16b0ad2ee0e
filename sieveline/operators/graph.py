"""Operators on a property graph held as edges (src, dst, edge_type); all iterate on DataFrames and write each round."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.store import stored

#: The edge types that carry dependencies unless others are named, and those that carry taint.
DEPENDENCY = ("calls", "imports", "requires")
TAINT = ("enables", "taints")
#: The edge types that record a conflict, and its code.
CONFLICT, CONFLICT_CODE = ("contradicts", "conflicts"), "CTX200"


def dependency_edges(edges: DataFrame, types: tuple[str, ...] = DEPENDENCY) -> DataFrame:
    """Parallel edges stay; what walks over them keeps distinct nodes."""
    return edges.where(F.col("edge_type").isin(*types)).select("src", "dst")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_id of the seeds and all they depend on. A round joins only the new frontier."""
    links = edges.select(F.col("src").alias("node_id"), "dst")
    frontier = stored(seeds.select("node_id").distinct())
    reached = frontier
    while not frontier.isEmpty():
        frontier = stored(frontier.join(links, "node_id").select(F.col("dst").alias("node_id")).distinct().join(reached, "node_id", "left_anti"))
        reached = reached.unionAll(frontier)
    return reached


def closure_by_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node_id: the closure of each seed on its own."""
    links = edges.select(F.col("src").alias("node_id"), "dst")
    frontier = stored(seeds.select(F.col("node_id").alias("seed"), "node_id").distinct())
    reached = frontier
    while not frontier.isEmpty():
        frontier = stored(frontier.join(links, "node_id").select("seed", F.col("dst").alias("node_id")).distinct().join(reached, ["seed", "node_id"], "left_anti"))
        reached = reached.unionAll(frontier)
    return reached


def forced(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What the closure adds to the seeds."""
    return closure(edges, seeds).join(seeds.select("node_id"), "node_id", "left_anti")


def missing(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    return seeds.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges with both ends among the kept nodes."""
    ids = kept.select("node_id").distinct()
    return edges.join(ids, edges["src"] == ids["node_id"], "left_semi").join(ids, edges["dst"] == ids["node_id"], "left_semi")


def dependents(edges: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """The candidates and the selected nodes that need them, directly or through selected nodes."""
    within = induced(edges, selected.unionByName(candidates.select("node_id")).distinct())
    return closure(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), candidates)


def _trimmed(links: DataFrame) -> DataFrame:
    """The links between nodes that others lead to and that lead to others; the rest is in no cycle."""
    before = -1
    while (now := links.count()) != before:
        before = now
        links = stored(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    return links


def _least_reaching(links: DataFrame) -> DataFrame:
    """node_id, label: the least node from which each node is reached, itself included."""
    labels = stored(links.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("label", F.col("node_id")))
    seen = None
    while (state := labels.agg(F.sum(F.xxhash64("node_id", "label").cast("decimal(38,0)"))).first()) != seen:
        seen = state
        sent = links.join(labels, F.col("src") == F.col("node_id")).select(F.col("dst").alias("node_id"), "label")
        labels = stored(labels.unionAll(sent).groupBy("node_id").agg(F.min("label").alias("label")))
    return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """node_id, component (its least node) of components with several nodes.

    Forward and backward colouring: each node takes the least node that reaches it; what reaches such a node back, under its
    colour, is its component. Found components are taken out, and the rest is coloured again. Only frontiers are joined."""
    links = _trimmed(stored(edges.select("src", "dst").where("src <> dst").distinct()))
    done = None
    while not links.isEmpty():
        labels = _least_reaching(links)
        frontier = stored(labels.where("node_id = label"))
        found = frontier
        within = stored(links.join(labels.select(F.col("node_id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node_id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
        while not frontier.isEmpty():
            back = within.join(frontier, (F.col("dst") == F.col("node_id")) & (F.col("colour") == F.col("label"))).select(F.col("src").alias("node_id"), "label").distinct()
            frontier = stored(back.join(found, ["node_id", "label"], "left_anti"))
            found = found.unionAll(frontier)
        found = stored(found)
        done = found if done is None else done.unionAll(found)
        ids = found.select(F.col("node_id").alias("found_id"))
        links = _trimmed(stored(links.join(ids, F.col("src") == F.col("found_id"), "left_anti").join(ids, F.col("dst") == F.col("found_id"), "left_anti")))
    if done is None:
        return edges.select(F.col("src").alias("node_id"), F.col("src").alias("component")).limit(0)
    several = done.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
    return done.join(several, "label", "left_semi").select("node_id", F.col("label").alias("component"))


def outgoing(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """The edges that start at one of the nodes, of the given types only if any are given."""
    rows = edges.where(F.col("edge_type").isin(*types)) if types else edges
    return rows.join(nodes.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")


def incoming(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    rows = edges.where(F.col("edge_type").isin(*types)) if types else edges
    return rows.join(nodes.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")


def add_nodes(nodes: DataFrame, added: DataFrame, content: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """nodes and added ones, and the collisions: ids that stand for other content already (in nodes, or twice in added). Added rows
    that are there already, or collide, change nothing. Both have node_id and the column ``content``."""
    fresh = added.select("node_id", content).distinct()
    known = nodes.select("node_id", F.col(content).alias("known"))
    twice = fresh.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_id")
    other = fresh.join(known, "node_id").where(~F.col(content).eqNullSafe(F.col("known"))).select("node_id")
    collisions = twice.unionAll(other).distinct()
    rows = fresh.join(known, "node_id", "left_anti").join(collisions, "node_id", "left_anti")
    return nodes.select("node_id", content).unionAll(rows), collisions


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of nodes and edges (edges go with either end), and the ids of gone that weren't there."""
    ids = gone.select(F.col("node_id").alias("gone_id")).distinct()
    kept = nodes.join(ids, F.col("node_id") == F.col("gone_id"), "left_anti")
    left = edges.join(ids, F.col("src") == F.col("gone_id"), "left_anti").join(ids, F.col("dst") == F.col("gone_id"), "left_anti")
    return kept, left, ids.join(nodes, F.col("gone_id") == F.col("node_id"), "left_anti").select(F.col("gone_id").alias("node_id"))


def edge_identity(src: Column, dst: Column, edge_type: Column, confidence: Column, evidence: Column) -> Column:
    """evidence: canonical JSON of an object."""
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    payload = F.concat(F.lit('{"confidence":'), confidence.cast("double").cast("string"), F.lit(',"edge_type":'), text(edge_type), F.lit(',"evidence":'), evidence, F.lit(',"schema_version":1,"source_node_id":'), text(src), F.lit(',"target_node_id":'), text(dst), F.lit("}"))
    return F.concat(F.lit("edge-"), F.substring(F.sha2(payload, 256), 1, 24))


def topological_order(nodes: DataFrame, edges: DataFrame, by: str, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """by, node_id, place in the order that takes, of the nodes whose dependencies (dst) are out, the least first; and a row
    CTX320 for each graph (value of ``by``) with a cycle, which has no order.

    The order is a walk, so each graph is one group: it is for the chosen nodes of a task, and one of more than ``most`` nodes is
    an error. ``levels`` orders graphs of any size by depth."""
    kind = dict(nodes.dtypes)
    deps = edges.groupBy(by, F.col("src").alias("node_id")).agg(F.collect_set("dst").alias("deps"))
    rows = nodes.select(by, "node_id").join(deps, [by, "node_id"], "left").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(by)))
    checked = rows.withColumn("size", F.when(F.col("size") <= most, F.col("size")).otherwise(F.raise_error(F.lit("a graph has too many nodes for this order")).cast("long")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = set(group["node_id"])
        waits = {n: {d for d in ([] if deps is None else deps) if d in known and d != n} for n, deps in zip(group["node_id"], group["deps"], strict=True)}
        needed_by: dict = {}
        for n, ds in waits.items():
            for d in ds:
                needed_by.setdefault(d, []).append(n)
        ready, out = [n for n, ds in waits.items() if not ds], []
        heapq.heapify(ready)
        while ready:
            out.append(heapq.heappop(ready))
            for n in needed_by.get(out[-1], ()):
                waits[n].discard(out[-1])
                if not waits[n]:
                    heapq.heappush(ready, n)
        whole = len(out) == len(waits)
        return pd.DataFrame({by: [group[by].iloc[0]] * (len(out) if whole else 1), "node_id": out if whole else [None], "place": range(1, len(out) + 1) if whole else [0], "code": [None] * len(out) if whole else ["CTX320"]})

    walked = stored(checked.groupBy(by).applyInPandas(run, f"{by} {kind[by]}, node_id {kind['node_id']}, place long, code string"))
    return walked.where("code IS NULL").drop("code"), walked.where("code IS NOT NULL").select(by, "code")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, level: how long the longest chain of dependencies below a node is; nodes on or above cycles have none.

    While that takes off most of the links, nodes that none needs are set aside with theirs. What is left goes round by round, from
    the nodes that need none; then each layer that was set aside is joined once with the levels below it, the last one first.
    edges are read several times; parallel ones do no harm."""
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    mark = lambda df, column, *flags: df.select(F.col(column).alias("node_id"), *[F.lit(f == column).alias(name) for f, name in zip(("src", "dst", "node_id"), flags, strict=True)])
    names = ("user", "needed", "known")
    ends = stored(mark(links, "src", *names).unionAll(mark(links, "dst", *names)).unionAll(mark(nodes, "node_id", *names)).groupBy("node_id").agg(*[F.bool_or(n).alias(n) for n in names]))
    if not ends.where("NOT known").isEmpty():
        ids = ends.where("known").select("node_id")
        return levels(induced(links, ids), ids)
    done, layers, n = ends.where("NOT user").select("node_id", F.lit(0).alias("level")), [], links.count()
    inside = ends.where("user AND needed").select(F.col("node_id").alias("src"))
    while n:
        inner = stored(links.join(inside, "src", "left_semi"))
        m = inner.count()
        if 2 * m > n:
            break
        layers.append((links, inner.select(F.col("src").alias("node_id")).distinct()))
        links, n, inside = inner, m, inner.select(F.col("dst").alias("src")).distinct()
    if n:
        done = stored(done.unionAll(_rounds(stored(links.distinct()))))
    for layer, below in reversed(layers):
        above = layer.join(done.withColumnRenamed("node_id", "dst"), "dst", "left").groupBy(F.col("src").alias("node_id")).agg(F.max("level").alias("top"), F.bool_or(F.col("level").isNull()).alias("open"))
        done = done.unionAll(stored(above.where("NOT open").join(below, "node_id", "left_anti").select("node_id", (F.col("top") + 1).alias("level"))))
    return done


def _rounds(links: DataFrame) -> DataFrame:
    """node_id, level (1 and more) of the nodes that need others, in a round for each level."""
    left = stored(links.select(F.col("src").alias("node_id")).distinct())
    level, done = 1, None
    while True:
        waiting = links.join(left, links["dst"] == left["node_id"], "left_semi").select(F.col("src").alias("node_id")).distinct()
        ready = stored(left.join(waiting, "node_id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionAll(ready)
        left = stored(left.join(ready, "node_id", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def within_groups(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """The edges of each group (by, src, dst, edge_type): those whose two ends are nodes of it (by, node_id). Edges that have ``by`` belong to that group only."""
    end = lambda name: nodes.select(F.col(by), F.col("node_id").alias(name)).distinct()
    first = edges.join(end("src"), [by, "src"] if by in edges.columns else "src")
    return first.select(by, "src", "dst", "edge_type").join(end("dst"), [by, "dst"], "left_semi").select(by, "src", "dst", "edge_type")


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_length: int = 8, max_paths: int = 32, by: str | None = None) -> DataFrame:
    """Simple paths from sources to the first sink on them, at most ``max_length`` edges; the first ``max_paths`` by source,
    length and node ids, over all or within each value of the column ``by`` of sources. Where edges or sinks have ``by`` too, a path stays among those of its own value."""
    keep = [by] if by else []
    own = lambda df: [c for c in keep if c in df.columns]
    links = edges.select(*[F.col(c).alias(f"l_{c}") for c in own(edges)], "src", "dst").distinct()
    ends = sinks.select(*[F.col(c).alias(f"s_{c}") for c in own(sinks)], F.col("node_id").alias("sink_id")).distinct()
    open_paths = stored(sources.select(*keep, F.array("node_id").alias("path")).distinct())
    found = sources.select(*keep, F.array("node_id").alias("path")).limit(0)
    for _ in range(max_length):
        if open_paths.isEmpty():
            break
        on = [F.element_at("path", -1) == F.col("src"), *[F.col(c) == F.col(f"l_{c}") for c in own(edges)]]
        grown = open_paths.join(links, on).where(~F.array_contains("path", F.col("dst"))).select(*keep, F.array_append("path", F.col("dst")).alias("path"), "dst")
        marked = stored(grown.join(ends, [F.col("dst") == F.col("sink_id"), *[F.col(c) == F.col(f"s_{c}") for c in own(sinks)]], "left"))
        closed = marked.where("sink_id IS NOT NULL").select(*keep, "path")
        found = found.unionAll(closed)
        open_paths = marked.where("sink_id IS NULL").select(*keep, "path")
    order = Window.partitionBy(*(keep or [F.lit(0)])).orderBy(F.element_at("path", 1), F.size("path"), "path")
    return found.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= max_paths)


def supersession(edges: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Superseded node ids with their successor (within each value of ``by``), and the nodes with more than one successor, which is an error."""
    keep = [by] if by else []
    pairs = edges.where("edge_type = 'supersedes'").groupBy(*keep, "src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("successor"))
    return pairs.where("n = 1").select(*keep, F.col("src").alias("node_id"), "successor"), pairs.where("n > 1").select(*keep, F.col("src").alias("node_id"), "n")


def neighbours(edges: DataFrame) -> DataFrame:
    """node_id, neighbour: both directions, distinct."""
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour")).unionAll(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbour"))).distinct()


def conflicts(edges: DataFrame) -> DataFrame:
    """src, dst, edge_type, code: edges that say that their ends contradict each other. Reported in their direction, each once; nothing is kept from selection for it."""
    return edges.where(F.col("edge_type").isin(*CONFLICT)).select("src", "dst", "edge_type", F.lit(CONFLICT_CODE).alias("code")).distinct()
