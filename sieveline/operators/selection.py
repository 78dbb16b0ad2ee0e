"""Choosing nodes under a token allowance, for many tasks at once: one task is one value of the column ``by``.

The greedy walk skips what doesn't fit and goes on, so it can't be a running sum. It is cut down before it runs: of the
items of one cost c at most allowance / c can ever be taken, and only the first ones in order, so each task walks at most
about allowance * ln(allowance) candidates, however many items there are. Items that cost nothing are always taken, at their
place in the order. Where a key is null, the item comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.graph import induced, strong_components
from sieveline.operators.problem import EXPLORED, HEURISTIC, INFEASIBLE, LINES, OPTIMAL, STOPPED, Problem
from sieveline.store import stored

#: Limits of the exact methods and of evidence.
BRUTE_FORCE, DP_NODES, DP_BUDGET, DP_STATES, DP_BYTES, ILP_NODES, ILP_EDGES = 16, 256, 100_000, 2_000_000, 256 * 1024 * 1024, 120, 2000
TIES = 8


def stable_key(items: DataFrame, primary: Column) -> list[Column]:
    """The full tie-break: primary and relevance falling, then cost, place (with lines, where items has them; null is 0) and id."""
    lines = [F.coalesce(F.col(c), F.lit(0)) for c in LINES if c in items.columns]
    return [F.round(-primary, 9), F.round(-F.col("relevance"), 9), F.col("cost"), F.col("uri"), *lines, F.col("node_id")]


def room(allowance: int | str) -> Column:
    """The allowance: a number for all tasks, or the name of a column that holds each task's own."""
    return F.col(allowance) if isinstance(allowance, str) else F.lit(allowance)


def candidates(items: DataFrame, by: str, order: list[Column], allowance: int | str) -> DataFrame:
    """The items that the walk may take, but for those that cost nothing, with their order key."""
    keyed = _keyed(items, order).where(F.col("cost").between(1, room(allowance)))
    place = F.row_number().over(Window.partitionBy(by, "cost").orderBy(*_sorted(order)))
    return keyed.withColumn("place", place).where((F.col("place") <= room(allowance)) & (F.col("place") * F.col("cost") <= room(allowance))).drop("place")


def _keyed(items: DataFrame, order: list[Column]) -> DataFrame:
    return items.withColumn("key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)]))


def _sorted(order: list[Column]) -> list[Column]:
    return [F.col(f"key.k{i}").asc_nulls_last() for i in range(len(order))]


def greedy(items: DataFrame, by: str, order: list[Column], allowance: int | str) -> DataFrame:
    """by, node_id, cost, rank, used (tokens up to and including this node) of what a walk in the given order takes.

    The walk streams over the sorted candidates and holds only the tokens used so far."""
    kind = dict(items.dtypes)
    shaped = lambda df: df.select(F.col(by), "node_id", F.greatest(F.col("cost"), F.lit(0)).cast("long").alias("cost"), "key", room(allowance).cast("long").alias("room"))
    rows = shaped(candidates(items, by, order, allowance)).unionAll(shaped(_keyed(items, order).where((F.col("cost") <= 0) & (room(allowance) >= 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used, rank = object(), 0, 0
        for batch in batches:
            taken, ranks, sums = [], [], []
            for k, (group, cost, most) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if group != task:
                    task, used, rank = group, 0, 0
                if used + cost <= most:
                    used, rank = used + cost, rank + 1
                    taken.append(k)
                    ranks.append(rank)
                    sums.append(used)
            chosen = batch.select([0, 1, 2]).take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(ranks, pa.int64()), pa.array(sums, pa.int64())], names=[by, "node_id", "cost", "rank", "used"])

    return rows.repartition(by).sortWithinPartitions(by, *_sorted(order)).select(by, "node_id", "cost", "room").mapInArrow(run, f"{by} {kind[by]}, node_id {kind['node_id']}, cost long, rank long, used long")


def naive(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    return greedy(items, by, [F.col("uri"), F.col("node_id")], allowance)


def relevance_greedy(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    return greedy(items, by, stable_key(items, F.col("relevance")), allowance)


def recency(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    return greedy(items, by, stable_key(items, F.col("freshness")), allowance)


def density_greedy(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    """Without dependencies the gain of an item never changes, so the rounds are one walk by value for each token."""
    return greedy(items.where("value > 0"), by, stable_key(items, F.col("value") / F.greatest(F.lit(1), F.col("cost"))), allowance)


def top_k(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    """By semantic score; a task in which an item has none falls back to density."""
    whole = Window.partitionBy(by)
    marked = items.withColumn("complete", F.count_if(F.col("semantic_score").isNull()).over(whole) == 0)
    return greedy(marked.where("complete"), by, stable_key(items, F.col("semantic_score")), allowance).unionAll(density_greedy(marked.where("NOT complete"), by, allowance))


def knapsack(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    """by, best, chosen: the largest sum of whole values under the allowance without dependencies, of those the one of lower cost,
    and the node_ids that give it (dynamic programming over tokens, for tasks within the limits of the exact methods)."""
    kind = dict(items.dtypes)["node_id"]
    listed = candidates(items.withColumn("room", room(allowance).cast("int")), by, [-F.col("value"), F.col("node_id")], "room").groupBy(by, "room").agg(F.array_sort(F.collect_list(F.struct("node_id", F.col("cost").cast("int").alias("cost"), F.col("value").cast("long").alias("value")))).alias("list"))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).alias("saved"), F.array().cast(f"array<{kind}>").alias("chosen"))

    def step(state: Column, item: Column) -> Column:
        def with_item(old: Column) -> Column:
            return F.struct((old["best"] + item["value"]).alias("best"), (old["saved"] - item["cost"]).alias("saved"), F.array_append(old["chosen"], item["node_id"]).alias("chosen"))

        better = lambda a, b: (a["best"] > b["best"]) | ((a["best"] == b["best"]) & (a["saved"] > b["saved"]))

        def choose(old: Column, j: Column) -> Column:
            other = with_item(F.get(state, j - item["cost"]))
            return F.when((j >= item["cost"]) & better(other, old), other).otherwise(old)

        return F.transform(state, choose)

    table = F.array_repeat(start, F.col("room") + 1)
    return listed.select(by, F.element_at(F.aggregate("list", table, step), -1).alias("end")).select(by, "end.best", "end.chosen")


def brute_force(items: DataFrame, by: str, allowance: int | str, dependency_weight: float = 0.1) -> DataFrame:
    """by, objective, cost, chosen: the best closed set of each task with at most BRUTE_FORCE nodes; others have no row. items may have mandatory and allowed.

    Every subset of a task is a row of its own (a number whose bits name the nodes), so subsets are spread over tasks of Spark."""
    of = lambda name, default: (F.coalesce(F.col(name), F.lit(default)) if name in items.columns else F.lit(default)).alias(name)
    small = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("node_id", "cost", "value", "deps", of("mandatory", False), of("allowed", True)))).alias("nodes")).where(F.size("nodes") <= BRUTE_FORCE)
    at = lambda node, d: F.array_position(F.transform("nodes", lambda n: n["node_id"]), d) - 1
    masks = F.transform("nodes", lambda n: F.aggregate(F.array_distinct(F.filter(n["deps"], lambda d: at(n, d) >= 0)), F.lit(0).cast("long"), lambda m, d: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at(n, d).cast("int")))))
    ready = stored(small.select(by, "nodes", masks.alias("masks")))
    tried = ready.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size("nodes")).cast("long") - 1)).alias("subset"), F.arrays_zip("nodes", "masks").alias("pairs"))
    start = F.struct(F.lit(True).alias("closed"), F.lit(0.0).alias("objective"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        inside = F.call_function("shiftright", F.col("subset"), s["i"]).bitwiseAND(F.lit(1)) == 1
        closed = s["closed"] & F.when(inside, x["nodes"]["allowed"] & (x["masks"].bitwiseAND(F.col("subset")) == x["masks"])).otherwise(~x["nodes"]["mandatory"])
        gain = x["nodes"]["value"] + dependency_weight * F.bit_count(x["masks"])
        return F.struct(closed.alias("closed"), (s["objective"] + F.when(inside, gain).otherwise(0.0)).alias("objective"), (s["cost"] + F.when(inside, x["nodes"]["cost"]).otherwise(0)).cast("long").alias("cost"), (s["i"] + 1).alias("i"))

    valued = tried.select(by, "subset", F.aggregate("pairs", start, step).alias("r")).where((F.col("r.closed")) & (F.col("r.cost") <= allowance))
    best = valued.groupBy(by).agg(F.max(F.struct(F.round("r.objective", 9).alias("objective"), (-F.col("r.cost")).alias("saved"), (-F.col("subset")).alias("minus"))).alias("b"))
    taken = F.filter("nodes", lambda n, i: F.call_function("shiftright", -F.col("b.minus"), i).bitwiseAND(F.lit(1)) == 1)
    return best.join(ready, by).select(by, "b.objective", (-F.col("b.saved")).alias("cost"), F.transform(taken, lambda n: n["node_id"]).alias("chosen"))


def problem_differences(nodes: DataFrame, analyses: DataFrame, configured: DataFrame) -> DataFrame:
    """problem, node_id: analyses of no node, nodes without an analysis, configured ids of no node. A problem with any is no problem to solve."""
    ids = nodes.select("node_id").distinct()
    parts = [(analyses, ids, "unknown_analysis"), (ids, analyses, "missing_analysis"), (configured, ids, "unknown_configured")]
    return reduce(DataFrame.unionAll, (a.select("node_id").distinct().join(b.select("node_id"), "node_id", "left_anti").select(F.lit(name).alias("problem"), "node_id") for a, b, name in parts))


def mandatory_problems(items: DataFrame, by: str, mandatory: DataFrame, allowed: DataFrame, allowance: int | str) -> DataFrame:
    """by, code, reason, cost for tasks (by, node_id of mandatory) that can't be met: the closure of the mandatory nodes holds one that
    isn't allowed, or costs more than the allowance."""
    whole = closure_of(items, by, mandatory)
    priced = whole.join(items.select(by, "node_id", "cost"), [by, "node_id"]).join(allowed.select(by, "node_id", F.lit(True).alias("fine")).distinct(), [by, "node_id"], "left")
    priced = priced.join(items.groupBy(by).agg(F.max(room(allowance)).alias("room")), by)
    sums = priced.groupBy(by).agg(F.sum("cost").alias("cost"), F.bool_or(F.col("fine").isNull()).alias("barred"), F.max("room").alias("room"))
    reason = F.when(F.col("barred"), "mandatory_closure_not_allowed").when(F.col("cost") > F.col("room"), "mandatory_closure_exceeds_allowance")
    return sums.select(by, F.lit("CTX530").alias("code"), reason.alias("reason"), "cost").where("reason IS NOT NULL")


def closure_of(items: DataFrame, by: str, seeds: DataFrame) -> DataFrame:
    """by, node_id: what the seeds of each task need, with them. A round joins only the new nodes."""
    links = items.select(F.col(by).alias("l_by"), F.col("node_id").alias("l_src"), F.explode("deps").alias("l_dst"))
    frontier = stored(seeds.select(by, "node_id").distinct())
    reached = frontier
    while not frontier.isEmpty():
        step = frontier.join(links, (F.col(by) == F.col("l_by")) & (F.col("node_id") == F.col("l_src"))).select(by, F.col("l_dst").alias("node_id")).distinct()
        frontier = stored(step.join(reached, [by, "node_id"], "left_anti"))
        reached = reached.unionAll(frontier)
    return reached


def violations(items: DataFrame, by: str, selected: DataFrame, mandatory: DataFrame, blocked: DataFrame, allowance: int | str) -> DataFrame:
    """by, violation, n: duplicate, unknown, blocked, mandatory, dependency (nodes) and allowance (1) of each task's selection."""
    keys = [by, "node_id"]
    chosen, known = selected.select(*keys).distinct(), items.select(*keys)
    counted = lambda df, name: df.groupBy(by).agg(F.lit(name).alias("violation"), F.count(F.lit(1)).alias("n"))
    unknown = chosen.join(known, keys, "left_anti")
    sound = chosen.join(unknown.select(by).distinct(), by, "left_anti")  # closures and costs are told where all ids are known
    lacking = closure_of(items, by, sound).join(chosen, keys, "left_anti")
    over = sound.join(items.select(*keys, "cost"), keys).groupBy(by).agg(F.sum("cost").alias("c")).where(F.col("c") > allowance)
    parts = [
        counted(selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "duplicate"), counted(unknown, "unknown"),
        counted(chosen.join(blocked.select(*keys).distinct(), keys, "left_semi"), "blocked"), counted(mandatory.select(*keys).distinct().join(chosen, keys, "left_anti"), "mandatory"),
        counted(lacking, "dependency"), counted(over, "allowance"),
    ]
    return reduce(DataFrame.unionAll, parts)


def canonical_seeds(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id of a least set whose closure is the selection: selected has node_id, rank, mandatory; edges src, dst.

    Taken in the order of rank, a node goes when the others still need it. So what stays is mandatory, or the last of a cycle
    (or the node alone) that nothing outside of it needs."""
    within = stored(induced(edges.select("src", "dst"), selected).where("src <> dst").distinct())
    rounds = strong_components(within)
    part = selected.join(rounds, "node_id", "left").select("node_id", "rank", "mandatory", F.coalesce("component", "node_id").alias("part"))
    part = stored(part)
    of = lambda end: part.select(F.col("node_id").alias(end), F.col("part").alias(f"{end}_part"))
    needed = within.join(of("src"), "src").join(of("dst"), "dst").where("src_part <> dst_part").select(F.col("dst_part").alias("part")).distinct()
    held = part.where("mandatory").select("part").distinct()
    alone = part.join(needed, "part", "left_anti").join(held, "part", "left_anti").groupBy("part").agg(F.max_by("node_id", "rank").alias("node_id")).select("node_id")
    return alone.unionAll(part.where("mandatory").select("node_id"))


def tie_groups(items: DataFrame, by: str) -> DataFrame:
    """Groups of items of equal value and relevance, the first TIES of each task."""
    groups = items.groupBy(by, "value", "relevance").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node_id").alias("first_node")).where("n_nodes > 1")
    order = Window.partitionBy(by).orderBy(F.desc("value"), F.desc("relevance"), "first_node")
    return groups.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= TIES)


def cascade(counts: DataFrame, allowance: int | str) -> DataFrame:
    """The strategy for each task by its size; counts has n_optional, n_edges, feasible."""
    n, small = F.col("n_optional"), lambda c, most: c <= most
    states = (n + 1) * (room(allowance) + 1)
    dp = small(n, DP_NODES) & small(room(allowance), DP_BUDGET) & small(states, DP_STATES) & small(states * 64, DP_BYTES)
    choice = F.when(~F.col("feasible") | (n <= BRUTE_FORCE), "brute_force").when((F.col("n_edges") == 0) & dp, "dynamic_programming").when((n <= ILP_NODES) & (F.col("n_edges") <= ILP_EDGES), "ilp").when(F.col("n_edges") > 0, "graph_closure_greedy").otherwise("density_greedy")
    return counts.withColumn("strategy", choice)


def trimmed(items: DataFrame, by: str, order: list[Column], allowance: int | str) -> DataFrame:
    """items without those that no walk in the given order (and no exact search, if the order is by value) can take: nodes that need none and that none
    needs, beyond the first allowance / c of a cost c. Nodes in the graph, mandatory ones and free ones stay."""
    rows = items.withColumn("end", F.explode(F.concat(F.array(F.struct(F.col("node_id").alias("node"), F.lit(True).alias("own"))), F.transform(F.coalesce("deps", F.slice(F.array("node_id"), 1, 0)), lambda d: F.struct(d.alias("node"), F.lit(False).alias("own"))))))
    ends = rows.select(F.col(by), F.col("end.node").alias("node"), F.when(F.col("end.own"), F.struct(*items.columns)).alias("row"), (~F.col("end.own")).alias("needed"))
    marked = ends.groupBy(by, "node").agg(F.first("row", ignorenulls=True).alias("row"), F.bool_or("needed").alias("needed")).where("row IS NOT NULL")
    alone = ~F.col("needed") & (F.size("row.deps") == 0) & (F.col("row.cost") > 0)
    if "mandatory" in items.columns:
        alone = alone & ~F.coalesce("row.mandatory", F.lit(False))
    single = _keyed(marked.select(by, *[F.col(f"row.{c}").alias(c) for c in items.columns if c != by], alone.alias("alone")), order)
    place = F.row_number().over(Window.partitionBy(by, "cost", "alone").orderBy(*_sorted(order)))
    return single.withColumn("place", place).where(~F.col("alone") | (F.col("place") * F.col("cost") <= room(allowance))).drop("key", "alone", "place")


#: What a method of Problem orders single nodes by.
METHODS: dict[str, tuple[Callable[[Problem], frozenset], str | None]] = {
    "graph_closure_greedy": (Problem.density, "density"), "density_greedy": (Problem.density, "density"), "ilp": (Problem.exact, "value"), "brute_force": (Problem.brute, "value"),
    "relevance_greedy": (lambda p: p.walk(lambda i: (-round(p.primary[i], 9), *p.key[i])), "relevance"), "recency": (lambda p: p.walk(lambda i: (-round(p.primary[i], 9), *p.key[i])), "freshness"),
    "top_k": (lambda p: p.walk(lambda i: (-round(p.primary[i], 9), *p.key[i])), "semantic_score"), "naive": (lambda p: p.walk(lambda i: p.key[i][2:]), None),
}


def outcome(items: DataFrame, by: str, allowance: int | str, strategy: str = "density_greedy", method: Callable[[Problem], frozenset] | None = None, most: int = 1_000_000, placed: bool = False) -> DataFrame:
    """by, rank, node_id, status, gap: of each task a row of rank 0 with its status, then its choice with dependencies in order.

    items has deps and may have mandatory and allowed. Single nodes that can't be chosen are dropped before; what is left of a
    task is walked in one task of Spark, the tasks in parallel. A task with more than ``most`` nodes left is an error. placed: the
    rows of a task lie in one partition already, where they stay."""
    kind = dict(items.dtypes)
    run_method, primary = METHODS[strategy]
    run_method = method or run_method
    order = [F.col("uri"), F.col("node_id")] if primary is None else stable_key(items, F.col("value") / F.greatest(F.lit(1), F.col("cost")) if primary == "density" else F.col(primary))
    extra = [c for c in (*LINES, "mandatory", "allowed") if c in items.columns]
    scored = F.coalesce(F.col(primary), F.lit(0.0)) if primary in items.columns else F.lit(0.0)
    columns = [by, "node_id", "cost", "value", "relevance", "uri", "deps", "primary", "room", *extra]
    rows = trimmed(items, by, order, allowance).withColumns({"primary": scored.cast("double"), "room": room(allowance).cast("long")}).select(*columns)

    def solved(own: dict[str, list], out: list[list]) -> None:
        problem = Problem(own, int(own["room"][0]))
        problem.primary = dict(zip(own["node_id"], own["primary"], strict=True))
        chosen = problem.ordered(run_method(problem))
        for k, rest in enumerate(([None, problem.status, problem.gap], *([i, None, None] for i in chosen))):
            for column, x in zip(out, (own[by][0], k, *rest), strict=True):
                column.append(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        out: list[list] = [[] for _ in range(5)]
        for batch in batches:
            kinds = (batch.schema.field(0).type, pa.int64(), batch.schema.field(1).type, pa.string(), pa.float64())
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[by, "rank", "node_id", "status", "gap"])  # noqa: E731, B023
            lists = [c.to_pylist() for c in batch.columns]
            starts = [0, *(k for k in range(1, len(lists[0])) if lists[0][k] != lists[0][k - 1]), len(lists[0])]
            for start, end in zip(starts, starts[1:], strict=False):
                if start == end:
                    continue
                if own and own[by][0] != lists[0][start]:
                    solved(own, out)
                    own = {}
                for name, values in zip(columns, lists, strict=True):
                    own.setdefault(name, []).extend(values[start:end])
                if len(own[by]) > most:
                    raise ValueError("a task has too many nodes for a walk with dependencies")
            if len(out[0]) >= 10_000:
                yield made()
                out = [[] for _ in range(5)]
        if own:
            solved(own, out)
        if out[0]:
            yield made()

    # a given number of partitions, as adaptive execution would put many small tasks, which are slow ones, into one
    spread = rows if placed else rows.repartition(_partitions(rows), by)
    return spread.sortWithinPartitions(by).mapInArrow(run, f"{by} {kind[by]}, rank long, node_id {kind['node_id']}, status string, gap double")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_task(df: DataFrame, by: str) -> DataFrame:
    """df with the rows of a task in one partition, for ``placed``."""
    return df.repartition(_partitions(df), by)


def solve(items: DataFrame, by: str, allowance: int | str, method: Callable[[Problem], frozenset] = Problem.density, placed: bool = False) -> DataFrame:
    """by, node_id, rank of each task's choice with dependencies."""
    strategy = "ilp" if method is Problem.exact else "density_greedy"
    return outcome(items, by, allowance, strategy, method, placed=placed).where("rank > 0").select(by, "node_id", "rank")


#: The exact strategies, whose tasks are small.
SMALL = ("brute_force", "dynamic_programming", "ilp")


@dataclass
class Selection:
    """chosen: by, node_id, rank (dependencies first, then by value). record: by, requested, strategy, status, objective, used, gap, reason, code, a row for each task."""

    chosen: DataFrame
    record: DataFrame


def named_strategies(items: DataFrame, by: str, allowance: int | str, requested: str) -> DataFrame:
    """by, strategy, reason: the strategy that solves each task. Where a task is beyond what the requested one can do, density with the reason."""
    of = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in items.columns else F.lit(default)
    edges = F.size(F.array_distinct("deps"))
    semantic = F.count_if(F.col("semantic_score").isNull()) if "semantic_score" in items.columns else F.count(F.lit(1))
    counts = items.groupBy(by).agg(F.count_if(~of("mandatory", False) & of("allowed", True)).alias("n_optional"), F.count(F.lit(1)).alias("n_nodes"), F.sum(edges).alias("n_edges"), semantic.alias("n_unscored"), F.lit(True).alias("feasible"), F.max(room(allowance)).alias("room"))
    named = cascade(counts, "room")
    if requested == "auto":
        return named.select(by, "strategy", F.lit(None).cast("string").alias("reason"))
    n = F.col("n_optional")
    states = (n + 1) * (F.col("room") + 1)
    dp = (F.col("n_edges") > 0) | (n > DP_NODES) | (F.col("room") > DP_BUDGET) | (states > DP_STATES) | (states * 64 > DP_BYTES)
    beyond = {"brute_force": (n > BRUTE_FORCE, "brute_force_nodes"), "dynamic_programming": (dp, "dynamic_programming_limits"), "ilp": ((F.col("n_nodes") > ILP_NODES) | (F.col("n_edges") > ILP_EDGES), "exact_limits"), "top_k": (F.col("n_unscored") > 0, "no_semantic_score")}.get(requested, (F.lit(False), None))
    return named.select(by, F.when(beyond[0], "density_greedy").otherwise(requested).alias("strategy"), F.when(beyond[0], beyond[1]).alias("reason"))


def select(items: DataFrame, by: str, allowance: int | str, requested: str = "auto", explored: int = EXPLORED, dependency_weight: float = 0.1) -> Selection:
    """Each task solved by the strategy that is requested, or that the cascade names for it, with a record of how.

    items: by, node_id, cost, value, relevance, uri, deps; mandatory and allowed, if there are any. A task whose mandatory closure isn't allowed or
    doesn't fit is infeasible (CTX530) and gets nothing; one solved by another strategy than the requested one, or whose exact search
    stopped after ``explored`` nodes with its best so far, has a reason and CTX520."""
    rows, none = stored(items), F.lit(None).cast("string")
    free = "mandatory" not in rows.columns and "allowed" not in rows.columns
    every = rows.select(by).distinct()
    if free:
        broken = every.limit(0).select(by, none.alias("why"))
    else:
        full = stored(rows.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d) for c, d in (("mandatory", False), ("allowed", True))}))
        broken = stored(mandatory_problems(full, by, full.where("mandatory"), full.where("allowed"), allowance).select(by, F.col("reason").alias("why")))
        rows = full.join(broken, by, "left_anti")
    named = stored(named_strategies(rows, by, allowance, requested))
    wanted = {r["strategy"] for r in named.select("strategy").distinct().collect()}  # at most the nine strategies
    parts = []
    for strategy in sorted(wanted):
        small = strategy in SMALL  # tasks of a few nodes are sent once
        own = by_task(rows, by) if small else rows
        if len(wanted) > 1 or not free:
            own = own.join(named.where(F.col("strategy") == strategy).select(by), by, "left_semi")
        nothing = (F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("gap"))
        if strategy == "dynamic_programming" and free:
            found = exact_knapsack(own, by, allowance).select(by, F.explode_outer("chosen").alias("node_id"), F.lit(None).cast("long").alias("rank"), *nothing)
        elif strategy == "density_greedy" and free and own.where(F.size("deps") > 0).isEmpty():
            found = density_greedy(own, by, allowance).select(by, "node_id", F.lit(None).cast("long").alias("rank"), *nothing)
        elif strategy in ROWS and free and own.where(F.size("deps") > 0).isEmpty():
            found = ROWS[strategy](own, by, allowance).select(by, "node_id", F.lit(None).cast("long").alias("rank"), *nothing)
        else:
            method = {"ilp": lambda p: p.exact(explored), "dynamic_programming": lambda p: p.exact(explored)}.get(strategy)
            found = outcome(own, by, allowance, "ilp" if strategy == "dynamic_programming" else strategy, method, placed=small).select(by, "node_id", "rank", "status", "gap")
        parts.append(found)
    found = stored(reduce(DataFrame.unionByName, parts)) if parts else stored(rows.limit(0).select(by, "node_id", F.lit(None).cast("long").alias("rank"), none.alias("status"), F.lit(None).cast("double").alias("gap")))
    priced = found.where("node_id IS NOT NULL").select(by, "node_id", F.col("rank").alias("walked")).join(rows, [by, "node_id"])
    chosen = priced.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("walked", *stable_key(priced, F.col("value")))).cast("long")).select(by, "node_id", "rank")
    gain = F.round(F.sum(F.col("value") + dependency_weight * F.size(F.array_distinct("deps"))), 9)
    sums = priced.groupBy(by).agg(gain.alias("objective"), F.sum("cost").cast("long").alias("used"))
    told = found.where("status IS NOT NULL").select(by, "status", "gap")
    exact = F.col("strategy").isin("brute_force", "dynamic_programming")
    status = F.when(F.col("why").isNotNull(), INFEASIBLE).when(F.col("reason").isNotNull(), "fallback").otherwise(F.coalesce("status", F.when(exact, OPTIMAL).otherwise(HEURISTIC)))
    feasible = F.col("why").isNull()
    reason = F.coalesce("why", "reason", F.when(F.col("status") == STOPPED, "explored_nodes"))
    joined = every.join(broken, by, "left").join(named, by, "left").join(told, by, "left").join(sums, by, "left")
    record = joined.select(
        by, F.lit(requested).alias("requested"), F.coalesce("strategy", F.lit("brute_force")).alias("strategy"), status.alias("status"), F.when(feasible, F.coalesce("objective", F.lit(0.0))).alias("objective"), F.coalesce("used", F.lit(0)).alias("used"),
        F.when(exact & feasible, 0.0).otherwise(F.col("gap")).alias("gap"), reason.alias("reason"), F.when(F.col("why").isNotNull(), "CTX530").when(reason.isNotNull(), "CTX520").alias("code"),
    )
    return Selection(chosen, record)


def exact_knapsack(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    """by, chosen: ``knapsack`` with values of fractions, as whole numbers of 1e-9."""
    return knapsack(items.withColumn("value", F.round(F.col("value") * 1e9).cast("long")), by, allowance).select(by, "chosen")


#: Walks of tasks without dependencies, streamed.
ROWS = {"naive": naive, "recency": recency, "relevance_greedy": relevance_greedy, "top_k": top_k}


def select_auto(items: DataFrame, by: str, allowance: int | str) -> DataFrame:
    """by, node_id, strategy: what ``select`` chooses by the cascade."""
    done = select(items, by, allowance)
    return done.chosen.join(done.record.select(by, "strategy"), by)
