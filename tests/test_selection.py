"""Exact methods agree, greedy ones are strictly worse where they must be, dependencies are charged once."""

import itertools
import random
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.operators import render, selection
from sieveline.operators.selection import Problem


def problem(items, allowance, deps=()):
    rows = pd.DataFrame([{"node_id": i, "relevance": r, "value": r, "cost": c, "uri": i, "deps": [b for a, b in deps if a == i]} for i, r, c in items])
    return Problem(rows, allowance)


def brute(p):
    best = frozenset()
    for n in range(len(p.ids) + 1):
        for chosen in itertools.combinations(p.ids, n):
            chosen = frozenset(chosen)
            if all(d in chosen for i in chosen for d in p.deps[i]) and p.total(chosen) <= p.allowance and p.better(chosen, best):
                best = chosen
    return best


AGREE = [([("a", 0.9, 4), ("b", 0.6, 3), ("c", 0.4, 2)], 5), ([("a", 0.7, 3), ("b", 0.7, 3), ("c", 0.2, 1), ("d", 0.1, 1)], 6), ([("a", 1, 5), ("b", 0.8, 4), ("c", 0.5, 3)], 7), ([("a", 0, 1), ("b", 0.5, 2), ("c", 0.5, 2)], 3)]


@pytest.mark.parametrize("items, allowance", AGREE)
def test_exact_is_brute_force(items, allowance):
    p = problem(items, allowance)
    assert p.exact() == brute(p)


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 6)), min_size=1, max_size=7), st.integers(1, 15), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=5))
@settings(max_examples=60, deadline=None)
def test_exact_with_dependencies(items, allowance, pairs):
    named = [(f"n{k}", v / 10, c) for k, (v, c) in enumerate(items)]
    deps = [(f"n{a}", f"n{b}") for a, b in pairs if a != b and max(a, b) < len(items)]
    p = problem(named, allowance, deps)
    assert abs(p.objective(p.exact()) - p.objective(brute(p))) < 1e-9
    chosen = p.density()
    assert p.total(chosen) <= allowance and all(d in chosen for i in chosen for d in p.deps[i])


def test_dependencies_are_forced_and_shared():
    p = problem([("a", 1, 2), ("b", 0, 2), ("c", 0, 2), ("z", 0.2, 2)], 6, [("a", "b"), ("b", "c")])
    assert p.density() == {"a", "b", "c"} and p.ordered(p.density()) == ["c", "b", "a"]
    p = problem([("a", 1, 2), ("b", 0.9, 2), ("shared", 0, 3)], 7, [("a", "shared"), ("b", "shared")])
    assert p.density() == {"a", "b", "shared"} and p.total(p.density()) == 7


def frame(spark, items):
    return spark.createDataFrame([("t", i, float(r), c, i, float(r)) for i, r, c in items], "task string, node_id string, relevance double, cost int, uri string, value double")


@pytest.mark.parametrize("method, items", [(selection.naive, [("a", 0.4, 10), ("b", 0.6, 5), ("c", 0.6, 5)]), (selection.relevance_greedy, [("a", 1, 10), ("b", 0.6, 5), ("c", 0.6, 5)]), (selection.density_greedy, [("a", 1, 6), ("b", 0.75, 5), ("c", 0.75, 5)])])
def test_greedy_is_worse_here(spark, method, items):
    value = {i: r for i, r, _ in items}
    got = sum(value[r.node_id] for r in method(frame(spark, items), "task", 10).collect())
    p = problem(items, 10)
    assert got < p.objective(brute(p)) - 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_pruned_walk_is_the_whole_walk(spark, seed):
    rows = spark.range(400).select(F.lit("t").alias("task"), F.format_string("n%03d", "id").alias("node_id"), F.rand(seed).alias("relevance"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(9)) * 3).cast("int").alias("cost")).withColumns({"uri": F.col("node_id"), "value": F.col("relevance")}).cache()
    used, taken = 0, []
    for r in sorted(rows.collect(), key=lambda r: (-round(r.relevance, 9), -round(r.relevance, 9), r.cost, r.uri)):
        if r.cost and used + r.cost <= 60:
            used += r.cost
            taken.append(r.node_id)
    got = selection.relevance_greedy(rows.repartition(7), "task", 60).where("cost > 0").orderBy("rank").collect()
    assert [r.node_id for r in got] == taken and got[-1].used == used


def test_top_k_falls_back(spark):
    rows = frame(spark, [("a", 0.1, 2), ("b", 0.9, 2)]).withColumn("semantic_score", F.when(F.col("node_id") == "a", 1.0))
    assert [r.node_id for r in selection.top_k(rows, "task", 2).collect()] == ["b"]
    assert [r.node_id for r in selection.top_k(rows.withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.5))), "task", 2).collect()] == ["a"]


def test_exact_stops_after_a_number_of_nodes_and_tells_the_gap():
    rng = random.Random(5)
    items = [(f"n{k:03d}", 10 + rng.randrange(90) / 7, 10 + rng.randrange(90)) for k in range(80)]
    p = problem(items, 700)
    whole = p.exact(10**6)
    assert p.status == "optimal" and p.gap == 0
    best = p.objective(whole)
    chosen = p.exact(1)
    assert p.status == "feasible_timeout" and p.explored <= 3 and p.total(chosen) <= 700
    assert p.objective(chosen) <= best <= p.objective(chosen) + p.gap + 1e-9
    assert p.exact(1) == chosen


def graph_problem(seed, n, allowance=None, most=2, **more):
    """Random dependencies, a tenth of them backwards (so there are cycles), values below zero, free nodes."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        deps = {rng.randrange(n) if rng.random() < 0.1 else rng.randrange(max(1, k)) for _ in range(rng.randrange(most + 1))} - {k}
        rows.append({"node_id": f"n{k:05d}", "relevance": rng.randrange(4) / 4, "value": rng.randint(-3, 9) / 10, "cost": rng.randint(0, 9), "uri": str(rng.randrange(5)), "deps": [f"n{d:05d}" for d in sorted(deps)]})
        rows[-1].update({c: rng.random() < share for c, share in more.items()})
    return Problem(pd.DataFrame(rows), allowance or 3 * n // 2)


def plain_density(p):
    """The rounds as they are told: all remaining ranked anew each time."""
    whole = lambda nodes: frozenset().union(*map(p.closure, nodes))
    chosen = whole(p.mandatory)
    if not chosen <= p.allowed or p.total(chosen) > p.allowance:
        return frozenset()
    left = set(p.ids) - chosen
    while left:
        ranked = []
        for i in left:
            union = chosen | p.closure(i)
            if union == chosen or not union <= p.allowed:
                continue
            gain, cost = p.objective(union) - p.objective(chosen), p.total(union) - p.total(chosen)
            ranked.append(((-round(gain / max(1, cost), 12), -round(gain, 12), p.key[i]), i, union, gain))
        if not ranked:
            break
        _, i, union, gain = min(ranked)
        left.discard(i)
        if gain > 1e-12 and p.total(union) <= p.allowance:
            chosen = union
            left -= union
    return chosen


def best_worth(p):
    """The greatest objective (in units) and then the least cost over all closed subsets."""
    n, place = len(p.ids), {i: k for k, i in enumerate(p.ids)}
    needs = [sum(1 << place[d] for d in set(p.deps[i])) for i in p.ids]
    must = sum(1 << place[i] for i in p.mandatory)
    barred = sum(1 << k for k, i in enumerate(p.ids) if i not in p.allowed)
    best = None
    for s in range(1 << n):
        if s & must == must and not s & barred and all(needs[k] & ~s == 0 for k in range(n) if s >> k & 1):
            own = [i for k, i in enumerate(p.ids) if s >> k & 1]
            if p.total(own) <= p.allowance:
                found = (sum(round(p.value[i] * 10) for i in own) + sum(len(set(p.deps[i])) for i in own), -p.total(own))
                best = found if best is None else max(best, found)
    return best


@pytest.mark.parametrize("seed", range(0, 1000, 100))
def test_exact_is_brute_force_on_random_graphs(seed):
    for k in range(seed, seed + 100):
        p = graph_problem(k, 16 if k % 50 == 0 else 3 + k % 8, **({"mandatory": 0.1, "allowed": 0.8} if k % 4 == 0 else {}))
        chosen = p.exact()
        want = best_worth(p)
        if want is None:
            assert p.status == "infeasible" and not chosen
        else:
            assert p.status == "optimal" and p.gap == 0
            assert (sum(round(p.value[i] * 10) + len(set(p.deps[i])) for i in chosen), -p.total(chosen)) == want
        every = p.brute()
        assert (p.total(every), round(p.objective(every), 9)) == (p.total(chosen), round(p.objective(chosen), 9)) and p.status == ("infeasible" if want is None else "optimal")


@pytest.mark.parametrize("n", [60, 90, 120])
def test_exact_proves_tasks_of_its_limit(n):
    for seed in range(3):
        p = graph_problem(seed, n, most=1 + seed)
        chosen = p.exact()
        assert p.status == "optimal" and p.total(chosen) <= p.allowance and all(d in chosen for i in chosen for d in p.deps[i])
        assert p.objective(chosen) >= p.objective(p.density()) - 1e-9


def test_density_is_the_plain_loop():
    for seed in range(200):
        p = graph_problem(seed, 1 + seed % 17, **({"mandatory": 0.1, "allowed": 0.9} if seed % 4 == 0 else {}))
        assert p.density() == plain_density(p)


def test_density_takes_what_gains_only_after_another_choice():
    p = problem([("d", -1, 2), ("c", 0.5, 1), ("e", 3, 2)], 10, [("c", "d"), ("e", "d")])
    assert p.density() == {"c", "d", "e"}


def test_density_of_a_large_task_is_quick():
    rng = random.Random(1)
    rows = [{"node_id": k, "relevance": 0.0, "value": rng.randint(-3, 9) / 10, "cost": rng.randint(1, 30), "uri": "u", "deps": sorted({rng.randrange(max(0, k - 500), k) for _ in range(rng.randrange(3))}) if k else []} for k in range(100_000)]
    p = Problem(pd.DataFrame(rows), 5000)
    began = time.monotonic()
    chosen = p.density()
    assert time.monotonic() - began < 60 and 4000 < p.total(chosen) <= 5000 and all(d in chosen for i in chosen for d in p.deps[i])


def test_walk_takes_clusters_in_order():
    p = problem([("a", 0.9, 2), ("b", 0.1, 5), ("c", 0.8, 4), ("d", 0.2, 2)], 9, [("a", "b"), ("c", "b")])
    order = lambda i: p.key[i]
    assert p.walk(order) == {"a", "b", "d"}  # c no longer fits, d does


def test_pruned_tasks_give_the_whole_choice(spark):
    rng = random.Random(8)
    rows = [("t", k, rng.randint(0, 6), rng.randint(-2, 9) / 2, rng.randrange(3) / 2, f"{rng.randrange(9)}", [k - rng.randrange(1, 9)] if k > 200 and k % 2 else []) for k in range(300)]
    frame = spark.createDataFrame(rows, "task string, node_id long, cost int, value double, relevance double, uri string, deps array<long>")
    p = Problem(pd.DataFrame([r.asDict() for r in frame.collect()]), 40)
    got = selection.outcome(frame.repartition(5), "task", 40).where("rank > 0").orderBy("rank").collect()
    assert [r.node_id for r in got] == p.ordered(p.density())
    p.primary = {i: -k[0] for i, k in p.key.items()}
    walked = selection.outcome(frame, "task", 40, "relevance_greedy").where("rank > 0").orderBy("rank").collect()
    assert [r.node_id for r in walked] == p.ordered(p.walk(lambda i: p.key[i]))
    exact = [r.node_id for r in selection.outcome(frame, "task", 40, "ilp").where("rank > 0").collect()]
    assert abs(p.objective(frozenset(exact)) - p.objective(p.exact())) < 1e-9 and p.total(exact) <= 40


def test_records_tell_status_fallback_and_infeasible(spark):
    rows = tasks_of_all_sizes(spark)
    record = {r.task: r for r in selection.select(rows, "task", 12).record.collect()}
    assert {t: (r.strategy, r.status, r.code) for t, r in record.items()} == {
        "small": ("brute_force", "optimal", None), "flat": ("dynamic_programming", "optimal", None), "linked": ("ilp", "optimal", None), "deep": ("graph_closure_greedy", "heuristic", None), "wide": ("density_greedy", "heuristic", None),
    }
    for requested, reason, fine in (("brute_force", "brute_force_nodes", {"small"}), ("dynamic_programming", "dynamic_programming_limits", {"flat"}), ("ilp", "exact_limits", {"small", "flat", "linked"}), ("top_k", "no_semantic_score", set())):
        done = selection.select(rows, "task", 12, requested)
        for r in done.record.collect():
            if r.task in fine:
                assert (r.strategy, r.status, r.reason, r.code) == (requested, "optimal", None, None)
            else:
                assert (r.strategy, r.status, r.reason, r.code) == ("density_greedy", "fallback", reason, "CTX520")
            assert r.used <= 12 and r.requested == requested
    stopped = {r.task: r for r in selection.select(rows, "task", 12, "ilp", explored=0).record.collect()}
    assert all(r.status in ("optimal", "feasible_timeout", "fallback") and (r.status != "feasible_timeout" or (r.code == "CTX520" and r.gap > 0)) for r in stopped.values())
    for requested in ("naive", "relevance_greedy", "graph_closure_greedy"):
        done = selection.select(rows, "task", 12, requested)
        assert {r.status for r in done.record.collect()} == {"heuristic"}
        needs = {(r.task, r.node_id): r.deps for r in rows.collect()}
        chosen = {(r.task, r.node_id) for r in done.chosen.collect()}
        assert all((t, d) in chosen for t, i in chosen for d in needs[t, i])
    marked = rows.withColumn("mandatory", F.col("node_id").isin("small002", "flat003", "linked005", "deep129", "wide001")).withColumn("allowed", ~F.col("node_id").isin("linked004", "wide000"))
    done = selection.select(marked, "task", 12)
    record, chosen = {r.task: r for r in done.record.collect()}, {r.node_id for r in done.chosen.collect()}
    assert (record["linked"].status, record["linked"].code, record["linked"].reason) == ("infeasible", "CTX530", "mandatory_closure_not_allowed")
    assert not any(i.startswith("linked") for i in chosen) and {"small002", "flat003", "wide001"} <= chosen and "wide000" not in chosen
    for task in ("small", "flat"):
        own = pd.DataFrame([r.asDict() for r in marked.where(F.col("task") == task).collect()])
        p = Problem(own, 12)
        assert record[task].status == "optimal" and abs(record[task].objective - p.objective(p.exact())) < 1e-9


def tasks_of_all_sizes(spark):
    rows = []
    for task, n, chained in (("small", 6, True), ("flat", 20, False), ("linked", 24, True), ("deep", 130, True), ("wide", 300, False)):
        for k in range(n):
            rows.append((task, f"{task}{k:03d}", 1 + (k * 7) % 5, float(1 + (k * 11) % 9), 0.0, f"{k:03d}", [f"{task}{k - 1:03d}"] if chained and k % 3 else []))
    return spark.createDataFrame(rows, "task string, node_id string, cost long, value double, relevance double, uri string, deps array<string>")


def test_auto_takes_every_branch(spark):
    rows = tasks_of_all_sizes(spark)
    got = selection.select_auto(rows, "task", 12).collect()
    assert {r.task: r.strategy for r in got} == {"small": "brute_force", "flat": "dynamic_programming", "linked": "ilp", "deep": "graph_closure_greedy", "wide": "density_greedy"}
    for task in ("small", "flat", "linked"):
        own = [r for r in rows.collect() if r.task == task]
        p = Problem(pd.DataFrame([r.asDict() for r in own]), 12)
        chosen = frozenset(r.node_id for r in got if r.task == task)
        assert p.total(chosen) <= 12 and abs(p.objective(chosen) - p.objective(p.exact())) < 1e-9
    for r in got:
        assert r.node_id.startswith(r.task)


def test_brute_force_of_random_problems(spark):
    rng = random.Random(3)
    rows = []
    for task in range(12):
        n = rng.randint(1, 8)
        for k in range(n):
            rows.append((task, k, rng.randint(1, 5), float(rng.randint(0, 6)), 0.0, f"{k:02d}", sorted({d for d in (rng.randrange(n), rng.randrange(n)) if d != k and rng.random() < 0.4})))
    frame = spark.createDataFrame(rows, "task long, node_id long, cost long, value double, relevance double, uri string, deps array<long>")
    got = {r.task: r for r in selection.brute_force(frame, "task", 9).collect()}
    for task in range(12):
        p = Problem(pd.DataFrame([dict(zip(frame.columns, r)) for r in rows if r[0] == task]), 9)
        assert abs(got[task].objective - p.objective(brute(p))) < 1e-6 and p.total(got[task].chosen) == got[task].cost <= 9


def test_enforced_budget_is_the_plain_loop(spark):
    rng = random.Random(5)
    rows, deps, want = [], [], {}
    for task in range(15):
        n = rng.randint(2, 9)
        order = rng.sample(range(n), n)
        cost = [rng.randint(1, 9) for _ in range(n)]
        needs = {k: {d for d in (rng.randrange(n), rng.randrange(n)) if d < k and rng.random() < 0.6} for k in range(n)}
        rows += [(task, k, order[k], cost[k]) for k in range(n)]
        deps += [(task, k, d) for k in range(n) for d in needs[k]]

        def reach(k, found=None):
            found = {k} if found is None else found
            for d in needs[k] - found:
                found.add(d)
                reach(d, found)
            return found

        safe, left = reach(n - 1) if task % 2 else set(), set(range(n))
        while sum(cost[k] for k in left) > 14:
            for k in sorted(left, key=lambda k: -order[k]):
                cluster = {j for j in left if k in reach(j)}
                if not cluster & safe:
                    left -= cluster
                    break
            else:
                break
        want[task] = left
    segments = spark.createDataFrame(rows, "task long, node_id long, rank long, tokens long")
    links = spark.createDataFrame(deps, "task long, src long, dst long")
    last = segments.where("task % 2 = 1").groupBy("task").agg(F.max("node_id").alias("node_id"))
    done = render.enforce(segments, links, last, "task", 14).collect()
    for task, left in want.items():
        own = [r for r in done if r.task == task]
        assert {r.node_id for r in own if r.kept} == left
        if {r.code for r in own} == {"CTX510"}:
            assert sum(r.tokens for r in own if r.kept) > 14
        else:
            assert sum(r.tokens for r in own if r.kept) <= 14 and min((r.tokens_after for r in own if not r.kept), default=sum(r.tokens for r in own if r.kept)) == sum(r.tokens for r in own if r.kept)


def test_canonical_seeds_give_the_selection_back(spark):
    rng = random.Random(9)
    pairs = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a != b}
    held = {3, 17}
    reach = {k: {k} for k in range(30)}
    for _ in range(30):
        for a, b in pairs:
            reach[a] |= reach[b]
    seeds, whole = set(range(30)), set(range(30))
    for k in range(30):
        if k not in held and set().union(*(reach[j] for j in seeds - {k})) == whole:
            seeds.remove(k)
    chosen = spark.createDataFrame([(k, k, k in held) for k in range(30)], "node_id long, rank long, mandatory boolean")
    got = selection.canonical_seeds(chosen, spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()
    assert sorted(r.node_id for r in got) == sorted(seeds)


def test_lines_are_in_the_sort_key(spark):
    rows = [("t", "a", "f", 20, 30, 3), ("t", "b", "f", 5, 9, 3), ("t", "c", "f", None, None, 3), ("t", "d", "f", 5, 7, 3), ("t", "e", "e", 90, 91, 3)]
    items = spark.createDataFrame(rows, "task string, node_id string, uri string, start_line int, end_line int, cost int").withColumns({"relevance": F.lit(0.5), "value": F.lit(0.5), "deps": F.array().cast("array<string>")})
    order = ["e", "c", "d", "b", "a"]  # equal in all else: by uri, start line (null is 0), end line, id
    walked = selection.relevance_greedy(items, "task", 12).orderBy("rank").collect()
    assert [r["node_id"] for r in walked] == order[:4]
    solved = selection.solve(items, "task", 100).orderBy("rank").collect()
    assert [r["node_id"] for r in solved] == order
    assert [r["node_id"] for r in selection.relevance_greedy(items.drop("start_line", "end_line"), "task", 12).orderBy("rank").collect()] == ["e", "a", "b", "c"]
