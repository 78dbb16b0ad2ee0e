"""Evaluation of a selection against required and accepted spans; lines are the units that join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(spans: DataFrame, *keys: str) -> DataFrame:
    """A row for each line of each span (start_line to end_line, both included)."""
    return spans.select(*keys, "uri", F.explode(F.sequence("start_line", "end_line")).alias("line"))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, and ``empty`` where the whole is nothing; differences below 1e-12 from 0 and 1 vanish."""
    value = F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
    return F.when(F.abs(value) < 1e-12, 0.0).when(F.abs(value - 1) < 1e-12, 1.0).otherwise(value)


def file_metrics(selected: DataFrame, required: DataFrame, accepted: DataFrame, by: str) -> DataFrame:
    """by, file_recall, file_precision: files of required spans that were chosen; chosen files that are required or accepted."""
    have = selected.select(by, "uri").distinct()
    need = required.select(by, "uri").distinct()
    fine = need.unionAll(accepted.select(by, "uri")).distinct()
    recall = need.join(have.withColumn("hit", F.lit(1)), [by, "uri"], "left").groupBy(by).agg(F.count("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    precision = have.join(fine.withColumn("hit", F.lit(1)), [by, "uri"], "left").groupBy(by).agg(F.count("hit").alias("ph"), F.count(F.lit(1)).alias("pn"))
    both = recall.join(precision, by, "full_outer").na.fill(0, ["h", "n", "ph", "pn"])
    return both.select(by, ratio(F.col("h"), F.col("n"), 1.0).alias("file_recall"), ratio(F.col("ph"), F.col("pn"), 1.0).alias("file_precision"))


def span_recall(selected: DataFrame, required: DataFrame, by: str) -> DataFrame:
    have = lines(selected, by).distinct().withColumn("hit", F.lit(1))
    need = lines(required, by).distinct().join(have, [by, "uri", "line"], "left").groupBy(by).agg(F.count("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return need.select(by, ratio(F.col("h"), F.col("n"), 1.0).alias("span_recall"))


def token_ratios(selected: DataFrame, useful: DataFrame, by: str) -> DataFrame:
    """by, useful_ratio, redundant_ratio, unsupported_ratio.

    A line has its node's tokens in equal shares. In order of rank, a useful line counts as useful the first time and as
    redundant after that; other lines are unsupported."""
    per_line = selected.withColumn("share", F.col("tokens") / (F.col("end_line") - F.col("start_line") + 1))
    chosen = lines(per_line, by, "node_id", "rank", "share")
    marked = chosen.join(lines(useful, by).distinct().withColumn("good", F.lit(1)), [by, "uri", "line"], "left")
    turn = F.row_number().over(Window.partitionBy(by, "uri", "line").orderBy("rank", "node_id"))
    part = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("share"))), F.lit(0.0))
    good = F.col("good").isNotNull()
    sums = marked.withColumn("turn", turn).groupBy(by).agg(part(good & (F.col("turn") == 1)).alias("u"), part(good & (F.col("turn") > 1)).alias("r"), part(~good).alias("x"), F.sum("share").alias("n"))
    return sums.select(by, ratio(F.col("u"), F.col("n"), 1.0).alias("useful_ratio"), ratio(F.col("r"), F.col("n"), 0.0).alias("redundant_ratio"), ratio(F.col("x"), F.col("n"), 0.0).alias("unsupported_ratio"))


def dependency_coverage(selected: DataFrame, dependencies: DataFrame, by: str) -> DataFrame:
    """A dependency (src, dst uris) is covered when both ends have a chosen line."""
    have = selected.select(by, "uri").distinct()
    first = have.select(by, F.col("uri").alias("src"), F.lit(1).alias("a"))
    second = have.select(by, F.col("uri").alias("dst"), F.lit(1).alias("b"))
    joined = dependencies.join(first, [by, "src"], "left").join(second, [by, "dst"], "left")
    return joined.groupBy(by).agg(ratio(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count(F.lit(1)), 1.0).alias("dependency_coverage"))


def budget_use(selected: DataFrame, by: str, budget: int) -> DataFrame:
    """by, used_tokens, budget_use: the share of the budget that a selection uses; a budget of nothing is used up."""
    return selected.groupBy(by).agg(F.sum("cost").alias("used_tokens")).withColumn("budget_use", ratio(F.col("used_tokens"), F.lit(budget), 1.0))


def incident_metrics(edges: DataFrame, required: DataFrame, superseded: DataFrame, selected: DataFrame, decided: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """by, relation_coverage (required by, src, dst, edge_type that are edges), superseded_exclusion (superseded by, node_id that
    aren't selected), security_correctness (expected by, node_id, action that were decided so). Nothing asked for is met."""
    parts = []
    for name, wanted, have, keys, hit in (
        ("relation_coverage", required, edges, ["src", "dst", "edge_type"], True),
        ("superseded_exclusion", superseded, selected, ["node_id"], False),
        ("security_correctness", expected, decided, ["node_id", "action"], True),
    ):
        found = wanted.select(by, *keys).distinct().join(have.select(by, *keys).distinct().withColumn("there", F.lit(1)), [by, *keys], "left")
        good = F.col("there").isNotNull() if hit else F.col("there").isNull()
        parts.append(found.groupBy(by).agg(ratio(F.count_if(good), F.count(F.lit(1)), 1.0).alias(name)))
    joined = parts[0].join(parts[1], by, "full_outer").join(parts[2], by, "full_outer")
    return joined.na.fill(1.0)


def means(runs: DataFrame, by: str, millionths: dict[str, Column]) -> DataFrame:
    """by, the mean of each measure (given in whole millionths), n_runs. Sums are whole numbers and means are rounded down, so they depend
    neither on the order of additions nor on ties."""
    n = F.count(F.lit(1))
    summed = runs.groupBy(by).agg(*[F.sum(m.cast("long")).alias(name) for name, m in millionths.items()], n.alias("n_runs"))
    return summed.select(by, *[(F.floor(F.col(name) / F.col("n_runs")) / 1e6).alias(name) for name in millionths], "n_runs")


#: What each metric says of a run without the rows that it needs: nothing asked for is met, nothing chosen wastes nothing.
EMPTY = {"file_recall": 1.0, "file_precision": 1.0, "span_recall": 1.0, "dependency_coverage": 1.0, "useful_ratio": 1.0, "redundant_ratio": 0.0, "unsupported_ratio": 0.0, "budget_use": 0.0}


def run_metrics(runs: DataFrame, selected: DataFrame, required: DataFrame, accepted: DataFrame, dependencies: DataFrame, by: str, budget: int) -> DataFrame:
    """One row for each run (by, unique in runs) with all metrics that reproduce: of the ten, latency and runtime depend on the machine.

    selected: by, node_id, rank, uri, start_line, end_line, tokens; required, accepted: by, uri, start_line, end_line; dependencies: by, src, dst (uris)."""
    span = [by, "uri", "start_line", "end_line"]
    useful = required.select(*span).unionAll(accepted.select(*span))
    parts = [
        file_metrics(selected, required, accepted, by),
        span_recall(selected, required, by),
        dependency_coverage(selected, dependencies, by),
        token_ratios(selected, useful, by),
        budget_use(selected.withColumn("cost", F.col("tokens")), by, budget).drop("used_tokens"),
    ]
    joined = runs
    for part in parts:
        joined = joined.join(part, by, "left")
    return joined.select(*runs.columns, *[F.coalesce(name, F.lit(value)).alias(name) for name, value in EMPTY.items()])


#: What a suite of tasks must offer, as counts of tasks: all, those with dependencies, those with each wanted tag.
LEAST_TASKS, LEAST_DEPENDENT = 5, 2


def span_problems(spans: DataFrame, sources: DataFrame, changed: DataFrame, by: str) -> DataFrame:
    """by, uri, start_line, end_line, problem: ground truth that its sources don't bear out. ``no_reason`` (null or blank), ``bad_bounds`` (before line 1 or
    ending before its start), ``no_source``, ``beyond_source``, ``unchanged_source`` (no part of the task's change).

    spans: by, uri, start_line, end_line, reason; sources: uri, n_lines (unique by uri); changed: by, uri."""
    known = sources.select("uri", F.greatest(F.lit(1), F.col("n_lines")).alias("n_lines"))
    moved = changed.select(by, "uri").distinct().withColumn("moved", F.lit(True))
    joined = spans.join(known, "uri", "left").join(moved, [by, "uri"], "left")
    tests = {
        "no_reason": F.coalesce(F.length(F.trim("reason")), F.lit(0)) == 0,
        "bad_bounds": (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")),
        "no_source": F.col("n_lines").isNull(),
        "beyond_source": F.col("end_line") > F.col("n_lines"),
        "unchanged_source": F.col("moved").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in tests.items()]))
    return joined.select(by, "uri", "start_line", "end_line", F.explode(found).alias("problem"))


def suite_problems(tasks: DataFrame, tags: list[str]) -> DataFrame:
    """problem: what a suite lacks. tasks: task_id, n_dependencies, tags."""
    counts = tasks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_dependencies") > 0).alias("d"), *[F.count_if(F.array_contains("tags", tag)).alias(f"t{k}") for k, tag in enumerate(tags)])
    lacking = [F.when(F.col("n") < LEAST_TASKS, "few_tasks"), F.when(F.col("d") < LEAST_DEPENDENT, "few_dependent_tasks"), *[F.when(F.col(f"t{k}") == 0, f"no_task:{tag}") for k, tag in enumerate(tags)]]
    return counts.select(F.explode(F.array_compact(F.array(*lacking))).alias("problem"))
