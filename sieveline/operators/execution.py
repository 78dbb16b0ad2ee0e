"""How far a validated plan runs: its calls in order, each invoked unless it is a blocked sink, until one drifts from its declaration.

A blocked sink is passed over, and the calls after it go on; a drift is a hard stop for all later calls of the plan. A plan that is
blocked as a whole invokes nothing. The same rule on a table and on a stream of calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.evidence import prints

#: invoked; drifted (invoked, the last one); blocked (a sink, or any call of a blocked plan); stopped (after a drift).
STATUS = "plan_id {0}, place long, call_id string, status string"


def _status(place: Column, drift_at: Column) -> Column:
    after = drift_at.isNotNull() & (place > drift_at)
    return F.when(after, "stopped").when(F.col("plan_blocked") | F.col("blocked"), "blocked").when(F.col("drift"), "drifted").otherwise("invoked")


def run(calls: DataFrame) -> DataFrame:
    """calls: plan_id, place, call_id, plan_blocked, blocked, drift (what its observation would show). plan_id, place, call_id, status."""
    flags = calls.na.fill(False, ["plan_blocked", "blocked", "drift"])
    stops = flags.where("drift AND NOT blocked AND NOT plan_blocked").groupBy("plan_id").agg(F.min("place").alias("drift_at"))
    return flags.join(stops, "plan_id", "left").select("plan_id", F.col("place").cast("long").alias("place"), "call_id", _status(F.col("place"), F.col("drift_at")).alias("status"))


def stream(calls: DataFrame) -> DataFrame:
    """The same for a stream whose batches bring each plan's calls in order; the state of a plan is the place of its drift."""
    kind = dict(calls.dtypes)["plan_id"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        drift_at = state.get[0] if state.exists else None
        for batch in batches if not isinstance(batches, pd.DataFrame) else [batches]:
            out = []
            for row in batch.sort_values("place").itertuples(index=False):
                if drift_at is not None and row.place > drift_at:
                    status = "stopped"
                elif row.plan_blocked or row.blocked:
                    status = "blocked"
                elif row.drift:
                    status, drift_at = "drifted", int(row.place)
                else:
                    status = "invoked"
                out.append((key[0], int(row.place), row.call_id, status))
            yield pd.DataFrame(out, columns=["plan_id", "place", "call_id", "status"])
        if drift_at is not None:
            state.update((drift_at,))

    rows = calls.select("plan_id", F.col("place").cast("long").alias("place"), "call_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("plan_blocked", "blocked", "drift")])
    return rows.groupBy("plan_id").applyInPandasWithState(step, STATUS.format(kind), "drift_at long", "append", "NoTimeout")


def suite(calls: DataFrame, flows: DataFrame, by: str) -> DataFrame:
    """One row for each suite of plans: by, n_plans, n_passed (plans none of whose invoked calls leaked), a count for each status, n_blocked_calls
    (distinct), n_approvals (distinct pending flows), n_leaks and identity, which depends on neither the order of plans nor of calls.

    calls: by, plan_id, place, call_id, status, leaked; flows: by, plan_id, flow_id, status."""
    leak = F.coalesce("leaked", F.lit(False)) & F.col("status").isin("invoked", "drifted")
    plans = calls.groupBy(by, "plan_id").agg(
        F.bool_or(leak).alias("bad"), F.count_if(leak).alias("leaks"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("invoked", "drifted", "blocked", "stopped")]
    )
    counted = plans.groupBy(by).agg(F.count(F.lit(1)).alias("n_plans"), F.count_if(~F.col("bad")).alias("n_passed"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("invoked", "drifted", "blocked", "stopped")], F.sum("leaks").alias("n_leaks"))
    barred = calls.where("status = 'blocked'").groupBy(by).agg(F.count_distinct("call_id").alias("n_blocked_calls"))
    asked = flows.where("status = 'pending'").groupBy(by).agg(F.count_distinct("flow_id").alias("n_approvals"))
    told = prints(calls, by, "plan_id", "place", "call_id", "status").withColumnRenamed("print", "calls_print")
    decided = prints(flows, by, "plan_id", "flow_id", "status").withColumnRenamed("print", "flows_print")
    joined = counted.join(barred, by, "left").join(asked, by, "left").na.fill(0, ["n_blocked_calls", "n_approvals"]).join(told, by, "left").join(decided, by, "left")
    identity = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.col(by).cast("string"), "calls_print", F.coalesce("flows_print", F.lit("none"))), 256))
    return joined.withColumn("identity", identity).drop("calls_print", "flows_print")
