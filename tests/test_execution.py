"""The execution loop on a table and on a stream."""

import random

from pyspark.sql import functions as F

from sieveline.operators import execution

SCHEMA = "plan_id long, place long, call_id string, plan_blocked boolean, blocked boolean, drift boolean"


def plain(rows):
    out, stopped = [], set()
    for plan, place, call, whole, blocked, drift in sorted(rows, key=lambda r: r[:2]):
        if plan in stopped:
            status = "stopped"
        elif whole or blocked:
            status = "blocked"
        elif drift:
            status = "drifted"
            stopped.add(plan)
        else:
            status = "invoked"
        out.append((plan, place, call, status))
    return out


def test_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(3)
    rows = [(plan, place, f"c{place}", plan == 7, rng.random() < 0.2, None if rng.random() < 0.1 else rng.random() < 0.15) for plan in range(20) for place in range(rng.randrange(1, 9))]
    want = plain(rows)
    assert {s for *_, s in want} == {"invoked", "drifted", "blocked", "stopped"}
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, execution.run(table.repartition(5)).collect())) == want
    for k, part in enumerate((table.where("place < 3"), table.where("place >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    execution.stream(calls).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("plan_id", "place", "call_id", "status").collect())) == want


def test_a_blocked_sink_is_passed_over_and_a_drift_stops(spark):
    rows = [(1, 0, "read", False, False, False), (1, 1, "send", False, True, True), (1, 2, "look", False, False, True), (1, 3, "send2", False, True, False), (1, 4, "end", False, False, False)]
    got = execution.run(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [r.status for r in got] == ["invoked", "blocked", "drifted", "stopped", "stopped"]
    assert execution.run(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert execution.run(spark.createDataFrame(rows, SCHEMA).withColumn("plan_blocked", F.lit(True))).select("status").distinct().count() == 1
