"""The stream of changes gives the rows of the difference of snapshots."""

from pyspark.sql import functions as F

from sieveline.operators.incremental import snapshot_diff
from sieveline.streaming import source_changes

SCHEMA = "uri string, content_hash string, seen_at timestamp"


def streamed(spark, path, snapshots, **options):
    for k, rows in enumerate(snapshots):
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in/{k}")
        found = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        source_changes.changes(found, **options).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_two_micro_batches_give_the_difference(spark, tmp_path):
    at = lambda rows, time: spark.createDataFrame(rows, "uri string, content_hash string").withColumn("seen_at", F.to_timestamp(F.lit(time)))
    before = [("a", "1"), ("b", "2"), ("c", "3"), ("gone", "4")]
    after = [("a", "1"), ("b", "9"), ("c", "3"), ("new", "5")]
    first, second = at(before, "2024-01-01 00:00:00"), at(after, "2024-01-01 01:00:00")
    rows = streamed(spark, str(tmp_path), [first, second], unchanged=True).collect()
    assert {r.uri: r.status for r in rows if r.seen_at.hour == 0 and r.status != "removed"} == dict.fromkeys("abc", "added") | {"gone": "added"}
    later = {(r.uri, r.status) for r in rows if r.seen_at.hour == 1 or r.status == "removed"}
    assert later == {(r.uri, r.status) for r in snapshot_diff(first.drop("seen_at"), second.drop("seen_at")).collect()}
    assert len(rows) == 4 + 5
