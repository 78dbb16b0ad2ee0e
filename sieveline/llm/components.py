"""Connected components by alternating large and small stars, all in DataFrames.

Each round points every node to the smallest node it knows; the edges end as stars round the smallest node of each
component. Rounds grow with the logarithm of the component size. Every round is written to the shared folder, and only two
numbers (count and hash sum of the edges) come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("at", "low").alias("low"))
    return both.join(least, F.col("a") == F.col("at")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at")
    moved = down.join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionAll(least.select(F.col("at").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node of an edge; root is the smallest node of the component."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state, now = seen, durable(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
