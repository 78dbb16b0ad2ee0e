"""The given tables as nodes and edges of one property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.store import read_table

#: Sources of this prefix count as external content.
EXTERNAL = "src1"


def _id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    uri = F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    trust = F.when(F.col("source").startswith(EXTERNAL), "external_content").otherwise("retrieved_document")
    return docs.select("doc_id", F.lit("document").alias("kind"), uri.alias("uri"), trust.alias("trust_domain"), F.lit("none").alias("instruction_authority"), F.col("text").alias("content"), "lang", "source")


def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as 'requires' edges."""
    t = lambda name: read_table(spark, sf_dir, name)
    lines = t("lineitem").withColumn("line", F.concat_ws(".", "l_orderkey", "l_linenumber"))
    pairs = [
        (lines, "line", "line", "order", "l_orderkey"), (lines, "line", "line", "part", "l_partkey"), (lines, "line", "line", "supplier", "l_suppkey"),
        (t("orders"), "order", "o_orderkey", "customer", "o_custkey"), (t("customer"), "customer", "c_custkey", "nation", "c_nationkey"),
        (t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"), (t("nation"), "nation", "n_nationkey", "region", "n_regionkey"),
    ]
    return reduce(DataFrame.unionAll, (df.select(_id(a, x).alias("src"), _id(b, y).alias("dst"), F.lit("requires").alias("edge_type")) for df, a, x, b, y in pairs))


def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn responds to the one before it."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    turn = lambda n: F.concat_ws(".", "conv_id", n)
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"))
    return turns.join(earlier, ["conv_id", "turn"]).select(turn(F.col("turn")).alias("src"), turn(F.col("turn") - 1).alias("dst"), F.lit("responds_to").alias("edge_type"))


def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types, each leading to the type of the next event."""
    from pyspark.sql import Window

    events = read_table(spark, sf_dir, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    node = lambda kind: F.concat_ws(":", F.col("user_id").cast("string"), kind)
    return events.select("user_id", "event_type", following.alias("next_type")).where("next_type IS NOT NULL").select("user_id", node(F.col("event_type")).alias("src"), node(F.col("next_type")).alias("dst"), F.lit("enables").alias("edge_type"))


def copy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents: every other one is superseded by that of the smallest id."""
    return copies(read_table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash")))


def copies(docs: DataFrame) -> DataFrame:
    """The same for rows of doc_id and content_hash."""
    kept = docs.groupBy("content_hash").agg(F.min("doc_id").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content_hash", "dst")
    return docs.join(kept, "content_hash").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst", F.lit("supersedes").alias("edge_type"))
