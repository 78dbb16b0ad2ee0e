"""Exact deduplication: group by a 128-bit content hash, keep one row, compare bytes inside the groups.

Equal texts are those identical once white space (0x20, 0x09 to 0x0D) is deleted. Of equal texts the row with the most
code points in its original text stays, then the one with the smallest id, then the first one stored: exactly one row of
each group. Rows are written first, with a number each, so that all reads agree on the numbers.

One shuffle moves each distinct text of a partition once: ``collect_set`` combines copies on the map side, so a text that
a third of all rows share leaves every partition as a single row. The set is also the byte comparison: two different
texts under one hash stay two elements of it. Rows are told apart by a second hash (SHA-256), so that a collision of the
first splits the group; a set with two members under both hashes stops the job instead of dropping a text.

Rows then look their group up. Groups larger than a ``HOT_GROUPS``-th of the rows number at most ``HOT_GROUPS``, so they are
broadcast and their rows stay where they are; the other groups are joined by hash.

Defined cases: null text counts as empty, and all empty texts are equal. A null id never wins over an id that is set; a
group with null ids only has a null keep_id and keeps one row. Of rows that repeat both id and text one stays at most. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE_CLASS, durable, numbered, text_or_empty, unused

HOT_GROUPS, SMALL_GROUP = 10_000, 64


def _keyed(rows: DataFrame, digest: Callable[[Column], Column], row: str) -> DataFrame:
    norm = F.regexp_replace(text_or_empty(), f"{SPACE_CLASS}+", "")
    keyed = rows.select(F.col(row).alias("__row"), "doc_id", F.length(text_or_empty()).cast("long").alias("n_points"), norm.alias("norm"))
    return keyed.select("__row", "doc_id", "n_points", digest(F.col("norm")).alias("content_key"), F.sha2("norm", 256).alias("text_sha256"), "norm")


def _groups(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: content_key, text_sha256, keep (the id and number of the row that stays), group_size."""
    # ~id and ~number turn their order around without overflow, so that max_by takes the smallest
    best = F.struct(F.col("doc_id").isNotNull(), "n_points", F.bitwise_not(F.col("doc_id").cast("long")), F.bitwise_not("__row"))
    keep = F.max_by(F.struct("doc_id", F.col("__row").alias("row")), best).alias("keep")
    grouped = keyed.groupBy("content_key", "text_sha256").agg(keep, F.count(F.lit(1)).alias("group_size"), F.collect_set("norm").alias("texts"))
    same = F.when(F.size("texts") <= 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share both hashes")).cast("long"))
    return grouped.select("content_key", "text_sha256", "keep", same.alias("group_size"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = durable(_keyed(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text"), digest, "__row"))
    groups = durable(_groups(keyed)).withColumnsRenamed({"content_key": "g_key", "text_sha256": "g_sha"})
    rows = keyed.drop("norm", "n_points")
    hot = F.col("group_size") > max(SMALL_GROUP, keyed.count() // HOT_GROUPS)
    same = (F.col("content_key") == F.col("g_key")) & (F.col("text_sha256") == F.col("g_sha"))
    large = F.broadcast(groups.where(hot))  # HOT_GROUPS rows at most
    joined = rows.join(large, same).unionByName(rows.join(large, same, "left_anti").join(groups.where(~hot), same))
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("keep.row")).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row, keep = unused(docs, "__row"), unused(docs, "__keep")
    rows = numbered(docs, row)
    groups = _groups(_keyed(rows, digest, row)).where(F.col("group_size") > 0)  # the size holds the byte comparison
    return rows.join(groups.select(F.col("keep.row").alias(keep)), F.col(row) == F.col(keep), "left_semi").drop(row)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
