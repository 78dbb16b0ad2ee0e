"""Filter interaction audit: what each of five filters does in every order, per part of the corpus.

Each text gets a mask of the filters that it fails: A under 200 words, B too few distinct words, C too many capitals, D holds a
code symbol, E a text that a smaller doc_id has already. The corpus is then counted once, into cells (part, mask), and orders
are told from the cells alone: a recursive CTE starts from the empty prefix of each part, extends prefixes with the letters
that they don't hold yet, joins the part's mask cells, and carries the applied bits; each level emits that step's metrics,
which the prefix keeps. The 120 prefixes of full length are the orders. Work after the counting is fixed per part (326
prefixes over at most 32 cells), however many documents there are.

E compares texts by their SHA-256 over the whole table. Documents are counted by id and hash first, then by hash and what
else a cell needs, so a text that a third of all rows share is combined on the map side, and the smallest id of a hash is a
window over its few counted cells, never over its documents. Labels are joined by id, as small rows.

Defined cases: null text counts as empty; empty texts have no words and fail A only (and E, if a smaller id is empty too). A
null source is the part ''. A null doc_id has no smaller one, so its row never fails E, and it has no label; of rows that
repeat an id none is smaller. Where labels repeat an id, any row with quality 1 (toxic 1) counts. Very long texts are taken
whole. Ties don't arise: no order among rows is used. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import durable, text_or_empty

#: The filters and their bits.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_mask(text: Column) -> Column:
    """The bits of A to D, which a text fails on its own."""

    def of(ws: Column) -> Column:
        n, distinct = F.size(ws), F.size(F.array_distinct(ws))
        return F.when(n < MIN_WORDS, BITS["A"]).otherwise(0) + F.when(100 * distinct < DISTINCT_PERCENT * n, BITS["B"]).otherwise(0)

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    by_words = F.element_at(F.transform(F.array(words), of), 1)  # bound once, whatever the optimiser moves around
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return by_words + F.when(100 * capitals > CAPITAL_PERCENT * F.length(text), BITS["C"]).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), BITS["D"]).otherwise(0)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and set of failed filters, and how many of them are labelled so."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_key"), row_mask(text).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = rows.join(marks, F.col("id") == F.col("l_id"), "left").na.fill(False, ["good", "toxic"])
    kinds = ["text_key", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    counted = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.min("id").alias("first_id"), F.min_by("n", "id").alias("n_first"))
    first = F.min("first_id").over(Window.partitionBy("text_key"))
    passes = F.col("n_null") + F.when(F.col("first_id") == first, F.col("n_first")).otherwise(0)
    split = counted.withColumn("passes", passes).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("passes").alias("k")), F.struct((F.col("mask") + BITS["E"]).alias("mask"), (F.col("n") - F.col("passes")).alias("k")))).alias("c"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col(name), F.col("c.k"))), F.lit(0)).alias(name)
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.k").alias("n"), of("good"), of("toxic"))


def _total(what: str, where: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + CASE WHEN {where} THEN x.{what} ELSE 0L END)"


_FAILS, _OPEN = "x.mask & bit <> 0", "x.mask & w.applied = 0"
_STEP = ", ".join(f"'{name}', {_total(what, where)}" for name, what, where in (
    ("kept", "n", "x.mask & (w.applied | bit) = 0"), ("removed", "n", f"{_FAILS} AND {_OPEN}"), ("redundant", "n", f"{_FAILS} AND NOT {_OPEN}"),
    ("unique_fails", "n", "x.mask = bit"), ("good_lost", "good", f"{_FAILS} AND {_OPEN}"), ("toxic_lost", "toxic", f"{_FAILS} AND {_OPEN}"),
))
_LETTERS = ", ".join(f"named_struct('letter', '{letter}', 'bit', {bit})" for letter, bit in BITS.items())
#: LIMIT ALL lifts Spark's row limit on recursion, which many parts would meet.
WALK = f"""
WITH RECURSIVE walk(part, filter_order, applied, step, steps) AS (
  SELECT part, '', 0, 0, CAST(array() AS array<struct<{", ".join(f"{m}: bigint" for m in METRICS)}>>) FROM {{cells}}
  UNION ALL
  SELECT w.part, concat(w.filter_order, letter), w.applied | bit, w.step + 1, array_append(w.steps, named_struct({_STEP}))
  FROM (SELECT *, inline(filter(array({_LETTERS}), l -> applied & l.bit = 0)) FROM walk WHERE step < {len(BITS)}) w
  JOIN {{cells}} c ON c.part = w.part)
SELECT part, filter_order, steps FROM (SELECT * FROM walk LIMIT ALL) WHERE step = {len(BITS)}
"""


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    packed = mask_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    walked = docs.sparkSession.sql(WALK, cells=durable(packed))
    each = walked.select("part", "filter_order", F.posexplode("steps").alias("at", "m"))
    rows = each.select("part", "filter_order", (F.col("at") + 1).alias("step"), *[F.col(f"m.{m}").alias(m) for m in METRICS])
    own = Window.partitionBy("part", F.substr("filter_order", F.col("step"), F.lit(1)))  # 120 rows each
    return rows.withColumn("shapley", F.sum("removed").over(own))


ORACLE = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
m AS MATERIALIZED (
  SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM w),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT '' AS filter_order, 0 AS applied UNION ALL
  SELECT o.filter_order || l.letter, o.applied | l.bit FROM o JOIN l ON o.applied & l.bit = 0),
s AS (
  SELECT f.filter_order, k.step, l.bit, p.applied FROM (SELECT filter_order FROM o WHERE length(filter_order) = 5) f, (VALUES (1), (2), (3), (4), (5)) k(step)
  JOIN l ON l.letter = substr(f.filter_order, k.step, 1) JOIN o p ON p.filter_order = left(f.filter_order, k.step - 1)),
r AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (applied | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0) AS removed,
    sum(n) FILTER (mask & bit <> 0 AND mask & applied <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit <> 0 AND mask & applied = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & applied = 0) AS toxic_lost
  FROM s, c GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""
