"""Licence scan with a positional rare-token index.

Templates are sequences of words, each of a licence label, with mandatory key phrases in them; the phrases of the base contract
are templates that are mandatory as a whole. The index is a table of postings: word, template, place in it, and the word's
weight, its IDF over all documents. A file matches a template where, at one relative position (a word's place in the file
minus its place in the template), words that hold at least ``SHARE`` of the template's weight stand in their places and every
mandatory phrase stands whole.

Files are looked up by rare words only: of each template its heaviest words until the others hold less than the share, so
a file without any of them cannot match (prefix filtering; nothing is lost). Of files that also hold enough weight in all, the places of the
template words are taken out in the same scan, joined with the postings (as many rows as templates have words, whatever the
corpus), and summed per relative position. Counting weights is one scan of the texts, looking up the other; texts are never
shuffled or written, and what is shuffled is one small row for each file and for each place of a template word in a file that can match.

DataFrame functions only. Weights are whole numbers (millionths), so sums don't depend on order.

Defined cases: null text counts as empty: no words, null places, empty labels, score 0. Rows that repeat (id and text) are scanned and
returned each. Very long texts are taken whole. Equal weights are ordered by word, equal shares need no order, as all places count. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import durable, text_or_empty

SHARE, UNIT = 0.7, 1_000_000
#: The phrases of the contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of public licence notices, their labels, and the phrases in them that must stand whole.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ("provided as is without warranty of any kind",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms with or without modification",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
]
#: The Kelvin sign is the only character outside ASCII whose lower case is in ASCII; another one stands for it before ``lower``.
_KELVIN, _ANGSTROM = "\u212a", "\u212b"


def words(text: Column) -> Column:
    """Words of a text. Letters outside ASCII are lower-cased too, which changes no ASCII word and no number of words."""
    low = F.lower(F.replace(text, F.lit(_KELVIN), F.lit(_ANGSTROM)))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


class Index:
    """The templates (with the base phrases as the first ones), their postings and, once weights are known, their rare words.

    What it holds is as large as the templates; it is written into the plan as literals; words are of letters and digits."""

    def __init__(self, templates: list[tuple[str, str, tuple[str, ...]]], base: dict[str, str]):
        self.n_base = len(base)
        self.labels = [*base.values(), *(label for label, _, _ in templates)]
        self.words = [phrase.split() for phrase in base] + [text.split() for _, text, _ in templates]
        keys = [(phrase,) for phrase in base] + [k for _, _, k in templates]
        self.mandatory = [reduce(set.union, (self._places(own, key.split()) for key in phrases), set()) for own, phrases in zip(self.words, keys, strict=True)]
        self.vocabulary = sorted({w for own in self.words for w in own})

    @staticmethod
    def _places(text: list[str], phrase: list[str]) -> set[int]:
        for at in range(len(text) - len(phrase) + 1):
            if text[at : at + len(phrase)] == phrase:
                return set(range(at, at + len(phrase)))
        raise ValueError(f"the mandatory phrase {' '.join(phrase)} isn't in its template")

    def weigh(self, n: int, found: dict[str, int], share: float) -> None:
        """Weights from the number of documents and of those that hold each word; what a template needs, and its rare words."""
        self.weight = {w: max(1, round(UNIT * math.log((n + 1) / (found.get(w, 0) + 0.5)))) for w in self.vocabulary}
        self.whole = [sum(self.weight[w] for w in own) for own in self.words]
        self.needed = [total if t < self.n_base else math.ceil(share * total) for t, total in enumerate(self.whole)]
        self.rare = []
        for own, total, needed in zip(self.words, self.whole, self.needed, strict=True):
            left, rare = total, []
            for w in sorted(set(own), key=lambda w: (-self.weight[w], w)):
                if left < needed:
                    break
                rare.append(w)
                left -= self.weight[w] * own.count(w)
            self.rare.append(rare)

    def possible(self, present: str) -> str:
        """SQL: whether the words (distinct, of the vocabulary) can match any template: a rare word, and weight enough in all."""
        fits = []
        for own, rare, needed in zip(self.words, self.rare, self.needed, strict=True):
            held = " + ".join(f"IF(array_contains({present}, '{w}'), {self.weight[w] * own.count(w)}L, 0L)" for w in sorted(set(own)))
            fits.append(f"arrays_overlap({present}, {_array(rare)}) AND {held} >= {needed}")
        return " OR ".join(fits)

    def postings(self, spark: SparkSession) -> DataFrame:
        """word, template, place, weight, must, rare: a row for each word of each template."""
        rows = ", ".join(f"('{w}', {t}, {p}L, {self.weight[w]}L, {int(p in self.mandatory[t])}, {w in self.rare[t]})" for t, own in enumerate(self.words) for p, w in enumerate(own))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS p(word, template, place, weight, must, rare)")

    def facts(self, spark: SparkSession) -> DataFrame:
        """t, label, base, whole, needed, musts: a row for each template."""
        rows = ", ".join(f"({t}, '{label}', {t < self.n_base}, {self.whole[t]}L, {self.needed[t]}L, {len(self.mandatory[t])})" for t, label in enumerate(self.labels))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS f(t, label, base, whole, needed, musts)")


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def weighed_index(docs: DataFrame, templates: list = TEMPLATES, base: dict = BASE, share: float = SHARE) -> Index:
    """The index with weights from all documents; the driver gets one count for each word of the templates."""
    index = Index(templates, base)
    held = docs.select(F.explode(F.array_append(F.array_intersect(F.expr(_array(index.vocabulary)), words(text_or_empty())), F.lit(""))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    index.weigh(found.pop("", 0), found, share)
    return index


def matches(rows: DataFrame, index: Index) -> DataFrame:
    """row, label, base, at, weight, whole for each place of a template; rows has row and hits (word, place in the file)."""
    spark = rows.sparkSession
    hits = rows.select("row", F.inline("hits"))
    votes = hits.join(F.broadcast(index.postings(spark)), "word")  # a row for each word of the templates
    summed = votes.groupBy("row", "template", (F.col("at") - F.col("place")).alias("at")).agg(F.sum("weight").alias("weight"), F.sum("must").alias("must"), F.bool_or("rare").alias("rare"))
    facts = F.broadcast(index.facts(spark))  # a row for each template
    return summed.join(facts, F.col("template") == F.col("t")).where("rare AND weight >= needed AND must = musts").select("row", "label", "base", "at", "weight", "whole")


def license_scan(docs: DataFrame, templates: list = TEMPLATES, base: dict = BASE, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share of a template's weight at one place)."""
    index = weighed_index(docs, templates, base, share)

    # transform over an array of one binds its element once, whatever the optimiser moves around
    hits = f"""transform(array(array_intersect({_array(index.vocabulary)}, ws)), own -> CASE WHEN {index.possible("own")} THEN
      filter(transform(ws, (w, i) -> struct(w AS word, bigint(i) AS at)), x -> array_contains(own, x.word)) ELSE array() END)[0]"""
    scanned = docs.select("doc_id", F.array(words(text_or_empty())).alias("bound")).select("doc_id", F.expr(f"transform(bound, ws -> struct(bigint(size(ws)) AS n_words, {hits} AS hits))[0]").alias("s"))
    rows = durable(scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.n_words", "s.hits"))
    found = matches(rows.where(F.size("hits") > 0), index)
    base_at = F.when(F.col("base"), F.col("at"))
    named = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")  # noqa: E731  at most as many as there are labels
    told = found.groupBy(F.col("row").alias("f_row")).agg(F.count(base_at).alias("n_base"), F.min(base_at).alias("first_word"), F.max(base_at).alias("last_word"), named(F.when(F.col("base"), F.col("label"))).alias("base_labels"), named(F.col("label")).alias("labels"), F.max(F.col("weight") / F.col("whole")).alias("score"))
    joined = rows.select("row", "doc_id", "n_words").join(told, F.col("row") == F.col("f_row"), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle(templates: list = TEMPLATES, base: dict = BASE, share: float = SHARE) -> str:
    """The same without the rare words: every place of every template word votes."""
    index = Index(templates, base)
    rows = ", ".join(f"('{w}', {t}, {p}, {int(p in index.mandatory[t])})" for t, own in enumerate(index.words) for p, w in enumerate(own))
    facts = ", ".join(f"({t}, '{label}', {str(t < index.n_base).lower()}, {len(index.mandatory[t])})" for t, label in enumerate(index.labels))
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS u, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p(word, template, place, must) AS (VALUES {rows}), f(template, label, base, musts) AS (VALUES {facts}),
h AS MATERIALIZED (SELECT u, pos - 1 AS pos, ws[pos] AS word FROM (SELECT u, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d) WHERE ws[pos] IN (SELECT word FROM p)),
n AS (SELECT w.word, greatest(1, round({UNIT} * ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT h.u) + 0.5::DOUBLE))))::BIGINT AS weight FROM (SELECT DISTINCT word FROM p) w LEFT JOIN h ON h.word = w.word GROUP BY w.word),
k AS MATERIALIZED (SELECT p.*, weight FROM p JOIN n USING (word)),
t AS (SELECT f.*, whole, CASE WHEN base THEN whole ELSE ceil({share} * whole) END AS needed FROM f JOIN (SELECT template, sum(weight) AS whole FROM k GROUP BY template) USING (template)),
m AS (SELECT u, template, h.pos - k.place AS pos, sum(weight) AS weight, sum(must) AS must FROM h JOIN k USING (word) GROUP BY ALL),
r AS (SELECT m.u, m.pos, m.weight, t.whole, t.label, t.base FROM m JOIN t USING (template) WHERE m.weight >= t.needed AND m.must = t.musts),
g AS (SELECT u, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight::DOUBLE / whole) AS score FROM r GROUP BY u)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN g USING (u)
"""
