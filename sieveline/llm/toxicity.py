"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exceptions.

Folding: compatibility forms and case, look-alike letters of other scripts to Latin ones, digits and signs that stand for
letters, no invisible characters; words joined by single spaces. Lexicon entries are whole words and beginnings of words
whose log-odds of standing in a toxic document are significant. An occurrence counts once, with the largest weight of the
entries that match at its word. Exception phrases are pairs of neighbouring words that hold an entry and yet stand mostly in
documents that aren't toxic; an occurrence in one counts nothing. The score is a logistic function of the sum of weights
and of that sum by length.

Learning uses at most ``SAMPLE`` labelled rows (by hash of the id), never those held out, and passes the texts of those
rows only; the model is a few thousand entries. Scoring is one pass over all documents without a shuffle.

Defined cases: null text counts as empty and gets the score of a text without hits; without usable labels every score is
that of the prior; a null id is not held out and never labelled; rows of a repeated id are scored alike if their texts are; an empty table gives an empty result; other
columns are ignored, and labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT, SAMPLE, ENTRIES, PHRASES, SUPPORT, EVIDENCE, COUNTED = 5, 200_000, 4000, 2000, 5, 24.0, 150_000
#: Look-alike letters and the digits and signs used for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
INVISIBLE = "​‌‍⁠﻿­"
_FOLD = str.maketrans(LOOKALIKES | {c: None for c in INVISIBLE})
_LEET = re.compile(r"(?<=\w)[@$!€](?=\w)|[@$](?=[^\W\d_])|(?<=[^\W\d_])[0134578]+|[0134578]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W_]+")


_STRANGE = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "]")
_folded: dict[str, str] = {}


def _fold_word(word: str) -> str:
    """A word with other than letters in it; what it gives is kept for the next time, in a table that is emptied when full."""
    found = _folded.get(word)
    if found is None:
        if len(_folded) > 100_000:
            _folded.clear()
        found = _folded[word] = _OTHER.sub(" ", _LEET.sub(lambda m: "".join(DIGITS.get(c, c) for c in m[0]), word)).strip()
    return found


def fold(text: str) -> str:
    """The words of the text, folded, each between single spaces."""
    low = text.lower()
    if not low.isascii():
        if not unicodedata.is_normalized("NFKC", low):
            low = unicodedata.normalize("NFKC", low)
        if _STRANGE.search(low):
            low = low.translate(_FOLD)
    words = [w if w.isalpha() else _fold_word(w) for w in low.split()]
    return f" {' '.join([w for w in words if w])} "


def entries_of(word: str) -> Iterator[str]:
    """The lexicon entries that a word can match: itself (between spaces) and its beginnings."""
    if 3 <= len(word) <= 16:
        yield f" {word} "
    for n in range(4, min(len(word), 8)):
        yield f" {word[:n]}"


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def key(self):
        return tuple(sorted(self.weights.items())), frozenset(self.exceptions)


@lru_cache(maxsize=4)
def _automaton(key):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in key[0]:
        found.add_word(entry, (len(entry), weight))
    if len(found):
        found.make_automaton()
    return found


def hits(folded: str, automaton) -> dict[int, float]:
    """The weight at each matched word, by where the space before it stands."""
    found: dict[int, float] = {}
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            at = end - length + 1
            found[at] = max(weight, found.get(at, weight))
    return found


def neighbours(folded: str, at: int) -> tuple[str, str, str]:
    """The word before, the word after the space at ``at``, and the one that follows it."""
    before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
    end = folded.find(" ", at + 1)
    after = folded.find(" ", end + 1)
    return before, folded[at + 1 : end], folded[end + 1 : after] if after > 0 else ""


def measure(text: str, model: Model, automaton) -> tuple[float, float]:
    """Log of the sum of weights, and the sum per hundred words."""
    folded = fold(text)
    total = 0.0
    for at, weight in hits(folded, automaton).items():
        if model.exceptions:
            before, word, after = neighbours(folded, at)
            if (before, word) in model.exceptions or (word, after) in model.exceptions:
                continue
        total += weight
    return float(np.log1p(total)), total / (1 + folded.count(" ") / 100)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of at most ``sample`` labelled rows: their ids and labels, some 10 MB at most, may be broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("l_id"), "toxic")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "toxic")


def _counted(rows: DataFrame, per_text) -> DataFrame:
    """entry, toxic_n, clean_n: in how many texts of each label per_text finds an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["entry", "toxic_n", "clean_n"])
            for c in counts:
                c.clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[1 if toxic else 0].update(per_text(text))
                if sum(map(len, counts)) > COUNTED:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "entry string, toxic_n long, clean_n long").groupBy("entry").agg(F.sum("toxic_n").alias("toxic_n"), F.sum("clean_n").alias("clean_n"))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a ridge, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(beta.tolist())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = _training(docs, labels, sample)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(coefficients=(float(np.log((toxic + 1) / (clean + 20))), 0.0, 0.0))

    def entries(text: str) -> set[str]:
        return {e for w in set(fold(text).split()) for e in entries_of(w)}

    odds = F.log((F.col("toxic_n") + 0.5) / (toxic + 1)) - F.log((F.col("clean_n") + 0.5) / (clean + 1))
    # the likelihood-ratio statistic against the share of toxic texts holds for small counts too; 24 is one chance in a million
    share, both = toxic / (toxic + clean), F.col("toxic_n") + F.col("clean_n")
    more = lambda n, p: F.when(n > 0, n * F.log(n / (both * F.lit(p)))).otherwise(F.lit(0.0))
    evidence = 2 * (more(F.col("toxic_n"), share) + more(F.col("clean_n"), 1 - share))
    counted = _counted(rows, entries).where(F.col("toxic_n") >= SUPPORT).select("entry", odds.alias("weight"), evidence.alias("evidence"))
    best = counted.where(f"evidence >= {EVIDENCE} AND weight > 1").orderBy(F.desc("evidence"), "entry").limit(ENTRIES).collect()
    model = Model({r["entry"]: r["weight"] for r in best})
    key = model.key()

    def phrases(text: str) -> set[str]:
        folded, found = fold(text), set()
        for at in hits(folded, _automaton(key)):
            before, word, after = neighbours(folded, at)
            found |= {f"{before} {word}", f"{word} {after}"}
        return found

    mostly_clean = (F.col("clean_n") >= 3) & (F.col("clean_n") * toxic > F.col("toxic_n") * clean)
    model.exceptions = {tuple(r["entry"].split(" ")) for r in _counted(rows, phrases).where(mostly_clean).orderBy(F.desc("clean_n"), "entry").limit(PHRASES).collect()}
    points = rows.select(_measured(model, F.col("text")).alias("m"), "toxic").select("m.x1", "m.x2", "toxic").toPandas()  # at most SAMPLE rows
    model.coefficients = _calibrate(points[["x1", "x2"]].to_numpy(), points["toxic"].to_numpy(float))
    return model


def _measured(model: Model, text: Column) -> Column:
    @F.pandas_udf("x1 double, x2 double")
    def run(texts: pd.Series) -> pd.DataFrame:
        automaton = _automaton(model.key())
        return pd.DataFrame([measure(t, model, automaton) for t in texts], columns=["x1", "x2"])

    return run(text)


def score(model: Model, text: Column) -> Column:
    """The probability of label 1."""
    b0, b1, b2 = model.coefficients

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(model.key())
        x = np.array([measure(t, model, automaton) for t in texts]).reshape(len(texts), 2)
        return pd.Series(1 / (1 + np.exp(-np.clip(b0 + x @ np.array([b1, b2]), -30, 30))))

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    model = train(docs, labels, sample)
    return docs.where(score(model, F.col("text")) < 0.5)
