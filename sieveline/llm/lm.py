"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(w | h) = P(class of w | h) * P(w | its class). The class is predicted by a softmax over hashed features of the history:
the previous word, the previous two, the one before the previous (a skip), and the last frequent word however far back (a
long skip). Classes join words that stand after similar frequent words, cut by frequency. Words beyond the ``HEAD`` most
frequent share one class, in which a word has (c + 1) / (N' + V' + 1), so unseen words have their share as well.

Training is distributed: rounds of parameter mixing in which each task takes gradient steps on its own documents from the
common weights, and the new weights are the tasks' weights averaged row by row, weighted by how often a row was updated
(two levels of grouping, so no task gathers all). Each training document is used once. Scoring takes sparse numpy batches.

Texts are read twice: to count words, and to store word numbers, which later steps read. The words beyond the head, and only
they, are joined with their counts. What grows with the corpus is the vocabulary with its counts; the hashed rows of the weights
don't, since every task sends its rows, and tasks times rows would grow with the square. The driver and the tasks hold at most
``HEAD`` words and ``ROWS * (classes)`` weights.

Defined cases: null text counts as empty (its end is a token still); a null id is not held out; repeated rows are scored
each; without training tokens every word is unseen; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import durable

HELD_OUT, REST = 7, 2
HEAD, ANCHORS, GROUPS, BINS, SIGNED = 262_144, 64, 8, 4, 65_536
ROWS, BLOCK, STEP, SLICE, RATE, MIX = 1 << 14, 512, 4096, 1 << 17, 0.5, 0.97
END = " end "  # no word holds a space


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == REST, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over the training documents; each document's end counts under END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
                counts[END.encode()] += 1
            if len(counts) > 400_000:
                yield flush()
        yield flush()

    return docs.where(~held_out()).select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, head: list[str]) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, ids (32 bits each; the end is number 0, words beyond the head len(head)), tail (those words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, other = {w.encode(): k for k, w in enumerate(head)}, len(head)
        for batch in batches:
            all_ids, tails, sizes = [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                words = words_of(text)
                ids = [number.get(w, other) for w in words]
                ids.append(0)
                ids = np.array(ids, np.int32)
                tails.append([words[k].decode() for k in np.flatnonzero(ids == other)])
                all_ids.append(ids.tobytes())
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(sizes, pa.int64()), pa.array(all_ids, pa.binary()), pa.array(tails, pa.list_(pa.string()))], names=["uid", "doc_id", "held_out", "n_tokens", "ids", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, ids binary, tail array<string>")


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of a batch, about SLICE tokens each: from, to, their numbers in one array, where each document starts."""
    buffers = [np.frombuffer(v.as_buffer(), np.int32) for v in column]
    at = 0
    while at < len(buffers):
        to, size = at, 0
        while to < len(buffers) and (to == at or size + len(buffers[to]) <= SLICE):
            size += len(buffers[to])
            to += 1
        sizes = np.array([len(b) for b in buffers[at:to]], np.int64)
        yield at, to, np.concatenate(buffers[at:to]), np.cumsum(sizes) - sizes
        at = to


def _before(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the one before, the one before that, and the last of the ANCHORS most frequent words before; -1: none."""
    n = len(ids)
    first, second = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    first[1:], second[2:] = ids[:-1], ids[:-2]
    first[starts] = -1
    second[starts] = -1
    inner = starts + 1
    second[inner[inner < n]] = -1
    at = np.where((ids > 0) & (ids <= ANCHORS), np.arange(n), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if n else at
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    return first, second, np.where(last >= begin, ids[np.maximum(last, 0)], -1)


def _features(ids: np.ndarray, starts: np.ndarray, n_rows: int = ROWS) -> np.ndarray:
    """Rows of the weights for each token's history, one line a feature."""
    first, second, anchor = _before(ids, starts)
    mixed = [(first + 2) * 4 + 1, ((first + 2) * 1_000_003 + second + 2) * 4 + 2, (second + 2) * 4 + 3, (anchor + 2) * 4]
    hashed = [(m.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n_rows.bit_length() + 1) for m in mixed]
    return np.stack(hashed).astype(np.int64)


def _sum_over_tasks(rows: DataFrame, function, size: int) -> np.ndarray:
    """Adds an array of ``size`` numbers over all documents: a part for each task, summed in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, _, ids, starts in _slices(batch.column(0)):
                function(total, ids, starts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["k", "x"])

    summed = rows.select("ids").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[summed["k"].to_numpy()] = summed["x"].to_numpy()
    return out


def word_classes(training: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The class of each number (end first, tail last) and how many there are."""
    n, anchors = len(counts), min(ANCHORS, len(counts) - 2)
    if anchors < 1:
        return np.minimum(np.arange(n), 1), 2

    def follow(total, ids, starts):
        _, _, anchor = _before(ids, starts)
        both = (anchor > 0) & (ids > 0) & (ids <= ANCHORS)
        total += np.bincount((anchor[both] - 1) * ANCHORS + ids[both] - 1, minlength=len(total))

    table = _sum_over_tasks(training, follow, ANCHORS * ANCHORS).reshape(ANCHORS, ANCHORS)
    table = table + table.T
    shape = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
    group = _means(shape, table.sum(axis=1), GROUPS)
    signed = min(n - 1, SIGNED)

    def signature(total, ids, starts):
        _, _, anchor = _before(ids, starts)
        both = (anchor > 0) & (ids > 0) & (ids < signed)
        total += np.bincount(ids[both].astype(np.int64) * GROUPS + group[anchor[both] - 1], minlength=len(total))

    near = _sum_over_tasks(training, signature, signed * GROUPS).reshape(signed, GROUPS)
    share = (near + 0.5) / np.maximum(near.sum(axis=0, keepdims=True) + 0.5 * signed, 1)
    own = np.zeros(n, np.int64)
    own[:signed] = share.argmax(axis=1)
    own[signed:] = np.arange(n - signed) % GROUPS
    # within a group, words by falling frequency are cut into bins of about equal sums of root counts
    classes = np.zeros(n, np.int64)
    for g in range(GROUPS):
        members = np.flatnonzero((own == g) & (np.arange(n) > 0) & (np.arange(n) < n - 1))
        if len(members):
            mass = np.cumsum(np.sqrt(counts[members]))
            classes[members] = 2 + g * BINS + np.minimum(BINS - 1, (mass * BINS / mass[-1]).astype(np.int64))
    classes[0], classes[n - 1] = 0, 1
    return classes, 2 + GROUPS * BINS


def _means(points: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts; which group each point belongs to."""
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    chosen = [int(weights.argmax())]
    while len(chosen) < min(count, len(points)):
        far = 1 - (points @ points[chosen].T).max(axis=1)
        chosen.append(int((far * np.sqrt(weights)).argmax()))
    centres = points[chosen]
    for _ in range(20):
        own = (points @ centres.T).argmax(axis=1)
        for g in range(len(centres)):
            if (own == g).any():
                centre = (points[own == g] * weights[own == g, None]).sum(axis=0)
                centres[g] = centre / max(np.linalg.norm(centre), 1e-12)
    return own


def _probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = bias + weights[rows[0]]
    for r in rows[1:]:
        logits += weights[r]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _learn(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, updates: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
    """One gradient step on a batch, with a step size for each row of the weights."""
    error = _probabilities(weights, bias, rows)
    error[np.arange(len(wanted)), wanted] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        sorted_rows = r[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        gradient = np.add.reduceat(error[order], first, axis=0)
        at, times = sorted_rows[first], np.diff(np.append(first, len(r)))
        squares[at] += (gradient * gradient).sum(axis=1) / gradient.shape[1]
        weights[at] -= RATE / np.sqrt(1 + squares[at])[:, None] * gradient
        updates[at] += times


def train(training: DataFrame, classes: np.ndarray, n_classes: int, class_log: np.ndarray, n_rows: int = ROWS) -> np.ndarray:
    """Two rounds of parameter mixing: a quarter of the documents first, then the rest."""
    weights, bias = np.zeros((n_rows, n_classes), np.float32), class_log.astype(np.float32)
    lanes = max(1, math.isqrt(training.rdd.getNumPartitions()))  # sums go in two levels of about equal width
    part = F.pmod(F.xxhash64("uid"), F.lit(4))
    for share in (part == 0, part != 0):
        start = weights

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, squares, updates = start.copy(), np.zeros(n_rows, np.float32), np.zeros(n_rows, np.float32)
            for _, _, ids, starts in (part for batch in batches for part in _slices(batch.column(0))):
                rows, wanted = _features(ids, starts, n_rows), classes[ids]
                for at in range(0, len(ids), STEP):
                    _learn(own, bias, squares, updates, rows[:, at : at + STEP], wanted[at : at + STEP])
            task, out = TaskContext.get().partitionId() % lanes, []
            for b in range(0, n_rows, BLOCK):
                if updates[b : b + BLOCK].any():
                    out.append((b, task, (own[b : b + BLOCK] * updates[b : b + BLOCK, None]).astype(np.float32).tobytes(), updates[b : b + BLOCK].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["block", "task", "moved", "updates"])

        parts = training.where(share).select("ids").mapInArrow(run, "block int, task int, moved binary, updates binary")
        summed = parts.groupBy("block", "task").applyInPandas(_added, parts.schema).groupBy("block").applyInPandas(_added, parts.schema)
        weights = start.copy()
        for r in summed.toArrow().to_pylist():
            moved, updates = np.frombuffer(r["moved"], np.float32).reshape(BLOCK, n_classes), np.frombuffer(r["updates"], np.float32)
            seen = updates > 0
            weights[r["block"] : r["block"] + BLOCK][seen] = moved[seen] / updates[seen, None]
    return weights


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    total = [sum(np.frombuffer(x, np.float32).astype(np.float64) for x in parts[name]).astype(np.float32).tobytes() for name in ("moved", "updates")]
    return pd.DataFrame({"block": [parts["block"].iloc[0]], "task": [parts["task"].iloc[0]], "moved": [total[0]], "updates": [total[1]]})


def score_documents(docs: DataFrame, head_size: int = HEAD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counts = durable(count_words(docs))
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_words = facts["n"], facts["v"]
    ends = counts.where(F.col("word") == END).select("c").first()
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(head_size).toArrow()
    head = [END, *top["word"].to_pylist()]
    known = np.array([ends["c"] if ends else 0, *top["c"].to_pylist()], np.float64)
    tail_words, tail_tokens = n_words - len(head) + (0 if ends else 1), n_train - known.sum()
    all_counts = np.append(known, max(tail_tokens, 1))

    encoded = durable(encode(docs, head))
    training = encoded.where(~F.col("held_out")).select("uid", "ids")
    classes, n_classes = word_classes(training, all_counts)
    in_class = np.bincount(classes, weights=all_counts, minlength=n_classes)
    class_share = (in_class + 0.5) / (in_class + 0.5).sum()
    weights = train(training, classes, n_classes, np.log(class_share))
    bias = np.log(class_share).astype(np.float32)
    # log10 of P(word | class); of the tail's only what all its words share, the rest follows from the join
    word_log = np.log10(np.maximum(all_counts, 1) / np.maximum(in_class[classes], 1))
    word_log[-1] = -np.log10(tail_tokens + tail_words + 1)
    base_log, base_whole = np.append(np.log10(known + 1), 0.0), float(np.log10(n_train + n_words + 1))
    is_known = np.append(known > 0, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, base, known_here = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last, ids, starts in _slices(batch.column(4)):
                wanted, found = classes[ids], np.empty(len(ids))
                rows = _features(ids, starts)
                for at in range(0, len(ids), STEP):
                    p = _probabilities(weights, bias, rows[:, at : at + STEP])
                    c = wanted[at : at + STEP]
                    found[at : at + STEP] = np.log10(MIX * p[np.arange(len(c)), c] + (1 - MIX) * class_share[c])
                for out, values in ((score, found + word_log[ids]), (base, base_log[ids] - base_whole), (known_here, is_known[ids].astype(np.int64))):
                    out[first:last] = np.add.reduceat(values, starts)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(score), pa.array(base), pa.array(known_here), batch.column(5)], names=["uid", "doc_id", "held_out", "n_tokens", "score", "base", "known", "tail"])

    scored = encoded.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, score double, base double, known long, tail array<string>")
    per_doc = scored.drop("tail")
    tail = encoded.select("uid", F.explode("tail").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("times"))
    found = tail.join(counts, "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("times")).withColumnRenamed("uid", "t_uid")
    joined = per_doc.join(found, F.col("uid") == F.col("t_uid"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("times", F.lit(0))).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
