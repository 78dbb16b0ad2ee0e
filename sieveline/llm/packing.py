"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window of ``SIZE`` tokens gives each queue a quantum in proportion to
its target share; the fraction of a token that a queue couldn't take is its deficit, carried to the next window. Summed over
windows the deficits telescope, so what queue j has given after k windows is floor(k * SIZE * S_j) - floor(k * SIZE * S_(j-1)),
where S_j are the cumulative shares. Any token's window and offset therefore follow from its place in its queue alone: the
windows need no driver, no order of tasks and no shuffle of tokens, and deficits carry over partitions as over windows.
A queue that runs out ends a phase; the window in which that happens is filled round-robin by what is left, and the other
queues go on with their shares scaled up.

Each source with a target is scheduled by itself; the sources without one share what is left of the target, in proportion to
their own tokens, by the same rule inside their common part, so that all of them end together. Only the targets, which the
caller gives, and their totals come to the driver; sources are rows of a table, however many there are. Without targets every
window has the corpus's own proportions.

Steps: (1) tokenise each document once and store its ids with their place in the partition's part of the queue; (2) sum the
parts by partition and source, and make running sums of these sums; (3) cut the stored ids at the window borders.

Defined cases: null text counts as empty (its end id is packed still); null source is the source ''; a target without
documents gives its share to the others; repeated rows are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import durable, running_total

SIZE, END = 2048, 1
NAME = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@lru_cache
def _encoders(name: str):
    """The tokenizer file's own library, and the same vocabulary in a faster one."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), fast


def token_ids(text: str, name: str = NAME) -> np.ndarray:
    """The ids of tokenizers' encode(text, add_special_tokens=False), then the end id."""
    exact, fast = _encoders(name)
    ids = exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_to_numpy(text)
    return np.append(np.asarray(ids, dtype="<u4"), np.uint32(END)).astype("<u4")


def tokenise(docs: DataFrame, name: str = NAME) -> DataFrame:
    """doc_id, chunk, source, place (of its first token in the chunk's part of the queue), n_tokens, ids (16 bits each where they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, places = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            starts, lengths, ids = [], [], []
            for text, source in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = token_ids(text.as_py() or "", name)
                starts.append(places[source])
                lengths.append(len(found))
                ids.append(found.astype("<u2").tobytes() if found.max() < 65536 else found.tobytes())
                places[source] += len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([chunk] * len(ids), pa.int32()), batch.column(2), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "chunk", "source", "place", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(run, "doc_id long, chunk int, source string, place long, n_tokens long, ids binary")


def schedule(totals: list[int], weights: list[int], size: int = SIZE) -> list[dict]:
    """The phases: windows k0 to k1 of ``size`` tokens, each queue's tokens given before, cumulative weights and their sum."""
    left, given, k, phases, n = list(totals), [0] * len(totals), 0, [], len(totals)

    def taken(windows: int, size: int, cum: list[int]) -> list[int]:
        reach = [windows * size * c // cum[-1] for c in cum]
        return [b - a for a, b in zip(reach, reach[1:], strict=False)]

    def add(windows: int, size: int, cum: list[int]) -> None:
        nonlocal k
        phases.append({"k0": k, "k1": k + windows, "size": size, "given": list(given), "cum": cum})
        for j, t in enumerate(taken(windows, size, cum)):
            given[j] += t
            left[j] -= t
        k += windows

    while sum(left):
        active = [w if x else 0 for w, x in zip(weights, left, strict=True)]
        cum = [0, *accumulate(active if sum(active) else left)]
        low, high = 0, sum(left) // size
        while low < high:  # the most windows that overdraw no queue
            mid = (low + high + 1) // 2
            low, high = (mid, high) if all(t <= x for t, x in zip(taken(mid, size, cum), left, strict=True)) else (low, mid - 1)
        if low:
            add(low, size, cum)
            continue
        rest, takes = min(size, sum(left)), [0] * n
        while sum(takes) < rest:  # one window, round after round until it is full
            open_weights = [(w or 1) if x > t else 0 for w, x, t in zip(active if sum(active) else left, left, takes, strict=True)]
            quanta = taken(1, rest - sum(takes), [0, *accumulate(open_weights)])
            takes = [t + min(q, x - t) for t, q, x in zip(takes, quanta, left, strict=True)]
        add(1, rest, [0, *accumulate(takes)])
    return phases


def cut(queue: int, place: int, length: int, phases: list[dict], firsts: list[list[int]], share: tuple[int, int, int] = (0, 1, 1)) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of the tokens place to place + length of a source.

    share tells which part of the queue is the source's own: from, to, and the queue's whole."""
    at, end = place, place + length
    own_lo, own_hi, own_whole = share
    inner = lambda x: x * own_hi // own_whole - x * own_lo // own_whole
    p = bisect.bisect_right(firsts[queue], at, key=inner) - 1
    while at < end:
        phase = phases[p]
        given, size, windows = phase["given"][queue], phase["size"], phase["k1"] - phase["k0"]
        lo, hi, whole = phase["cum"][queue], phase["cum"][queue + 1], phase["cum"][-1]
        reach = lambda k: inner(given + k * size * hi // whole - k * size * lo // whole)  # noqa: B023, E731
        if reach(windows) <= at:
            p += 1
            continue
        # the first window that reaches beyond at: from just before where it should be, in doubling steps, then halving
        low = max(0, (max(0, at - 1) * own_whole // (own_hi - own_lo) - given - 1) * whole // (size * (hi - lo)) - 1)
        while low and reach(low) > at:
            low = max(0, low - 2)
        step = 1
        while reach(min(low + step, windows)) <= at:
            low, step = low + step, 2 * step
        high = min(low + step, windows)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if reach(middle) > at else (middle, high)
        stop = min(end, reach(high))
        before, after = (given + k * size * hi // whole - k * size * lo // whole for k in (low, high))
        # what the queues before this one take in the window, then what the sources before this one take of the queue's part
        offset = high * size * lo // whole - low * size * lo // whole + after * own_lo // own_whole - before * own_lo // own_whole + at - inner(before)
        yield at - place, stop - at, phase["k0"] + low, offset
        at = stop


def _shares(bases: DataFrame, named: list[str]) -> DataFrame:
    """source, queue, lo, hi: the queue of each source, and which part of the queue's tokens is its own."""
    queue = F.coalesce(*[F.when(F.col("source") == s, k) for k, s in enumerate(named)], F.lit(len(named)))
    totals = bases.groupBy("source").agg(F.sum("part_tokens").alias("total")).withColumn("queue", queue)
    alone = totals.where(F.col("queue") < len(named)).select("source", "queue", F.lit(0).cast("long").alias("lo"), F.col("total").alias("hi"))
    common = running_total(totals.where(F.col("queue") == len(named)), "source", "total")
    return alone.unionByName(common.select("source", "queue", F.col("before").alias("lo"), (F.col("before") + F.col("total")).alias("hi")))


def pack(docs: DataFrame, targets: dict[str, float] | None = None, size: int = SIZE, name: str = NAME, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids)."""
    named = sorted(targets or {})
    stored = durable(tokenise(docs, name))
    parts = stored.groupBy("chunk", "source").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = durable(parts.select("chunk", "source", "part_tokens", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base")))
    shares = durable(_shares(bases, named))
    sums = {r["queue"]: r["t"] for r in shares.groupBy("queue").agg(F.sum(F.col("hi") - F.col("lo")).alias("t")).collect()}  # a row for each target
    totals = [sums.get(q, 0) for q in range(len(named) + 1)]
    weights = totals if not named else [round(targets[s] * 10**9) for s in named] + [round(max(0.0, 1 - sum(targets.values())) * 10**9)]
    phases = schedule(totals, weights, size)
    firsts = [[p["given"][q] for p in phases] for q in range(len(totals))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids_out: list[list[int]] = []
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for doc_id, source, queue, lo, hi, place, n, ids in zip(*columns, batch.column(7), strict=True):
                raw = ids.as_buffer()
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                view = memoryview(wide).cast("B")
                for start, length, sequence, offset in cut(queue, place, n, phases, firsts, (lo, hi, totals[queue])):
                    out.append((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, sequence, offset, source))
                    if with_ids:
                        ids_out.append(wide[start : start + length].tolist())
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            arrays = [pa.array(c, pa.int64() if k < 7 else pa.string()) for k, c in enumerate(columns)]
            names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                arrays, names_out = [*arrays, pa.array(ids_out, pa.list_(pa.int64()))], [*names_out, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names_out)

    places = durable(bases.join(shares, "source").select(F.col("chunk").alias("p_chunk"), F.col("source").alias("p_source"), "base", "queue", "lo", "hi"))
    joined = stored.join(places, (F.col("chunk") == F.col("p_chunk")) & (F.col("source") == F.col("p_source")))
    return joined.select("doc_id", "source", "queue", "lo", "hi", (F.col("place") + F.col("base")).alias("place"), "n_tokens", "ids").mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))
