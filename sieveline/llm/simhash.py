"""SimHash near-dedup with a pivot distance table.

Fingerprints: texts are lower-cased (A-Z), cut into words, and shingles of three words are hashed with XXH64 (seed 42); a
bit is set when it is set in over half of the hashes, repeats included. Fewer words: the whole sequence is one shingle;
none: fingerprint zero.

``simhash_groups`` links fingerprints that differ in at most 3 bits. Only distinct fingerprints are compared. A fingerprint is
cut into six blocks; two that differ in 3 bits agree on at least three of them, so rows meet on each of the 20 choices of three
blocks (about 32 bits each) and no pair is lost. Inside a meeting place rows are ordered by their distance to the first of 16
reference fingerprints: a row is only held against those within 3 of it there, pairs whose distances to any reference
differ by more than 3 are discarded (triangle inequality), and the survivors are verified by their differing bits. A
meeting place gives a spanning forest of its links, never all pairs of a group.

``keep_near`` links texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more, all of them, in two
steps. The first joins most texts cheaply: they meet on ``BANDS`` keys of ``ROWS`` least hashes each, the pivot table discards
pairs there whose fingerprints differ in more than ``WIDE`` bits, forests of growing distance stand for large places, and sets
verify the rest. It may miss links (keys that differ, far fingerprints, farther neighbours), so the second step is exact:
similar sets share one of their first shingles, in any order of shingles that all sets keep (a set of n shingles needs
n - 0.8 n + 1 of them, rounded up). Sets that the first step left in different components and that share such a shingle are
verified, unless their sizes, the places of that shingle or the number of first shingles that they share rule the pair out. The order, by counts in ``COUNTERS``
hashed counters of all shingles, only keeps places small. Of two components one pair is tried first, so that those that are
linked need not be held against each other whole; then all pairs are verified that are left between different ones.
Only distinct sets are compared, and each link's sets meet by a salted join, so that a set with many links is not one task.

Places with more than ``PLACE`` rows are dealt out: rows fall into chunks by hash, and each pair of chunks is compared in a
task of its own. That is exact and bounds the memory of a task. Pairs within the largest component of a place are left out.

Defined cases: null text counts as empty; documents without words share fingerprint zero and are linked; null ids never
become a component_id unless all ids of the component are null; repeated rows are linked; ``keep_near`` keeps exactly one row
of each component, the first one stored of those that repeat its smallest id; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import durable, numbered, text_or_empty, unused
from sieveline.llm.components import connected_components
from sieveline.llm.substring_dedup import ROW_BITS, _has, bit_map

SEED, SHINGLE, BITS, PLACE, SMALL = 42, 3, 3, 1024, 8
WORDS, SIMILARITY, BANDS, ROWS, WIDE, FANOUT = 5, 0.8, 12, 4, 24, 64
STEPS = (3, 6, 9, 12, 16, WIDE)
COUNTERS, SLICE, SENT, EPSILON = 1 << 18, 1 << 12, 1 << 20, 1e-6
_WIDTHS = (11, 11, 11, 11, 10, 10)
_EDGES = np.cumsum((0, *_WIDTHS)).tolist()
_BLOCKS = [((1 << w) - 1) << at for w, at in zip(_WIDTHS, _EDGES, strict=False)]
_signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
MASKS = [_signed(a | b | c) for a, b, c in combinations(_BLOCKS, 3)]
#: The reference fingerprints of the pivot table.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {k}", seed=SEED) for k in range(16)], dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (i, j) pass the pivot table and are verified."""
    keep = np.ones(len(i), bool)
    for d in table:
        keep[keep] = np.abs(d[i[keep]] - d[j[keep]]) <= bits
    left = np.flatnonzero(keep)
    return left[np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= bits]


def _forest(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among fp, which is ordered by table[0]."""
    first, second, waiting = [], [], np.arange(len(fp))
    while len(waiting):
        stack, waiting = [waiting[0]], waiting[1:]
        while stack and len(waiting):
            at = stack.pop()
            lo, hi = np.searchsorted(table[0][waiting], (table[0][at] - bits, table[0][at] + bits + 1))
            near = lo + _near(fp, table[1:], np.full(hi - lo, at), waiting[lo:hi], bits)
            found = waiting[near]
            first += [at] * len(found)
            second += found.tolist()
            stack += found.tolist()
            waiting = np.delete(waiting, near)
    return first, second


def _links(fp: np.ndarray, runs: np.ndarray, bits: int, small: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs (small ones too, or large ones only); runs holds the bounds of the runs in fp."""
    table = np.stack([np.bitwise_count(fp ^ p).astype(np.int16) for p in PIVOTS])
    sizes = np.diff(runs)
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    of = np.repeat(np.where(sizes <= SMALL, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    for lag in range(1, SMALL if small else 1):
        i = np.flatnonzero((of[lag:] == of[:-lag]) & (of[lag:] >= 0)) if len(of) > lag else np.empty(0, np.int64)
        kept = _near(fp, table, i, i + lag, bits)
        first.append(i[kept])
        second.append(i[kept] + lag)
    for r in np.flatnonzero(sizes > SMALL):
        a, b = runs[r], runs[r + 1]
        x, y = _forest(fp[a:b], table[:, a:b], bits)
        first.append(np.array(x, np.int64) + a)
        second.append(np.array(y, np.int64) + a)
    return np.concatenate(first), np.concatenate(second)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of long columns, and the bounds of the runs of equal first ``keys`` columns; a run is never cut."""
    held: list[np.ndarray] = []  # the rows of the last, still open run
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        if not len(rows):
            continue
        new = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        done = new[-1] if len(new) else 0
        held = [rows[done:]]
        if done:
            yield rows[:done], np.concatenate([[0], new])
    if held:
        yield held[0], np.array([0, len(held[0])])


def _deal(rows: DataFrame, place: int) -> DataFrame:
    """rows: mask, value, fp and more. Rows of one place, of which large ones are dealt out by pairs of chunks (x, y), in order of
    the distance to the first reference."""
    large = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > place)
    large = durable(large.select(F.col("mask").alias("l_mask"), F.col("value").alias("l_value"), F.ceil(F.col("n") / place).cast("long").alias("chunks")))
    dealt = rows.join(large, (F.col("mask") == F.col("l_mask")) & (F.col("value") == F.col("l_value")), "left")
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("mask", "value")]), F.col("chunks"))
    pairs = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y")))
    )
    to_first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[0].view(np.int64)))))
    more = [c for c in rows.columns if c not in ("mask", "value")]
    dealt = dealt.select("mask", "value", *more, F.explode(pairs).alias("p")).select("mask", "value", F.col("p.x").alias("x"), F.col("p.y").alias("y"), *more)
    return dealt.repartition("mask", "value", "x", "y").sortWithinPartitions("mask", "value", "x", "y", to_first)


def fingerprint_links(distinct: DataFrame, bits: int = BITS, place: int = PLACE) -> DataFrame:
    """Links a, b between the distinct fingerprints fp: enough of them to connect all that are connected."""
    spots = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(MASKS)]))
    rows = distinct.select("fp", spots.alias("spot")).select("spot.mask", "spot.value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, runs in _runs(batches, 4):
            fp = np.ascontiguousarray(found[:, 4])
            i, j = _links(fp.view(np.uint64), runs, bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    return _deal(rows, place).mapInArrow(run, "a long, b long").distinct()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a task holds the sets of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


_SPREAD = np.array([xxhash.xxh64_intdigest(f"least {k}", seed=SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each from ROWS least hashes of the set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _SPREAD).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(29)) ^ part) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def sketches(rows: DataFrame, row: str) -> DataFrame:
    """row, content (which set it is), fp, keys for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            content = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            arrays = [batch.column(0), pa.array(content, pa.binary()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "content", "fp", "keys"])

    return rows.select(F.col(row).alias("row"), text_or_empty().alias("text")).mapInArrow(run, "row long, content binary, fp long, keys array<long>")


def _candidates(distinct: DataFrame, place: int) -> DataFrame:
    """a, b: rows that meet and whose fingerprints are near. All pairs of a small place; of others a forest for each step of
    nearness, so that each row has a link to one of its nearest."""
    rows = distinct.select("fp", "row", F.posexplode("keys").alias("mask", "value")).select(F.col("mask").cast("long").alias("mask"), "value", "fp", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, runs in _runs(batches, 4):
            fp, at = np.ascontiguousarray(found[:, 4]).view(np.uint64), found[:, 5]
            links = [np.stack(_links(fp, runs, bits, small=bits == WIDE)) for bits in STEPS]
            i, j = np.unique(np.concatenate(links, axis=1), axis=1)
            a, b = at[i], at[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _deal(rows, place).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b (and what else they have) whose sets are similar."""
    columns, schema = pairs.columns, pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            keep = []
            for one, other in zip(batch.column(len(columns)), batch.column(len(columns) + 1), strict=True):
                one, other = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(other) - both))
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        # a row with many links has its set copied, one copy for each FANOUT of them
        copies = pairs.groupBy(F.col(end).alias("row")).agg(F.ceil(F.count(F.lit(1)) / FANOUT).cast("int").alias("copies"))
        spread = sets.join(copies, "row").select(F.col("row").alias("s_row"), F.col("copies").alias("of"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("hashes").alias(f"set_{end}"))
        numbered_pairs = pairs.join(copies, F.col(end) == F.col("row")).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("copies")).cast("int")).drop("row", "copies")
        pairs = numbered_pairs.join(spread.drop("of"), (F.col(end) == F.col("s_row")) & (F.col("salt") == F.col("copy"))).drop("salt", "s_row", "copy")
    return pairs.select(*columns, "set_a", "set_b").mapInArrow(run, schema)


def _sets(rows: DataFrame, row: str, pairs: DataFrame) -> DataFrame:
    """row, hashes of the rows in pairs, and of a few others that share a bit with them; only sets travel, no texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    wanted = bit_map(ends, F.xxhash64("end"), ROW_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_has(wanted, np.asarray(batch.column(1)).view(np.uint64))))
            for part in _parts([some]):
                sets = [shingle_set(t.as_py()).tobytes() for t in part.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["row", "hashes"])

    return durable(rows.select(F.col(row).alias("row"), F.xxhash64(row).alias("mark"), text_or_empty().alias("text")).mapInArrow(run, "row long, hashes binary"))


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each hashed counter: 8 * COUNTERS bytes come to the driver, whatever the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                np.add.at(counts, _counters(shingle_set(text.as_py())), 1)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTERS // SLICE), pa.int64()), pa.array([part.tobytes() for part in counts.reshape(-1, SLICE)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(part.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([part.tobytes() for part in sums.values()], pa.binary())], names=["slice", "counts"])

    found = np.zeros((COUNTERS // SLICE, SLICE), np.int64)
    counted = rows.select(text_or_empty().alias("text")).mapInArrow(count, "slice long, counts binary").repartition("slice")
    for r in counted.mapInArrow(add, "slice long, counts binary").toLocalIterator():
        found[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return found.ravel()


def first_shingles(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, of which two similar sets share one: fewer shingles are left than a similar set has in common."""
    take = len(hashes) - math.ceil(similarity * len(hashes) - EPSILON) + 1
    return hashes[np.argsort(counts[_counters(hashes)], kind="stable")[:take]]


def _shared(rows: DataFrame, row: str, similarity: float) -> DataFrame:
    """token, row, size, at: first shingles that more rows have, the size of the row's set and the shingle's place in its order."""
    counts = shingle_counts(rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 128):
            sets = [shingle_set(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            first = [first_shingles(s, counts, similarity) for s in sets]
            lengths = [len(f) for f in first]
            spots = [(len(s) << 32) + np.arange(n) for s, n in zip(sets, lengths, strict=True)]
            arrays = [np.concatenate(first).view(np.int64), np.repeat(np.asarray(batch.column(0)), lengths), np.concatenate(spots)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["token", "row", "spot"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, runs in _runs(batches, 1):
            sizes = np.diff(runs)
            token, row_of, spot = found[np.repeat(sizes > 1, sizes)].T
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (token, row_of, spot >> 32, spot & 0xFFFFFFFF)], names=["token", "row", "size", "at"])

    indexed = rows.select(F.col(row).alias("row"), text_or_empty().alias("text")).mapInArrow(index, "token long, row long, spot long")
    return indexed.repartition("token").sortWithinPartitions("token").mapInArrow(meet, "token long, row long, size long, at long")


def _crossing(root: np.ndarray, size: np.ndarray, at: np.ndarray, runs: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside runs, which are ordered by size, of unlike roots, unless sizes rule them out or, were this their first common shingle, what stands behind it."""
    sizes = np.diff(runs)
    of = np.repeat(np.arange(len(sizes)), sizes)
    i = np.arange(len(of))
    for lag in range(1, sizes.max()):
        i = i[i < len(of) - lag]
        i = i[(of[i] == of[i + lag]) & (size[i] >= similarity * size[i + lag] - EPSILON)]
        j = i + lag
        most = np.minimum(size[i] - at[i], size[j] - at[j])
        may = (root[i] != root[j]) & (most * (1 + similarity) >= similarity * (size[i] + size[j]) - EPSILON)
        if may.any():
            yield i[may], j[may]


def _left_over(shared: DataFrame, rooted: DataFrame, similarity: float, place: int) -> DataFrame:
    """a, b, root_a, root_b, together: pairs of rows of unlike roots that may be similar, and how many first shingles they share.

    Of two sets, the one whose first shingles end earlier in the order has its other shingles in common at most, and those
    first ones that both have."""
    named = durable(shared.join(rooted.select(F.col("row").alias("r_row"), "root"), F.col("row") == F.col("r_row")).drop("r_row"))
    each = named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    places = each.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", "n").alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    chunks = lambda n: F.ceil(n / place).cast("long")
    places = durable(places.select(F.col("token").alias("p_token"), "main", (F.col("n") <= place).alias("whole"), chunks(F.col("most")).alias("inner"), chunks(F.col("n") - F.col("most")).alias("outer")))
    zero, of_main = F.lit(0).cast("long"), F.col("root") == F.col("main")
    # rows of the place's largest root meet the others only
    own = F.when(F.col("whole"), zero).when(of_main, F.col("outer") + F.pmod(F.xxhash64("row"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("row"), F.col("outer")))
    last = F.when(F.col("whole"), zero).when(of_main, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    pairs = F.transform(F.sequence(zero, last), lambda k: F.struct(F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y")))
    dealt = named.join(places, F.col("token") == F.col("p_token")).withColumn("own", own).select("token", F.explode(pairs).alias("p"), "row", "root", "size", "at")
    dealt = dealt.select("token", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "row", "root", "size", "at").repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, runs in _runs(batches, 3):
            row, root, size, at = np.ascontiguousarray(found[:, 3:].T)
            held, many = [], 0
            for i, j in _crossing(root, size, at, runs, similarity):
                a, b = np.where(row[i] < row[j], (i, j), (j, i))
                held.append(np.stack([row[a], row[b], root[a], root[b], size[a], size[b]]))
                many += len(i)
                if many > SENT:
                    yield send(held)
                    held, many = [], 0
            if held:
                yield send(held)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held, axis=1)], names=columns)

    columns = ["a", "b", "root_a", "root_b", "size_a", "size_b"]
    met = durable(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in columns)).distinct())
    first = durable(named.groupBy("row").agg(F.collect_list("token").alias("tokens")))
    for end in ("a", "b"):  # a pair stays one row, however many first shingles it shares
        met = met.join(first.select(F.col("row").alias(f"{end}_row"), F.col("tokens").alias(f"{end}_tokens")), F.col(end) == F.col(f"{end}_row")).drop(f"{end}_row")
    met = met.select(*columns, F.size(F.array_intersect("a_tokens", "b_tokens")).alias("together"))
    others = F.ceil(similarity * F.greatest("size_a", "size_b") - EPSILON) - 1
    both = F.col("together") + others
    return met.where(both * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")) - EPSILON).drop("size_a", "size_b")


def _joined(rooted: DataFrame, links: DataFrame, columns: tuple[str, ...] = ("root",)) -> DataFrame:
    """rooted with the roots in columns replaced by the least of those that links connect."""
    labels = connected_components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    for c in columns:
        new = labels.select(F.col("node").alias("l_node"), F.col("root").alias("l_root"))
        rooted = rooted.join(new, F.col(c) == F.col("l_node"), "left").withColumn(c, F.coalesce("l_root", c)).drop("l_node", "l_root")
    return rooted


def _completed(rows: DataFrame, row: str, rooted: DataFrame, similarity: float, place: int) -> DataFrame:
    """rooted (a row for each distinct set) with the roots joined that similar sets link."""
    pairs = durable(_left_over(durable(_shared(rows, row, similarity)), rooted, similarity, place))
    sets = _sets(rows, row, pairs)
    best = pairs.groupBy(F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")).agg(F.max_by(F.struct("a", "b", "root_a", "root_b"), "together").alias("one")).select("one.*")
    best = durable(best)
    links = durable(_verified(best, sets, similarity))
    rest = pairs.select("a", "b", "root_a", "root_b").join(best.select("a", "b"), ["a", "b"], "left_anti")
    apart = _joined(rest.withColumns({"now_a": F.col("root_a"), "now_b": F.col("root_b")}), links, ("now_a", "now_b")).where("now_a <> now_b").select(best.columns)
    return _joined(rooted, links.unionAll(_verified(durable(apart), sets, similarity)))


def _labelled(rows: DataFrame, first: Column, bits: int, place: int) -> DataFrame:
    """rows and least, the smallest value of first in the component of each."""
    distinct = rows.groupBy("fp").agg(F.min(first).alias("first"))
    labels = connected_components(fingerprint_links(distinct.select("fp"), bits, place))
    grouped = durable(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    named = grouped.join(least, "root").select(F.col("fp").alias("g_fp"), "least")
    return rows.join(named, F.col("fp") == F.col("g_fp"), "left").drop("g_fp")


def simhash_groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, place: int = PLACE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    found = _labelled(durable(fingerprints(docs, shingle)), F.col("doc_id"), bits, place)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def near_groups(rows: DataFrame, row: str, similarity: float = SIMILARITY, place: int = PLACE) -> DataFrame:
    """row, root: the component of each row of a stored table, by the least row of its sets."""
    marked = durable(sketches(rows, row))
    distinct = durable(marked.groupBy("content").agg(F.min_by(F.struct("row", "fp", "keys"), "row").alias("one")).select("content", "one.row", "one.fp", "one.keys"))
    pairs = durable(_candidates(distinct, place))
    labels = connected_components(_verified(pairs, _sets(rows, row, pairs), similarity))
    rooted = durable(distinct.select("content", "row").join(labels, F.col("row") == F.col("node"), "left").select("content", "row", F.coalesce("root", "row").alias("root")))
    rooted = _completed(rows, row, rooted, similarity, place).select(F.col("content").alias("d_content"), "root")
    return marked.select("row", "content").join(rooted, F.col("content") == F.col("d_content")).select("row", "root")


def keep_near(docs: DataFrame, similarity: float = SIMILARITY, place: int = PLACE) -> DataFrame:
    """The rows of docs that stay, the one with the smallest id of each component, with all their columns."""
    row, stay = unused(docs, "__row"), unused(docs, "__stay")
    rows = numbered(docs, row)
    grouped = near_groups(rows, row, similarity, place)
    named = grouped.join(rows.select(F.col(row).alias("n_row"), F.col("doc_id").cast("long").alias("doc_id")), F.col("row") == F.col("n_row"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(stay)), F.col(row) == F.col(stay), "left_semi").drop(row)
