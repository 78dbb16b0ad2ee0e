"""Product codes for vectors: four codebooks fitted by Lloyd's rounds, assigned exactly with an integer Walsh-Hadamard transform.

Components become integers, floor(1024 x), and vectors are cut into ``PARTS`` consecutive parts. The nearest entry of a part's
codebook is searched in the transform's domain: parts and entries are padded with zeros to a power of two, n, and multiplied by
the Hadamard matrix, which multiplies squared distances by n. Squared differences are added in sequency order (rows by their
number of sign changes, where slowly changing vectors have most of their energy). What is summed so far is a lower bound of n times the
distance, so an entry is eliminated as soon as its sum is above that of an entry known in full: first the one that leads after
``HEAD`` coefficients, later the best so far. Entries that tie stay, and the lower index wins. Everything is integer arithmetic: in 64 bits
where n^3 times the squared largest component fits, with Python's integers beyond.

A round maps the stored rows against the codebooks, which are shipped to tasks (PARTS * ENTRIES * part width numbers, whatever
the number of rows), adds each task's parts per entry, and sums over tasks: PARTS * ENTRIES rows a task. Only the new codebooks come
to the driver. Errors are summed per label on the map side; labels with many rows are looked up in a bounded broadcast table.

Defined cases: vectors that are null or hold null or non-finite components are dropped. A null vec_id keeps its row, which never starts a codebook before
one with an id does; repeated rows are rows of their own, and rows of one id start codebooks in the order of their components. Vectors whose length
PARTS doesn't divide, and those shorter than the longest, are padded with zeros at the end. Fewer than ENTRIES rows give as
many entries. Empty vectors have codes of zeros. Null labels are one label. An empty table gives an empty result; other columns are ignored. A component or
an error sum that 64 bits can't hold stops the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import durable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Coefficients that all entries are compared on before any is eliminated; rows that are compared at once.
HEAD, BLOCK = 4, 512
HOT_LABELS, SMALL_LABEL = 1000, 64


def hadamard(n: int) -> np.ndarray:
    """The matrix of order n (a power of two), its rows in sequency order."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < n:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")]


class Transform:
    """Parts of ``width`` components in the transform's domain; whole: 64-bit arithmetic can't overflow."""

    def __init__(self, width: int, largest: int):
        self.n = 1 << max(0, width - 1).bit_length()
        self.width = width
        self.kind = np.int64 if 4 * self.n**3 * max(1, largest) ** 2 < 2**63 else object
        self.matrix = hadamard(self.n)[:, :width].astype(self.kind)

    def __call__(self, parts: np.ndarray) -> np.ndarray:
        return parts.astype(self.kind) @ self.matrix.T

    def nearest(self, parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry; entries are transformed already."""
        found, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), self.kind)
        for at in range(0, len(parts), BLOCK):
            found[at : at + BLOCK], far[at : at + BLOCK] = self._nearest(self(parts[at : at + BLOCK]), entries)
        return found, far

    def _nearest(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((len(x), len(entries)), self.kind)
        head = min(HEAD, self.n)
        for c in range(head):
            sums += (x[:, c, None] - entries[None, :, c]) ** 2
        lead = sums.argmin(axis=1)
        bound = ((x - entries[lead]) ** 2).sum(axis=1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left = sums[row, entry]
        for c in range(head, self.n):
            left = left + (x[row, c] - entries[entry, c]) ** 2
            stay = left <= bound[row]
            if not stay.all():
                row, entry, left = row[stay], entry[stay], left[stay]
        # the leading entry is never eliminated, so each row has one; rows are in order, entries too
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(left, starts)
        ties = np.flatnonzero(left == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        first = ties[np.r_[True, row[ties][1:] != row[ties][:-1]]]
        return entry[first], least // self.n


def integers(vector: Column) -> Column:
    """floor(1024 x) of each component; null where the vector is dropped."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        scaled = F.lit(float(SCALE)) * x.cast("double")
        return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))

    return F.when(usable, F.transform(vector, whole))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of one batch as rows, padded with zeros."""
    sizes, out = np.diff(np.asarray(lists.offsets)), np.zeros((len(lists), width), np.int64)
    flat = np.asarray(lists.flatten())
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def fit(rows: DataFrame, width: int, largest: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as an array (part, entry, position); rows has vec_id and v."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    books = _matrix(first, parts * width).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    transform = Transform(width, largest)
    for _ in range(rounds):
        coded = [transform(book) for book in books]

        def add(batches: Iterator[pa.RecordBatch], books=books, coded=coded) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                vectors = _matrix(batch.column(0), parts * width).reshape(-1, parts, width)
                for p in range(parts):
                    found, _ = transform.nearest(vectors[:, p], coded[p])
                    counts[p] += np.bincount(found, minlength=books.shape[1])
                    np.add.at(sums[p], found, vectors[:, p])
            p, e = np.nonzero(counts)
            lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, sums[p, e].reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists], names=["part", "entry", "n", "s"])

        added = rows.select("v").mapInArrow(add, "part int, entry int, n long, s array<long>")
        summed = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width)])
        books = books.copy()
        for r in summed.collect():  # parts * entries at most
            books[r[0], r[1]] = [x // r[2] for x in r[3:]]
    return books


def book_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that isn't dropped."""
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows = durable(table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", integers(F.col("embedding")).alias("v")).where("v IS NOT NULL"))
    facts = rows.agg(F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if facts["size"] is None:
        return table.sparkSession.createDataFrame([], schema)
    width, largest = max(1, -(-facts["size"] // parts)), facts["largest"] or 0
    books = fit(rows, width, largest, parts, entries, rounds)
    transform = Transform(width, largest)
    coded = [transform(book) for book in books]
    kind = dict(rows.dtypes)["label"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), parts * width).reshape(-1, parts, width)
            found, far = zip(*(transform.nearest(vectors[:, p], coded[p]) for p in range(parts)), strict=True)
            codes = ["".join(f"{e:02x}" for e in own) for own in zip(*(f.tolist() for f in found), strict=True)]
            error = [sum(own) for own in zip(*(f.tolist() for f in far), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    done = durable(rows.select("vec_id", "label", "v").mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"))
    sums = done.groupBy(F.col("label").alias("l_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = durable(sums)
    hot, same = F.col("n") > max(SMALL_LABEL, done.count() // HOT_LABELS), F.col("label").eqNullSafe(F.col("l_label"))
    large = F.broadcast(sums.where(hot))  # HOT_LABELS rows at most
    joined = done.join(large, same).unionByName(done.join(large, same, "left_anti").join(sums.where(~hot), same))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_hash(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing all entries, for vectors of one length that the number of parts divides."""
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    nearest = lambda book: f"SELECT u, part, x, min((d, entry))[2] AS entry, min(d) AS d FROM (SELECT p.u, p.part, p.x, b.entry, {distance} AS d FROM p JOIN {book} b ON b.part = p.part) GROUP BY ALL"
    steps = []
    for k in range(rounds):
        mean = "list((s - ((s % n) + n) % n) // n ORDER BY k)"
        steps.append(f"""a{k} AS MATERIALIZED ({nearest(f"b{k}")}),
m{k} AS (SELECT part, entry, {mean} AS x FROM (SELECT part, entry, k, sum(x[k])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS k FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)""")
    joined = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT u, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) r(part)),
f AS (SELECT u, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM v QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT part, entry, x FROM f JOIN p USING (u)),
{joined},
z AS MATERIALIZED ({nearest(f"b{rounds}")}),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT u, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY u)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (u), h
"""
