"""Exact top-k inner-product search with a pivot-distance index.

Vectors become integers, floor(256 x), and are lifted by one coordinate, sqrt(M^2 - |v|^2) with M the largest norm: then the
nearest neighbours of a lifted query (0 in the new coordinate) are those of largest inner product, and distances obey the
triangle inequality. The index keys every vector by its nearest pivot and its distance to it. Each pivot's distances are cut
into annuli, and each annulus into blocks of about ``BLOCK`` vectors stored as one matrix row.

A query first searches the annulus where its lower bound | d(q, p) - d(v, p) | is least (several, until they hold k vectors
for sure); its k-th best score there is a radius. Then the annuli of every pivot are taken whose bound is below the radius,
all others cannot hold a better vector and are left out. The result is exact.

What the driver and the tasks hold in common is bounded: at most ``PIVOTS`` pivots, fitted on at most ``SAMPLE`` vectors, and
``PIVOTS * RINGS`` annuli with their bounds; small tables have fewer, so that a query isn't sent to annuli of a few vectors. Queries, vectors and scores stay distributed; a pivot or an annulus with a third
of all vectors only has more blocks.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths count as padded with zeros; only the query's own row is no candidate of it, so rows that repeat its id are,
and each row of a repeated query id is a query with ranks of its own; equal rows are candidates each; ties go to the smaller id; an empty table gives an empty result; other columns are ignored. Scores are
exact where the sum of the squared components is below 2^53; beyond, they are computed with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import durable

K, EVERY, PIVOTS, RINGS, BLOCK, SAMPLE, QUERY_BLOCK, LANES = 5, 50, 64, 16, 4096, 8192, 256, 64
EXACT = float(2**53)


def integers(vector: Column) -> Column:
    """floor(256 x) of each component, as doubles (whole numbers); null where the vector takes no part."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of one batch as rows, padded with zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.empty(0, int)]).astype(int)] = np.asarray(lists.flatten())
    return out


def fit_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice, then a few rounds of means; deterministic."""
    if not len(vectors):
        return vectors
    chosen = [0]
    near = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(vectors)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    pivots = vectors[chosen].copy()
    for _ in range(4):
        own = _squared(vectors, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            if (own == p).any():
                pivots[p] = vectors[own == p].mean(axis=0)
    return pivots


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _lift(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors * vectors).sum(axis=1), 0))])


def _scores(queries: np.ndarray, vectors: np.ndarray, top: float) -> np.ndarray:
    if top < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(vectors).T, -(2**63), 2**63 - 1).astype(np.int64)


def search(table: DataFrame, k: int = K, every: int = EVERY, pivots: int | None = None, rings: int | None = None, block: int = BLOCK) -> DataFrame:
    """The k best of every query row (ids divisible by ``every``): query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = durable(table.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("uid", F.monotonically_increasing_id()))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.max(norm).alias("top"), F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], result)
    top, width, n = facts["top"], max(1, facts["width"]), facts["n"]
    pivots = pivots or max(1, min(PIVOTS, int(n**0.5 / 10)))
    rings = rings or max(1, min(RINGS, 4 * n // (pivots * block)))
    # whole numbers up to 2^24 are the same in 32 bits
    packed = np.dtype("<f4" if (facts["largest"] or 0) <= 2**24 else "<f8")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    centres = fit_pivots(_lift(_matrix(sample, width), top), pivots)

    def unpack(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), packed).reshape(len(column), width).astype(float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), width)
            far = _squared(_lift(vectors, top), centres)
            own = far.argmin(axis=1)
            raw = pa.array([r.tobytes() for r in vectors.astype(packed)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array(own, pa.int32()), pa.array(np.sqrt(far[np.arange(len(own)), own]))], names=["uid", "vec_id", "v", "pivot", "distance"])

    placed = durable(rows.select("uid", "vec_id", "v").mapInArrow(place, "uid long, vec_id long, v binary, pivot int, distance double"))
    cuts = placed.groupBy("pivot").agg(F.percentile_approx("distance", [r / rings for r in range(1, rings)] or [1.0], 1000).alias("cuts"))
    cuts = F.broadcast(cuts.withColumnRenamed("pivot", "c_pivot"))  # a row for each pivot
    ringed = placed.join(cuts, F.col("pivot") == F.col("c_pivot")).select("uid", "vec_id", "v", "pivot", "distance", F.size(F.filter("cuts", lambda c: c < F.col("distance"))).alias("ring"))
    shells = {(r["pivot"], r["ring"]): r for r in ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect()}  # at most PIVOTS * RINGS
    order = sorted(shells)
    pivot_of, lows, highs, sizes = (np.array([shells[s][name] for s in order]) for name in ("pivot", "lo", "hi", "n"))
    parts = {s: max(1, -(-shells[s]["n"] // block)) for s in order}
    part_of = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s[0] * rings + s[1]), F.lit(parts[s]))])
    key = F.col("pivot") * rings + F.col("ring")
    shell_of = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s[0] * rings + s[1]), F.lit(i))])
    index = durable(ringed.select(shell_of[key].alias("shell"), F.pmod(F.xxhash64("uid"), part_of[key]).cast("int").alias("part"), "distance", "uid", "vec_id", "v").groupBy("shell", "part").agg(F.array_sort(F.collect_list(F.struct("distance", "uid", "vec_id", "v"))).alias("members")))
    slack = 1e-6 * (1 + np.sqrt(top))

    def bounds(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of lifted queries to the pivots, and the least distance to each shell."""
        far = np.sqrt(_squared(np.column_stack([queries, np.zeros(len(queries))]), centres))
        at = far[:, pivot_of]
        return far, np.maximum(np.maximum(at - highs, lows - at), 0)

    asked = placed.where(F.col("vec_id") % every == 0).select("uid", "vec_id", F.col("v").alias("q"))

    def first_shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expands the annuli by their bound until those before the last hold k candidates for sure."""
        for batch in batches:
            _, least = bounds(unpack(batch.column(1)))
            yield _dealt(batch, [_enough(row, sizes, k + 1) for row in least], None)

    def later_shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The annuli within the radius that the first search left."""
        for batch in batches:
            queries = unpack(batch.column(1))
            _, least = bounds(queries)
            kth = np.array([-np.inf if s is None else s for s in batch.column(2).to_pylist()])
            squared = (queries * queries).sum(axis=1) + top - 2 * kth
            radius = np.sqrt(np.maximum(squared, 0)) + slack
            chosen = [np.setdiff1d(np.flatnonzero(row <= r), _enough(row, sizes, k + 1)) for row, r in zip(least, radius, strict=True)]
            yield _dealt(batch, chosen, radius)

    def match(dealt: DataFrame) -> DataFrame:
        """Query blocks meet vector blocks on the shell and part; each pair of blocks gives each query's k best in it."""
        spread = dealt.select("uid", "q", "radius", "shell", F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(parts[s] - 1) for s in order]), F.col("shell") + 1))).alias("part"))
        packs = spread.withColumn("pack", F.pmod(F.xxhash64("uid"), F.lit(n // every // QUERY_BLOCK + 1))).groupBy("shell", "part", "pack").agg(F.collect_list(F.struct("uid", "q", "radius")).alias("queries"))
        pairs = packs.join(index, ["shell", "part"]).select("shell", "queries", "members")
        found = pairs.mapInArrow(compare, "uid long, lane int, vec_id long, score long")
        best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
        # in two steps, so that no list grows with the number of blocks
        return _best(found.groupBy("uid", "lane").agg(F.slice(best, 1, k).alias("best")), k)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for i in range(batch.num_rows):
                shell = batch.column(0)[i].as_py()
                asked_for, members = batch.column(1)[i].values, batch.column(2)[i].values
                queries, vectors = unpack(asked_for.field("q")), unpack(members.field("v"))
                ids, uids, query_uids = (np.asarray(a) for a in (members.field("vec_id"), members.field("uid"), asked_for.field("uid")))
                scores = _scores(queries, vectors, top)
                far, _ = bounds(queries)
                distance = np.asarray(members.field("distance"))
                for j, q in enumerate(query_uids):
                    radius = asked_for.field("radius")[j].as_py()
                    lo, hi = 0, len(ids)
                    if radius is not None:  # only the annulus within the radius can hold better ones
                        at = far[j, pivot_of[shell]]
                        lo, hi = np.searchsorted(distance, (at - radius, at + radius + slack))
                    own, their = scores[j, lo:hi], ids[lo:hi]
                    keep = uids[lo:hi] != q
                    own, their = own[keep], their[keep]
                    if len(own) > k:  # all that tie with the k-th stay until ids decide
                        high = np.partition(own, len(own) - k)[len(own) - k]
                        own, their = own[own >= high], their[own >= high]
                    take = np.lexsort((their, -own))[:k]
                    out[0].extend([int(q)] * len(take))
                    out[1].extend([int(uids[0]) % LANES] * len(take))
                    out[2].extend(their[take].tolist())
                    out[3].extend(own[take].tolist())
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["uid", "lane", "vec_id", "score"])

    dealt_schema = "uid long, q binary, shell int, radius double"
    first = durable(match(asked.select("uid", "q").mapInArrow(first_shells, dealt_schema)))
    known = first.select(F.col("uid").alias("f_uid"), F.when(F.size("best") == k, -F.element_at("best", k)["minus"]).alias("kth"))
    again = asked.join(known, F.col("uid") == F.col("f_uid"), "left").select("uid", "q", "kth")
    second = match(again.mapInArrow(later_shells, dealt_schema))
    merged = _best(first.unionAll(second), k).join(asked.select(F.col("uid").alias("a_uid"), F.col("vec_id").alias("query_id")), F.col("uid") == F.col("a_uid"))
    ranked = merged.select("query_id", F.posexplode("best").alias("p", "b"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


def _best(lists: DataFrame, k: int) -> DataFrame:
    """uid, best: the k best of a query's lists of at most k."""
    return lists.groupBy("uid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _enough(least: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """The nearest shells by their bound, up to the one with which they hold ``wanted`` vectors."""
    order = np.argsort(least, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1]


def _dealt(batch: pa.RecordBatch, chosen: list[np.ndarray], radius: np.ndarray | None) -> pa.RecordBatch:
    """A row for each query and chosen shell."""
    take = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
    shells = np.concatenate([np.asarray(c, np.int64) for c in chosen] or [np.empty(0, np.int64)])
    far = pa.nulls(len(take), pa.float64()) if radius is None else pa.array(radius[take])
    index = pa.array(take, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(shells, pa.int32()), far], names=["uid", "q", "shell", "radius"])


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.u <> q.u)
SELECT query_id, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
