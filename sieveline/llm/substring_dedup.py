"""Substring dedup: windows of ``WINDOW`` words that also start earlier lose their words.

Every window of a text is dealt by its minimizer, the least hash of its groups of ``GRAM`` words, so equal windows always
meet. Neighbouring windows with one minimizer travel together as a segment. Pass 1 counts minimizers; those met once cannot
be in a repeated window. Pass 2 cuts the segments of the others; copies of a segment are gathered within each task, so a
passage that a third of all rows share leaves a task as one row; copies are told by a 128-bit hash and compared byte by byte.
Shards of segments then get a compressed FM-index each (Burrows-Wheeler transform in a wavelet matrix, one place of the suffix
array in eight): backward search streams every window of the shard's repeated segments against it, matching statistics
below the threshold end a search early, and for the rest the suffixes found give the earliest place. Those places go back to the occurrences, and a last pass cuts the texts.

What is common to tasks is bounded: bit maps of ``KEY_BITS`` and ``ROW_BITS`` bits. They only save work, as bits shared by
chance let a segment or text through that needn't be; results stay exact. Minimizers met more than ``HOT`` times are dealt
window by window instead, by the window's own hash, so no shard gathers all contexts of a common phrase.

Defined cases: null text has no words; rows of one id are one document whose windows start at the same places (an equal
place is no earlier one); a null id comes after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import durable, text_or_empty
from sieveline.llm.fm_index import FMIndex

WINDOW, GRAM, HOT, SHARD, GATHERED = 20, 6, 4096, 1 << 17, 50_000
KEY_BITS, HOT_BITS, ROW_BITS = 1 << 26, 1 << 20, 1 << 23
LAST = 2**63 - 1
_PLACES = np.uint64((1 << 20) - 1)
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MORE + b
    return (x ^ (x >> np.uint64(29))) * _ODD


def _minimizers(words: list[bytes]) -> np.ndarray:
    """For each window the least hash of its groups of GRAM words; the low bits tell where that group starts, the first of equals."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    two = _mix(hashes[:-1], hashes[1:])
    four = _mix(two[:-2], two[2:])
    least = _mix(four[:-2], two[4:])
    least = (least & ~_PLACES) | np.arange(len(least), dtype=np.uint64)
    span, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= span:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    rest = span - reach
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def segments(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each run of windows whose minimizer stands at one place.

    Equal windows hold it at the same place of theirs, so no window comes twice in one segment."""
    parts = []
    for at in range(0, len(words) - WINDOW + 1, int(_PLACES) // 2):
        least = _minimizers(words[at : at + int(_PLACES) // 2 + WINDOW - 1])
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        parts.append((least[begin] & ~_PLACES, begin + at, np.diff(np.append(begin, len(least)))))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def count_keys(docs: DataFrame) -> DataFrame:
    """key, n: how many segments have a minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(t.split())[0] for t in batch.column(0).cast(pa.binary()).to_pylist()]
            keys, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def bit_map(rows: DataFrame, key: Column, bits: int) -> np.ndarray:
    """Which remainders of the key there are, as packed bits: at most bits / 8 bytes come to the driver."""
    spots = rows.select((F.pmod(F.shiftrightunsigned(key, 20), F.lit(bits)) + 1).alias("spot")).select(F.bitmap_bucket_number("spot").alias("bucket"), F.bitmap_bit_position("spot").alias("bit"))
    found = np.zeros(bits // 8, np.uint8)
    for r in spots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(r["map"], np.uint8)[: len(found) - at]
        found[at : at + len(part)] = part
    return found


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set; the keys' high bits are the ones that vary."""
    spot = ((keys >> np.uint64(20)) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def _rows(docs: DataFrame) -> DataFrame:
    """did (ids in order, null last) and mark (hash of the text) tell rows apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text_or_empty()).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


CUT = "key long, sid binary, did long, mark long, start int, windows int, content string, copies int"


def cut_segments(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """The occurrences of segments (without content), and for each task and segment its content with its first place (mark null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(key, sid, did, None, start, windows, content.decode(), copies) for sid, (key, did, start, windows, content, copies) in gathered.items()]
            gathered.clear()
            return _cut_batch(rows)

        for batch in batches:
            rows = []
            for did, mark, text in zip(*[batch.column(k).to_pylist() for k in (0, 1)], batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split()
                keys, starts, windows = segments(words)
                keep = _has(repeated, keys)
                is_hot = _has(hot, keys[keep])
                for key, start, n, single in zip(keys[keep].view(np.int64).tolist(), starts[keep].tolist(), windows[keep].tolist(), is_hot.tolist(), strict=True):
                    for a, m in ((start + j, 1) for j in range(n)) if single else ((start, n),):
                        content = b" ".join(words[a : a + m + WINDOW - 1])
                        sid = xxhash.xxh3_128_digest(content)
                        if single:
                            key = int.from_bytes(sid[:8], "little", signed=True)
                        rows.append((key, sid, did, mark, a, m, None, None))
                        known = gathered.get(sid)
                        if known is None:
                            gathered[sid] = [key, did, a, m, content, 1]
                            continue
                        _same(known[4], content)
                        known[5] += 1
                        if (did, a) < (known[1], known[2]):
                            known[1:3] = did, a
                if len(rows) > GATHERED:
                    yield _cut_batch(rows)
                    rows = []
                if len(gathered) > GATHERED:
                    yield flush()
            yield _cut_batch(rows)
        yield flush()

    return _rows(docs).mapInArrow(run, CUT)


def _same(one: bytes, other: bytes) -> None:
    if one != other:
        raise ValueError("two passages share a 128-bit hash")


_CUT_TYPES = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32())


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT_TYPES, strict=True)], names=["key", "sid", "did", "mark", "start", "windows", "content", "copies"])


def _search_shard(shard: dict[bytes, list]) -> list[tuple]:
    """sid, first place of the segment, and for segments with windows that start earlier elsewhere those windows' places."""
    by_key: dict[int, int] = {}
    for key, *_ in shard.values():
        by_key[key] = by_key.get(key, 0) + 1
    # a segment of one place that shares its minimizer with no other has no window that comes twice
    out = [(sid, did, start, None, None) for sid, (key, did, start, _, _, copies) in shard.items() if by_key[key] == copies == 1]
    several = sorted(((did, start, sid, windows, content) for sid, (key, did, start, windows, content, copies) in shard.items() if by_key[key] > 1 or copies > 1))
    if not several:
        return out
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    begins = []
    for *_, content in several:
        begins.append(len(symbols))
        symbols += [number.setdefault(w, len(number) + 1) for w in content.split(b" ")]
        symbols.append(0)
    text = np.array(symbols, np.int64)
    index = FMIndex(text, len(number) + 1)
    counts = np.array([s[3] for s in several])
    begins = np.array(begins)
    own = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    reached, low, high = index.statistics(text, own + WINDOW - 1, WINDOW)
    first = own.copy()
    whole = reached == WINDOW
    first[whole] = index.first_places(low[whole], high[whole])
    segment = np.searchsorted(begins, first, side="right") - 1
    dids, starts = np.array([s[0] for s in several]), np.array([s[1] for s in several])
    first_did, first_start = dids[segment], starts[segment] + first - begins[segment]
    at = 0
    for (did, start, sid, windows, _), begin in zip(several, begins, strict=True):
        span = slice(at, at + windows)
        if (first[span] == np.arange(begin, begin + windows)).all():
            out.append((sid, did, start, None, None))
        else:
            out.append((sid, did, start, first_did[span].tolist(), first_start[span].tolist()))
        at += windows
    return out


def first_places(contents: DataFrame) -> DataFrame:
    """f_sid, f_did, f_start, e_did, e_start: where each segment, and where it differs each of its windows, starts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[bytes, list] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*_search_shard(shard), strict=True)) if shard else [()] * 5
            shard.clear()
            types = (pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["f_sid", "f_did", "f_start", "e_did", "e_start"])

        for batch in batches:
            for key, sid, did, start, windows, content, copies in zip(*[batch.column(k).to_pylist() for k in range(5)], batch.column(5).cast(pa.binary()).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if key != last and size > SHARD:
                    yield flush()
                    size = 0
                last = key
                known = shard.get(sid)
                if known is None:
                    shard[sid] = [key, did, start, windows, content, copies]
                    size += windows + WINDOW
                    continue
                _same(known[4], content)
                known[5] += copies
                if (did, start) < (known[1], known[2]):
                    known[1:3] = did, start
        yield flush()

    dealt = contents.select("key", "sid", "did", "start", "windows", "content", "copies").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "f_sid binary, f_did long, f_start int, e_did array<long>, e_start array<int>")


def removed_windows(docs: DataFrame) -> DataFrame:
    """did, mark, removed: for each row the starts of its windows whose words also start earlier."""
    counted = durable(count_keys(docs).where("n > 1"))
    repeated, hot = bit_map(counted, F.col("key"), KEY_BITS), bit_map(counted.where(F.col("n") > HOT), F.col("key"), HOT_BITS)
    cut = durable(cut_segments(docs, repeated, hot))
    places = first_places(cut.where("mark IS NULL"))
    seen = cut.where("mark IS NOT NULL").select("sid", "did", "mark", "start", "windows")
    joined = seen.join(places, F.col("sid") == F.col("f_sid"))
    whole = (F.col("f_did") < F.col("did")) | ((F.col("f_did") == F.col("did")) & (F.col("f_start") < F.col("start")))
    each = F.sequence(F.col("start"), F.col("start") + F.col("windows") - 1)
    earlier = F.filter(each, lambda s: (F.get("e_did", s - F.col("start")) < F.col("did")) | ((F.get("e_did", s - F.col("start")) == F.col("did")) & (F.get("e_start", s - F.col("start")) < s)))
    removed = F.when(F.col("e_did").isNotNull(), earlier).when(whole, each).otherwise(F.array().cast("array<int>"))
    return joined.select("did", "mark", removed.alias("removed")).where(F.size("removed") > 0).groupBy("did", "mark").agg(F.flatten(F.collect_list("removed")).alias("removed"))


def covered(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


DONE = "did long, mark long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
_DONE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def substring_dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and text, the kept words)."""
    removed = durable(removed_windows(docs)).withColumnsRenamed({"did": "r_did", "mark": "r_mark"})
    touched = bit_map(removed, F.col("r_mark"), ROW_BITS)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes the texts without a bit; only the others travel on with their text."""
        for batch in batches:
            marks = np.asarray(batch.column(1)).view(np.uint64)
            waits = _has(touched, marks).tolist()
            counts, digests, texts = [], [], []
            for text, wait in zip(batch.column(3), waits, strict=True):
                words = [] if wait else text.as_py().encode().split()
                counts.append(None if wait else len(words))
                digests.append(None if wait else _digest(words))
                texts.append(text.as_py() if wait else (b" ".join(words).decode() if keep_text else None))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(counts, pa.int64()), pa.array([None if w else 0 for w in waits], pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["did", "mark", "doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_words, n_removed, digest, text, starts in zip(*[batch.column(k).to_pylist() for k in range(5)], batch.column(5), strict=True):
                if n_words is None:
                    words = text.encode().split()
                    gone = covered(len(words), np.asarray(starts.values) if starts.is_valid else np.empty(0, np.int64))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_words, n_removed, digest, text = len(words), len(words) - len(kept), _digest(kept), b" ".join(kept).decode() if keep_text else None
                rows.append((doc_id, n_words, n_removed, digest, text))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DONE_TYPES[2:], strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    first = _rows(docs).mapInArrow(untouched, DONE)
    joined = first.join(removed, (F.col("did") == F.col("r_did")) & (F.col("mark") == F.col("r_mark")), "left")
    done = joined.select("doc_id", "n_words", "n_removed", "kept_sha256", "text", "removed").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
    return done if keep_text else done.drop("text")


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM f, (SELECT unnest(range({WINDOW})) AS o)),
p AS (SELECT w.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
