"""Each operator against a plain version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import chat, exact_dedup, lm, mixing, packing, pii, simhash, substring_dedup, topk, toxicity

LONG = " ".join(f"w{k % 700}" for k in range(30_000))
TEXTS = [None, "", "  \t\n", "one", "two words", "Two words", "the same text here for all", "the  same text here\nfor all", LONG, LONG + " end", "été à la mer 😀 ￿ x", "a b c d e f g h i j"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "de" if k % 3 else None, None if k == 4 else f"s{k % 2}", "x", "y") for k, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, "the same text here for all", "en", "s0", "x", "y"), (100, "a b c d e f g h i k", "en", "s0", "x", "y")]
    schema = "doc_id long, text string, lang string, source string, keep_id string, fp string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=lambda x: (x is None, x))


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).round(1).tolist() if k % 4 else [0.5] * 6, 1) for k in range(400)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 6, 1), (450, [2.0], 1), (450, [2.0], 1), (None, [1.0] * 6, 1), (500, [float("inf")] * 6, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, (i, own) in enumerate(usable):
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(own, v)), j) for k, (j, v) in enumerate(usable) if k != q)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    for options in ({"pivots": 8, "rings": 4, "block": 16}, {}):
        got = [tuple(r) for r in topk.search(table, **options).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == sorted(want) and sum(r[0] == 450 for r in got) == 10
    assert topk.search(table.limit(0)).count() == 0
    few = topk.search(table.where("vec_id IN (0, 1, 2)")).collect()
    assert [r["rank"] for r in sorted(few)] == [1, 2]


@pytest.mark.parametrize("targets", [None, {"s0": 0.9}])
def test_packing(docs, none, targets):
    from tokenizers import Tokenizer
    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, targets, with_ids=True).toPandas()
    want = collections.Counter(tuple(exact.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    rows = docs.count()
    assert got["sequence_id"].nunique() == math.ceil(got["length"].sum() / 2048)
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert (window["offset"] == window["length"].cumsum() - window["length"]).all() and window["length"].sum() <= 2048
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got.itertuples())
    assert got["length"].sum() == sum(len(k) * n for k, n in want.items()) and (got["start"] == 0).sum() == rows
    whole = got[(got["start"] == 0) & (got["length"] == got["doc_tokens"])]
    assert all(tuple(ids) in want for ids in whole["ids"])
    assert packing.pack(none).count() == 0


def test_packing_schedule():
    rng = random.Random(3)
    for _ in range(200):
        totals = [rng.randint(0, 90) for _ in range(rng.randint(1, 5))]
        phases = packing.schedule(totals, [rng.randint(0, 5) for _ in totals], 16)
        firsts = [[p["given"][q] for p in phases] for q in range(len(totals))]
        cells = collections.Counter()
        for q, total in enumerate(totals):
            at = 0
            while at < total:
                n = min(total - at, rng.randint(1, 30))
                for start, length, sequence, offset in packing.cut(q, at, n, phases, firsts):
                    cells.update((sequence, offset + k) for k in range(length))
                at += n
        assert len(cells) == sum(totals) and set(cells.values()) <= {1}
        assert set(cells) == {(k // 16, k % 16) for k in range(sum(totals))}


def test_packing_proportions():
    phases = packing.schedule([3000, 1000], [3000, 1000], 100)
    took = [sum(length for _, length, s, _ in packing.cut(0, 0, 3000, phases, [[p["given"][0] for p in phases], []]) if s == w) for w in range(40)]
    assert took == [75] * 40


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, value):
        d = re.sub("[^0-9]", "", value)
        total = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d))))
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text, re.A) if valid(kind, m[0]))


def test_pii(spark, docs, none):
    rng = random.Random(5)
    hard = ["a@b.c_d@e.f x", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.0255", "10.0.0.1 0.0.0.0 000.00.0.0000 255.255.255.255 10.0.0.256 0.0.0.0256", "4381893557741609 4381-8935-5774-1609 é", "😀+49 30 1234567-", "@@a@b@c.d", "9" * 300, "x" * 50_000 + "@", "a.b@" + "c." * 20_000 + "d", "1.2.3.4," * 3000]
    hard += ["".join(rng.choice("a1.@+- é4") for _ in range(50)) for _ in range(300)] + ["".join(rng.choice("0123456789 -.") for _ in range(40)) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for r in pii.personal_data(table).collect():
        spans = base_spans(hard[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k in PLAIN)
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(none).count() == 0


def test_pii_terms_that_disclose(spark):
    rows = [(k, f"The report of Zorblatt went to z@x.org in item {k}") for k in range(6)] + [(k, f"The report number {k} went to nobody in item") for k in range(6, 80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert text[3] == "The report of  went to [EMAIL] in item 3" and text[20] == rows[20][1]
    added = {r.doc_id: r.n_added for r in pii.personal_data(table).collect()}
    assert all(n == 0 for k, n in added.items() if k >= 6) and added[0] == 1


def test_pii_many_hits_in_one_text_and_plain_statistics(spark):
    n = 8000
    table = spark.createDataFrame([(1, "10.0.0.1 and then " * n), (2, "x@y.zz 10.0.0.2")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert got[1].n_ip == n and got[1].spans.endswith(f"ip:{18 * (n - 1)}:{18 * (n - 1) + 8}") and got[2].n_email == 1
    rng = random.Random(11)
    rows = []
    for k in range(160):
        words = [rng.choice("amber birch cedar delta ember fjord grove heath".split()) for _ in range(12)]
        if k % 8 == 0:
            words += [f"mail{k % 24}@x.org", f"Name{'abc'[k % 24 // 8]}", "office"]
        rows.append((k, " ".join(words)))
    words = {k: {w.lower() for w in re.findall(r"(?<![\w@.])[A-Za-z]{3,}(?![\w@.])", t)} for k, t in rows}
    entity = {f"mail{j}@x.org": {k for k, t in rows if f"mail{j}@x.org" in t} for j in (0, 8, 16)}
    entity["x.org"] = set().union(*entity.values())
    terms = {w: {k for k in words if w in words[k]} for w in set().union(*words.values())}
    told = collections.defaultdict(set)
    for docs_of in entity.values():
        tested = []
        for term, having in terms.items():
            both, a, b = len(docs_of & having), len(docs_of), len(having)
            if both:
                hoeffding = 0.0
                for drawn, others in ((a, b), (b, a)):
                    p, q = both / drawn, others / len(rows)
                    if p > q:
                        hoeffding = min(hoeffding, -drawn * (p * math.log(p / q) + (0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - q)))))
                subsets = math.log(math.comb(a, both) * math.comb(b, both) / math.comb(len(rows), both))
                tested.append((min(hoeffding, subsets), term, 1 + math.log(both / b) / -math.log(a / len(rows)), having & docs_of))
        limit = max((c for c, *_ in tested if c <= math.log(sum(x[0] <= c for x in tested) * 0.01 / len(terms))), default=-math.inf)
        for chance, term, ratio, where in tested:
            if chance <= limit and ratio >= 0.9:
                for k in where:
                    told[k].add(term)
    assert any(told.values())
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {rows[r.doc_id][1][int(a) : int(b)].lower() for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind in pii.ADDED}
        assert found == told[r.doc_id]


def test_pii_terms_far_from_a_rare_entity(spark):
    far = " and".join([""] * 30)
    rows = [(k, f"Zorblatt wrote{far} to z@x.org. Later zorblatt left {k}") for k in range(2)] + [(k, f"Nobody wrote{far} to nobody. Later he left {k}") for k in range(2, 400)]
    table = spark.createDataFrame(rows + [(400, "Zorblatt2 wrote here")], "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert all(text[k] == f" wrote{far} to [EMAIL]. Later  left {k}" for k in range(2)) and all(text[k] == t for k, t in rows[2:])
    spans = {r.doc_id: r.spans for r in pii.personal_data(table).collect()}
    start = rows[0][1].index("z@x.org")
    assert spans[1] == f"remove:0:8,email:{start}:{start + 7},remove:{start + 15}:{start + 23}"
    many = [(0, "Zorblatt wrote to z@x.org and y@x.org")] + [(k, f"Nobody wrote to nobody and left {k}") for k in range(1, 3000)]
    alone = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert alone[0] == " wrote to [EMAIL] and [EMAIL]" and alone[7] == many[7][1]
    # few documents: a word of one of them is no evidence
    few = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(many[:9], "doc_id long, text string")).collect()}
    assert few[0] == "Zorblatt wrote to [EMAIL] and [EMAIL]"


def test_pii_copies_are_no_evidence(spark):
    """Copies of one text count once; what its distinct neighbours tell is put back on all its copies."""
    copies = [(k, "Zorblatt wrote to z@x.org about quiet rivers") for k in range(40)]
    others = [(k, f"Nobody wrote to nobody about loud streets {k}") for k in range(40, 200)]
    table = spark.createDataFrame(copies + others, "doc_id long, text string").repartition(7)
    assert all(r.n_added == 0 for r in pii.personal_data(table).collect())
    told = [(k, f"Zorblatt wrote to z@x.org about loud streets {k}") for k in range(200, 204)] + others + copies[:3]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert all(found[k].spans.startswith("remove:0:8,email:") for k in (0, 1, 2, 200, 203)) and found[0].spans == found[2].spans
    plain = {r.doc_id: r.n_added for r in pii.personal_data(table, false_share=float("inf")).collect()}
    assert plain[0] == plain[39] == 3 and plain[40] == 0


def test_pii_parts_are_entities(spark):
    rows = [(k, f"Mail u{k}@zorblatt.org for the Zorblatt office in room {k}") for k in range(6)] + [(k, f"Mail u{k}@plain{k}.org for the other office in room {k}") for k in range(6, 120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal_data(table).collect()}
    assert all("remove:" in found[k] for k in range(6)) and not any("remove:" in found[k] for k in range(6, 120))
    assert not any("remove:" in r.spans for r in pii.personal_data(table, parts=False).collect())


def test_language_model(docs, none, spark):
    got = lm.score_documents(docs, head_size=5).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b" end"]
    rows = docs.collect()
    counts = collections.Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), held(r.doc_id), len(words(r.text)), sum(counts[w] > 0 for w in words(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r.text)), 4)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.score_documents(none).count() == 0


def test_language_model_learns_and_sums_to_one(spark):
    rng = random.Random(2)
    said = [" ".join(rng.choice((["the cat sat", "the dog ran"], ["der hund lief", "die katze sass"])[k % 2]) for _ in range(40)) for k in range(300)]
    table = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = lm.score_documents(table).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]
    weights, bias = np.random.default_rng(0).normal(size=(lm.ROWS, 7)).astype(np.float32), np.zeros(7, np.float32)
    rows = lm._features(np.array([1, 2, 3, 0], np.int32), np.array([0]))
    assert np.allclose(lm._probabilities(weights, bias, rows).sum(axis=1), 1, atol=1e-5)
    assert all(lm._features(np.arange(5000, dtype=np.int32), np.array([0]), n).max() < n for n in (1 << 14, 1 << 16))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("place", [1024, 2])
def test_simhash(docs, none, place):
    rows = docs.collect()
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs, place=place).collect())
    prints = [plain_fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    assert got == sorted((str(r.doc_id), f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group))
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_links_of_a_dense_group(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    near = {base}
    while len(near) < 300:
        x = rng.choice(sorted(near))
        near.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    far = {rng.getrandbits(64) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near | far]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for place in (1024, 16):
        from sieveline.llm.components import connected_components

        links = simhash.fingerprint_links(table, place=place)
        assert links.count() < 20 * 600
        roots = connected_components(links).collect()
        joined = {r.node for r in roots if r.root == next(q.root for q in roots if q.node == signed[[*(near | far)].index(base)])}
        assert len(joined) == 300


def plain_substring(rows, window=20):
    words = [(r.text or "").encode().split() for r in rows]
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is None, rows[k].doc_id))
    place = lambda k, a: (rows[k].doc_id is None, rows[k].doc_id or 0, a)
    for k in order:
        for a in range(len(words[k]) - window + 1):
            key = tuple(words[k][a : a + window])
            first[key] = min(first.get(key, place(k, a)), place(k, a))
    out = []
    for k, r in enumerate(rows):
        gone = {p for a in range(len(words[k]) - window + 1) if first[tuple(words[k][a : a + window])] < place(k, a) for p in range(a, a + window)}
        kept = [w for p, w in enumerate(words[k]) if p not in gone]
        out.append((str(r.doc_id), len(words[k]), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring(spark, docs, none, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(200 + k, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(90))) + (f" {passage} " if k % 3 == 0 else " ") + " ".join(f"x{rng.randrange(900)}" for _ in range(40)), "de", "s", "x", "y") for k in range(60)]
    table = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table).collect())
    assert got == plain_substring(table.collect())
    kept = {r.doc_id: r.text for r in substring_dedup.substring_dedup(table, keep_text=True).where("doc_id >= 200").collect()}
    assert "p30" in kept[200] and "p30" not in kept[203]
    assert substring_dedup.substring_dedup(none).count() == 0


def test_fm_index_counts():
    from sieveline.llm.fm_index import FMIndex

    rng = np.random.default_rng(7)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = FMIndex(text, 5)
    assert sorted(index.places(np.arange(301)).tolist()) == list(range(301)) and len(index.samples) == 38
    for length in (1, 3, 8):
        ends = np.arange(length - 1, 300)
        reached, low, high = index.statistics(text, ends, length)
        for k, end in enumerate(ends):
            places = [a for a in range(300 - length + 1) if (text[a : a + length] == text[end - length + 1 : end + 1]).all()]
            assert (reached[k] == length) == (len(places) > 1)
            if len(places) > 1:
                assert high[k] - low[k] == len(places) and index.first_places(low[k : k + 1], high[k : k + 1])[0] == places[0]


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_dedup(docs, none, digest):
    rows = docs.collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows]
    want = []
    for r, t in zip(rows, norm):
        group = [q for q, u in zip(rows, norm) if u == t]
        keep = max((q for q in group if q.doc_id is not None), key=lambda q: (len(q.text or ""), -q.doc_id)).doc_id
        want.append((str(r.doc_id), keep, len(group), r.doc_id == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, digest).collect()]
    assert sorted(got) == sorted(want)
    kept = exact_dedup.keep_exact(docs, digest)
    assert kept.columns == docs.columns and ids(kept) == sorted(int(w[0]) for w in want if w[3])
    assert exact_dedup.exact_dedup(none).count() == 0


def test_dedup_of_a_table_ingested_twice(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (1, "another text of the same id"), (2, "one two  three four"), (2, "one two  three four"), (None, "no id at all"), (None, "no id at all")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, "no id at all"), (1, "another text of the same id"), (2, "one two  three four")]
    order = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert order(exact_dedup.keep_exact(table)) == sorted(want, key=str)
    got = exact_dedup.exact_dedup(table)
    assert got.count() == 7 and order(got.where("kept").select("doc_id", "group_size")) == sorted([(None, 2), (1, 1), (2, 4)], key=str)
    near = [(1, "one two three four"), (1, "one two three four"), (3, "one two three four"), (3, "a text by itself"), (0, "a text by itself"), (None, "no id at all"), (None, "no id at all"), (None, "one two three four")]
    left = order(simhash.keep_near(spark.createDataFrame(near, "doc_id long, text string").repartition(3)))
    assert left == sorted([(1, "one two three four"), (0, "a text by itself"), (None, "no id at all")], key=str)


def test_exact_dedup_of_a_hot_group_and_clashing_names(spark):
    rows = [(k, "one text" if k % 2 else f"text {k}", "a") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __row string").withColumns({c: F.lit("x") for c in ("__keep", "__stay", "__keep_id", "__toxicity", "cell_topic", "source", "lang", "hashes", "content", "row", "n_row")})
    got = exact_dedup.exact_dedup(table)
    assert got.where("group_size = 300 AND keep_id = 1").count() == 300 and got.where("kept").count() == 301 and got.count() == 600
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for kept in (exact_dedup.keep_exact(table), simhash.keep_near(table), mixing.sample(table, share=1.0), toxicity.keep_clean(table, labels)):
        assert kept.columns == table.columns and kept.where("__row = 'a' AND __toxicity = 'x'").count() == kept.count() > 0
    assert exact_dedup.keep_exact(table).count() == 301


def test_near_texts_of_a_large_group(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(400):
        words = list(base) if k % 2 else [f"v{rng.randrange(5000)}" for _ in range(60)]
        if k % 2:
            for _ in range(rng.randrange(3)):
                words[rng.randrange(120)] = f"w{rng.randrange(5000)}"
        rows.append((k, " ".join(words)))
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in (tuple(x.split()) for _, x in rows)]
    group = list(range(400))
    for _ in range(5):
        for i in range(400):
            for j in range(i):
                if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    for place in (1024, 32):
        kept = set(ids(simhash.keep_near(spark.createDataFrame(rows, "doc_id long, text string"), place=place)))
        # nothing unlike is dropped; of the 199 texts that differ from one in up to two words, 98 % are found at least
        assert kept >= {g for g in group if group.count(g) == 1} and len(kept) - len(set(group)) <= 0.02 * (400 - len(set(group)))


@pytest.mark.parametrize("place", [1024, 32])
def test_near_texts_lose_no_link(spark, place):
    """Chains of variants in one large group: each link counts, at any size of a place and any distance of fingerprints."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    texts = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(60)] = f"w{rng.randrange(50000)}"
        texts.append(" ".join(words[: rng.randrange(3, 60)] if k % 3 == 0 else words))
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in map(str.split, texts)]
    group = list(range(400))
    for i in range(400):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert ids(simhash.keep_near(rows, place=place)) == sorted(set(group))


def join_rows(spark, work):
    """The most rows that a join makes while work runs, all runs of joins on the same columns together."""
    store, made = spark._jsparkSession.sharedState().statusStore(), {}
    before = store.executionsCount()
    result = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for k in range(before, runs.size()):
        values = store.executionMetrics(runs.apply(k).executionId())
        nodes = store.planGraph(runs.apply(k).executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            for m in metrics if "Join" in node.name() else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    key = node.desc().partition("]")[0] + node.desc().partition("]")[2].split("]")[0]
                    key = re.sub(r"#\d+L?|\(\d+\)", "", key)
                    made[key] = made.get(key, 0) + int(values.apply(m.accumulatorId()).replace(",", ""))
    return result, max(made.values())


def test_near_texts_join_each_pair_once(spark):
    """A group of texts that share most first shingles, none of them similar: each pair is one row, not one for each shingle."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k, spots in enumerate(rng.sample([*combinations(range(4, 196, 8), 4)], 100)):
        words = list(base)
        for at in spots:
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept, most = join_rows(spark, lambda: ids(simhash.keep_near(rows)))
    sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in map(str.split, texts)]
    links = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert links == 0 and kept == list(range(100))
    assert most <= 2 * 4950, most


def test_packing_holds_the_targets_in_each_window(spark):
    rows = [(k, "some words of a text " * 8, f"s{k % 2 if k % 10 else k % 200}") for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(table, {"s0": 0.2, "s1": 0.5}, size=1000).toPandas()
    tokens = got.groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    whole = tokens[(tokens.sum(axis=1) == 1000)]
    mixed = whole[(whole["s0"] > 0) & (whole["s1"] > 0) & (whole.drop(columns=["s0", "s1"]).sum(axis=1) > 0)].iloc[:-1]
    assert len(mixed) > 5 and (abs(mixed["s0"] - 200) <= 1).all() and (abs(mixed["s1"] - 500) <= 1).all()
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert (window["offset"] == window["length"].cumsum() - window["length"]).all()


def plain_matches(folded, weights):
    """Every entry looked for at every place, the largest weight at each."""
    found = {}
    for entry, weight in weights.items():
        at = folded.find(entry)
        while at >= 0:
            found[at] = max(weight, found.get(at, weight))
            at = folded.find(entry, at + 1)
    return found


def test_toxicity_matcher_is_a_plain_search(spark):
    rng = random.Random(13)
    words = ["mor", "moron", "moronic", "idiot", "id", "idea", "river", "bank"]
    weights = {" moron ": 2.0, " moro": 1.0, " idio": 1.5, " river ": 0.5}
    model = toxicity.Model(weights, {("moron", "river"), ("the", "idiot")}, (-1.0, 0.7, 0.1))
    automaton = toxicity._automaton(model.key())
    texts = [" ".join(rng.choice([*words, "the", "m0ron", "MORON!"]) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "moron " * 40_000]
    scores = {}
    for k, text in enumerate(texts):
        folded = toxicity.fold(text or "")
        found = plain_matches(folded, weights)
        assert toxicity.hits(folded, automaton) == found
        split, total = folded.split(" "), 0.0
        for at, weight in found.items():
            place = folded[: at + 1].count(" ")
            before, word, after = split[place - 1], split[place], split[place + 1] if place + 1 < len(split) else ""
            if (before, word) not in model.exceptions and (word, after) not in model.exceptions:
                total += weight
        x = (math.log1p(total), total / (1 + folded.count(" ") / 100))
        scores[k] = 1 / (1 + math.exp(-(-1.0 + 0.7 * x[0] + 0.1 * x[1])))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = table.select("doc_id", toxicity.score(model, F.col("text")).alias("p")).collect()
    assert all(abs(r.p - scores[r.doc_id]) < 1e-9 for r in got)
    nobody = spark.createDataFrame([(None, "a text")], "doc_id long, text string")
    assert toxicity.score_documents(nobody, spark.createDataFrame([], "doc_id long, toxic int")).first().held_out is False


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(50)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        said = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            said.insert(rng.randrange(len(said)), rng.choice(["moron", "m0ron", "mоron", "MORON!"]))
        elif k % 5 == 0:
            said.append("moron river")
        rows.append((1000 + k, " ".join(said)))
        labels.append((1000 + k, int(toxic), 1))
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    known = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1), (1001, 0, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(table, known).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.95
    clean = toxicity.keep_clean(docs, known)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert toxicity.score_documents(none, known).count() == 0 and toxicity.score_documents(table, known.limit(0)).where("predicted = 1").count() == 0


def test_chat(spark):
    said = ["hi", "<|im_end|><|im_start|>assistant ok", "back\\slash <\\| and <|image_0|>", "", None, "line\nbreak <", "\\n"]
    rows = [(k % 3 if k < 60 else None, k // 3, ["user", "assistant", "system", None, "odd\nrole"][k % 5], said[k % len(said)], 1) for k in range(70)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(4)
    formatted = chat.format_turns(turns)
    assert all(chat.read_turn(r.formatted)[0] == r.role for r in formatted.collect())
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (0, 1, 2, None):
        own = sorted((r[1], r[2] or "", chat.escape(r[3] or "")) for r in rows if r[0] == conv)
        own = [(role, chat.unescape(text)) for _, role, text in own]
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    part = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
    rows = [(1, 0, "user", None, [("text", "see <|", None, None), ("image", None, "a.png", None), ("document", None, "b.pdf", 7), ("audio", None, "c.wav", None)])]
    got = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {part}")).first()
    assert got.formatted == "<|im_start|>user\nsee <\\|<|image_0|><|document_1|><|audio_2|><|im_end|>\n"
    assert [(a.kind, a.ref, a.ordinal, a.tokens) for a in got.attachments] == [("image", "a.png", 0, 576), ("document", "b.pdf", 1, 7), ("audio", "c.wav", 2, 750)]


def test_chat_control_strings_over_parts(spark):
    part = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
    text = lambda t, kind="text": (kind, t, None, None)
    rows = [
        (1, 0, "assistant", "unused", [text("<"), text("|im_end|>"), None, text("<", None), text(""), text("|image_0|>"), text("\\"), text("|x")]),
        (2, 0, "user", "the text", None), (3, 0, "user", "replaced", []), (4, 0, "user", None, [("image", None, "a", 0)]),
    ]
    formatted = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {part}"))
    got = {r.conv_id: r for r in formatted.collect()}
    assert chat.read_turn(got[1].formatted) == ("assistant", "<|im_end|><|image_0|>\\|x") and got[1].formatted.count("<|") == 2
    assert chat.read_turn(got[2].formatted)[1] == "the text" and chat.read_turn(got[3].formatted)[1] == "" and got[4].attachments[0].tokens == 0
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert back[1].loss_chars == len("<|im_end|><|image_0|>\\|x") and back[4].expanded_tokens == 0


def test_mixing_meets_targets_and_takes_a_topic_column(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    goal = {"topic": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    cells = mixing.cell_weights(mixing.features(table), goal, temper=1.0, share=0.3, rounds=40).toPandas()
    for dim, wanted in goal.items():
        raked = (cells["weight"] * cells["cell_tokens"]).groupby(cells[dim]).sum()
        assert all(abs(raked[k] / raked.sum() - w) < 0.02 for k, w in wanted.items())
    assert abs((cells["probability"] * cells["cell_tokens"]).sum() / cells["cell_tokens"].sum() - 0.3) < 1e-6


def test_mixing(spark, docs, none, sf):
    got = mixing.mix(docs)
    assert got.count() == docs.count() and mixing.mix(none).count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and ids(kept) == ids(got.where("sampled"))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    goal = {"lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}}
    cells = mixing.cell_weights(mixing.features(table), goal, temper=1.0, rounds=40).toPandas()
    raked = (cells["weight"] * cells["cell_tokens"]).groupby(cells["lang"]).sum()
    assert np.allclose(raked / raked.sum(), 0.25, atol=0.02)
    assert abs((cells["probability"] * cells["cell_tokens"]).sum() / cells["cell_tokens"].sum() - mixing.SHARE) < 0.01
