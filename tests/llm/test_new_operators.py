"""Vector codes, the licence scan and the filter audit against plain versions, on nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from sieveline.llm import codes, filter_audit, licenses

LONG = " ".join(f"w{k % 700}" for k in range(30_000))


def plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, vector), kept ones; everything with Python's integers."""
    width = -(-max(len(v) for _, _, v in rows) // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v)) for _, _, v in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k][: len(rows[k][2])]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[nearest(p, c[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c, e in zip(cut, own[p], strict=True):
                groups[e].append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if groups[e] else old for e, old in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = collections.Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, label, _), f, e in zip(rows, found, errors, strict=True)), key=repr)


@pytest.mark.parametrize("width, entries", [(8, 16), (12, 5), (7, 256)])
def test_codes(spark, width, entries):
    rng = np.random.default_rng(width)
    rows = [(int(k), None if k % 5 == 0 else int(k % 3), rng.normal(size=width).round(2).tolist()) for k in rng.permutation(300)]
    rows += [(7, 1, [0.5] * width)] * 3 + [(None, 2, [0.25] * width), (900, 1, []), (901, 1, [0.125]), (902, 2, [-0.0001] * width)]
    broken = [(1000, 1, None), (1001, 1, [1.0, None]), (1002, 1, [float("nan")] * width), (1003, None, [float("inf")] * width)]
    table = spark.createDataFrame([(*r, "x") for r in rows + broken], "vec_id long, label int, embedding array<double>, code string").repartition(5)
    got = sorted((tuple(r) for r in codes.encode(table, entries=entries).collect()), key=repr)
    assert got == plain_codes(rows, codes.PARTS, entries, codes.ROUNDS)
    assert codes.encode(table.limit(0)).count() == 0 and codes.encode(table.where("vec_id >= 1000")).count() == 0


def test_codes_of_one_label_are_summed(spark):
    table = spark.createDataFrame([(k, k if k % 3 else 0, [float(k % 7), float(k % 11), 1.0, 0.0]) for k in range(600)], "vec_id long, label int, embedding array<float>")
    rows = codes.encode(table, entries=4).collect()
    label = {k: k if k % 3 else 0 for k in range(600)}
    sums = collections.Counter()
    for r in rows:
        sums[label[r.vec_id]] += r.error
    assert all(r.label_error == sums[label[r.vec_id]] for r in rows)


@pytest.mark.parametrize("width, largest", [(16, 2000), (5, 10**9), (1, 3)])
def test_elimination_is_exact(width, largest):
    rng = np.random.default_rng(largest % 97)
    transform = codes.Transform(width, largest)
    assert (transform.kind is object) == (largest == 10**9)
    assert (codes.hadamard(16) @ codes.hadamard(16).T == 16 * np.eye(16)).all() and [(np.diff(r) != 0).sum() for r in codes.hadamard(16)] == list(range(16))
    parts = rng.integers(-largest, largest + 1, (700, width))
    entries = np.concatenate([rng.integers(-largest, largest + 1, (60, width)), parts[:20], parts[:20]])  # ties
    found, far = transform.nearest(parts, transform(entries))
    for x, e, d in zip(parts.tolist(), found.tolist(), far.tolist(), strict=True):
        assert (d, e) == min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(entries.tolist()))


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_scan(texts):
    listed = [plain_words(t) for t in texts]
    index = licenses.Index(licenses.TEMPLATES, licenses.BASE)
    weight = {w: max(1, round(licenses.UNIT * math.log((len(texts) + 1) / (sum(w in set(ws) for ws in listed) + 0.5)))) for w in index.vocabulary}
    out = []
    for ws in listed:
        base, labels, score = [], set(), 0.0
        for t, own in enumerate(index.words):
            for at in range(-len(own) + 1, len(ws)):
                held = {p for p, w in enumerate(own) if 0 <= at + p < len(ws) and ws[at + p] == w}
                share = sum(weight[own[p]] for p in held) / sum(map(weight.get, own))
                if index.mandatory[t] <= held and (len(held) == len(own) if t < index.n_base else sum(weight[own[p]] for p in held) >= math.ceil(licenses.SHARE * sum(map(weight.get, own)))):
                    labels.add(index.labels[t])
                    score = max(score, share)
                    base += [(at, index.labels[t])] * (t < index.n_base)
        places = [a for a, _ in base]
        out.append((len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), round(score, 9)))
    return out


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    rng = random.Random(2)
    vocabulary = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()}) + ["und", "mit", "der"] * 20
    texts = [None, "", "  ", "MIT License", "mit-license\nMIT_LICENSE", "mit  mit license license", "GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4 0", "mit éLicense license", "mit lıcense; mit lİcense; mit licensé", "apache license", mit, mit.replace("copy", "COPIE"), mit.replace("free of charge", "gratis"), " ".join(mit.split()[3:]), LONG + " Apache License " + LONG]
    texts += ["liKense mit license", "Kit"] + [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    texts += [f"{rng.choice(['x ', ''])}{text[rng.randrange(20) :]} y" for _, text, _ in licenses.TEMPLATES for _ in range(2)] + ["plain words only"] * 40
    table = spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(texts)], "doc_id long, text string, word string, row string, hits string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.license_scan(table).collect()}
    want = plain_scan(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert {x for w in want for x in w[5].split(",")} >= {"mit", "gpl", "apache", "cc-by-nc", "bsd", "isc", "mpl", "unlicense"} and want[7][4:6] == ("", "cc-by-nc")
    assert licenses.license_scan(table.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "mit license")], "doc_id long, text string")
    assert [r.n_base for r in licenses.license_scan(twice).collect()] == [1, 1, 1]


def test_license_templates_must_hold_their_phrases():
    with pytest.raises(ValueError):
        licenses.Index([("x", "a b c", ("b a",))], {})


def plain_audit(rows, labels):
    marks = collections.defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    masks = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        masks.append((source or "", {k for k, v in fails.items() if v}, marks[i] if i is not None else [False, False]))
    out, total = {}, collections.Counter()
    for part in {p for p, _, _ in masks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order):
                before, own = set(order[:step]), [(m, g) for p, m, g in masks if p == part]
                gone = [g for m, g in own if letter in m and not m & before]
                out[part, order, step + 1] = [sum(not m & {*before, letter} for m, _ in own), len(gone), sum(letter in m and bool(m & before) for m, _ in own), sum(m == {letter} for m, _ in own), sum(g[0] for g in gone), sum(g[1] for g in gone)]
                total[part, letter] += len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(4)
    texts = [None, "", "A B C", "a" * 30 + " Zz", LONG, LONG + " #", " ".join(f"x{k}" for k in range(250)), " ".join(f"X{k}" for k in range(250)) + "\u000b%", "é 😀 | \u001c x", "same text", " ".join(["w"] * 399 + ["é"])]
    rows = [(k, rng.choice(texts), rng.choice(["s", "t", None, "", "é"])) for k in range(150)]
    rows += [rows[3], rows[3], (None, "same text", "s"), (None, None, "u"), (5, "other", "t")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 9, "m") for r in rows], "doc_id long, text string, source string, part int, mask string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, marks).collect()
    want = plain_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want) == 600 * len({r.part for r in got})
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.filter_audit(docs, marks.limit(0)).collect())
