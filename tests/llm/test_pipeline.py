"""The pipeline against its stages done plainly, and the registered queries against DuckDB."""

import math
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from sieveline.llm import registry, toxicity
from sieveline.llm.common import table


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, table(spark, sf, "labels"))
    automaton, (b0, b1, b2) = toxicity._automaton(model.key()), model.coefficients
    measured = {i: toxicity.measure(r.text or "", model, automaton) for i, r in rows.items()}
    left = {i for i, (x, y) in measured.items() if 1 / (1 + math.exp(-(b0 + b1 * x + b2 * y))) < 0.5}
    stages = dict(corpus_pipeline.STAGES)
    now = stages["toxicity"](spark, docs, sf)
    assert now.columns == columns and {r.doc_id for r in now.collect()} == left and len(left) < len(rows)
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", rows[i].text or "") for i in left}
    keep = {}
    for i in left:
        keep[norm[i]] = max(keep.get(norm[i], i), i, key=lambda k: (len(rows[k].text or ""), -k))
    now = stages["exact_dedup"](spark, now, sf)
    left = set(keep.values())
    assert now.columns == columns and {r.doc_id for r in now.collect()} == left
    sets = {i: plain_shingles(rows[i].text) for i in sorted(left)}
    group = {i: i for i in sets}
    pairs = [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and len(a & b) >= 0.8 * len(a | b)]
    for _ in pairs:
        before = dict(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    assert any(len(sets[i]) > 5 for i, _ in pairs)
    now = stages["simhash"](spark, now, sf)
    left = set(group.values())
    assert now.columns == columns and {r.doc_id for r in now.collect()} == left
    now = stages["mixing"](spark, now, sf)
    mixed = {r.doc_id for r in now.collect()}
    assert now.columns == columns and mixed < left
    assert {r.doc_id for r in stages["packing"](spark, now, sf).collect()} == mixed
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == mixed


def test_hard_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, ties, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, topic string"
    rows = [(1, "a b", "en", "s", 3, "x", "t"), (1, "a b", "en", "s", 3, "x", "t"), (2, None, None, None, None, None, None), (None, "", "en", "s", 0, "x", "t"), (3, "A  b", "en", "s", 4, "x", None), (4, "w " * 5000, "de", "r", 10000, "x", "t")]
    for name, some in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = table(spark, folder, "documents")
        for stage_name, stage in corpus_pipeline.STAGES[:3]:
            now = stage(spark, now, folder)
            assert now.columns == [c.split()[0] for c in schema.split(", ")], stage_name
        assert now.count() == (3 if some else 0)
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert bool(pieces) <= bool(some)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        order = [c[0] for c in want.description]
        assert sorted(order) == columns and rows == sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_held_out_rows(spark, sf):
    got = registry.QUERIES["op8_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
