"""A graph artifact is compared and explained when its sources are gone."""

import shutil

import pytest

from sieveline.operators import artifact


def parts(spark, rank=1):
    of = lambda name, *rows: spark.createDataFrame(list(rows), artifact.SCHEMAS[name])
    return {
        "nodes": of("nodes", ("a", "document", "u/a", "h1"), ("b", "document", "u/b", "h2"), ("c", "document", "u/c", "h3")), "edges": of("edges", ("a", "b", "requires"), ("c", "a", "contradicts")),
        "decisions": of("decisions", ("a", rank, None), ("b", None, "superseded")), "codes": of("codes", ("a", "CTX200"), ("a", "CTX500"), ("c", "CTX200")),
    }


def test_explanations_need_no_sources(spark, tmp_path):
    sources, path = tmp_path / "sources", str(tmp_path / "artifact")
    for name, rows in parts(spark).items():
        rows.write.parquet(str(sources / name))
    assert artifact.export(spark, path, {name: spark.read.parquet(str(sources / name)) for name in artifact.SCHEMAS if name != "facts"}, {"task": "t"}) == 1
    shutil.rmtree(sources)
    found = {r.node_id: (r.status, r.reason, r.codes, r.related) for r in artifact.explain(artifact.read(spark, path)).collect()}
    assert found == {"a": ("included", None, ["CTX200", "CTX500"], ["b", "c"]), "b": ("excluded", "superseded", None, ["a"]), "c": ("unknown", None, ["CTX200"], ["a"])}


def test_versions_are_compared_by_one_fingerprint(spark, tmp_path):
    path = str(tmp_path / "artifact")
    for k, rank in enumerate((1, 1, 2)):
        assert artifact.export(spark, path, parts(spark, rank), {"task": "t"}) == k + 1
    one, same, other = (artifact.read(spark, path, v) for v in (1, 2, 3))
    assert {(r.only_first, r.only_second) for r in artifact.compare(one, same).collect()} == {(0, 0)}
    assert {r.part: (r.only_first, r.only_second) for r in artifact.compare(one, other).collect() if r.only_first} == {"decisions": (1, 1), "whole": (1, 1)}
    with pytest.raises(ValueError):
        artifact.read(spark, str(tmp_path / "nothing"))
