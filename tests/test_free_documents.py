"""Documents without tokens, and without a source, at their place in the walks, held against the SQL."""

import duckdb
import pytest

from sieveline.catalogue import ORACLES, QUERIES

ODD = [(-1, "", "src1"), (-2, " \n ", "src11"), (-3, "\t", "src2"), (-4, "the reader of this thing", None), (-5, "the reader", None)]


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE documents AS SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet'")
    lang = duck.execute("SELECT min(lang) FROM documents").fetchone()[0]
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, text, lang, source, len(text)) for i, text, source in ODD])
    duck.execute(f"COPY documents TO '{path}/documents.parquet' (FORMAT parquet)")
    return str(path), duck


@pytest.mark.parametrize("name", ["budget_trim", "naive_budget", "relevance_budget", "rendered_segments", "select_documents", "source_map_offsets"])
def test_documents_without_tokens(spark, odd, name):
    path, duck = odd
    result = QUERIES[name](spark, path)
    expected = duck.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(map(tuple, result.select(*columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
