"""Scans, projections and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import render
from sieveline.queries import query
from sieveline.sources import files, rules, tables
from sieveline.store import read_table

#: The task whose terms the relevance queries use.
TASK = "the reader of this thing with that ing and for the nation"
TERMS = tx.terms(TASK)
_RELEVANCE = "(" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS) + f") / {float(len(TERMS))}"
TOKENS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}\p{Pc}]+|[^\p{L}\p{N}\p{M}\p{Pc}\s]'))::BIGINT"


@query("SELECT doc_id, 'sha256:' || sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {TOKENS_SQL} AS n_tokens FROM documents")
def generic_token_count(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


@query(f"SELECT lang, count(*) AS n_docs, sum({TOKENS_SQL})::BIGINT AS n_tokens, max({TOKENS_SQL}) AS max_tokens FROM documents GROUP BY lang")
def tokens_by_lang(spark, sf_dir):
    counted = read_table(spark, sf_dir, "documents").select("lang", tx.token_count(F.col("text")).alias("t"))
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens"), F.max("t").alias("max_tokens"))


@query("SELECT item_id, i::BIGINT AS ordinal, ('0x' || substr(sha256(t), 1, 16))::UBIGINT::VARCHAR AS token_id FROM (SELECT item_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS ts FROM benchmark))".replace("\\\\", "\\"))
def token_ids(spark, sf_dir):
    ids = read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.token_ids(F.col("text"))).alias("ordinal", "token_id"))
    return ids.select("item_id", F.col("ordinal").cast("long").alias("ordinal"), "token_id")


_BREAK = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"


#: The number of lines of a text.
LINES_SQL = f"greatest(1, len(regexp_split_to_array(text, '{_BREAK}')) - (regexp_split_to_array(text, '{_BREAK}')[-1] = '')::INT)"


@query(f"SELECT doc_id, greatest(1, len(p) - (p[-1] = '')::INT)::BIGINT AS n_lines FROM (SELECT doc_id, regexp_split_to_array(text, '{_BREAK}') AS p FROM documents)")
def line_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.line_count(F.col("text")).alias("n_lines"))


@query(f"SELECT doc_id, round({_RELEVANCE}, 6) AS relevance FROM documents")
def lexical_relevance(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.round(tx.relevance(F.col("text"), TERMS), 6).alias("relevance"))


@query(f"SELECT doc_id, round({_RELEVANCE}, 6) AS relevance FROM documents ORDER BY 2 DESC, doc_id LIMIT 20")
def relevance_topn(spark, sf_dir):
    """A top-20 report."""
    return lexical_relevance(spark, sf_dir).orderBy(F.desc("relevance"), "doc_id").limit(20)


@query("""WITH e AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents)
SELECT term, count(*) AS n_docs FROM d SEMI JOIN e USING (term) GROUP BY term""")
def term_hits(spark, sf_dir):
    """How many documents hold each term of the benchmark tasks."""
    explode = lambda text, pattern: F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    terms = read_table(spark, sf_dir, "benchmark").select(explode("text", tx.TERM).alias("t")).select(F.lower("t").alias("term")).distinct()
    docs = read_table(spark, sf_dir, "documents").select(explode(F.lower("text"), "[a-z0-9_]+").alias("term"))
    counted = docs.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.join(terms, "term", "left_semi")


@query("SELECT event_id, round(1 / (1 + greatest(0, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 1e6 / 86400), 6) AS freshness FROM events")
def freshness_events(spark, sf_dir):
    anchor = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return read_table(spark, sf_dir, "events").select("event_id", F.round(tx.freshness(F.col("ts"), anchor), 6).alias("freshness"))


_VALUE = f"round({_RELEVANCE} + 0.2 * CASE WHEN source LIKE 'src1%' THEN 0.0 ELSE 1.0 END - 0.2 * (cn > 1)::INT, 6)"


@query(f"SELECT doc_id, {_VALUE} AS value FROM (SELECT *, count(*) OVER (PARTITION BY text) AS cn FROM documents)")
def base_values(spark, sf_dir):
    """Relevance, trust by source, and redundancy of copies, weighted."""
    docs = tables.document_nodes(spark, sf_dir).withColumn("h", F.sha2("content", 256))
    copies = docs.groupBy("h").agg(F.count(F.lit(1)).alias("cn"))
    trust = F.when(F.col("trust_domain") == "external_content", 0.0).otherwise(1.0)
    value = tx.base_value(relevance=tx.relevance(F.col("content"), TERMS), trust=trust, redundancy=(F.col("cn") > 1).cast("double"))
    return docs.join(copies, "h").select("doc_id", F.round(value, 6).alias("value"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query(f"""SELECT page_id, CASE WHEN octet_length(encode(html)) > 20000 THEN 'CTX002' WHEN contains(html, chr(0)) THEN 'CTX001' ELSE '' END AS skip_code,
CASE WHEN regexp_matches({_PATH}, '\\.(html|md|rst|txt)$') THEN 'document' WHEN regexp_matches({_PATH}, '\\.py$') THEN 'module' ELSE 'file' END AS kind,
regexp_matches({_PATH}, '(^|/)\\.') AS hidden FROM pages""")
def scan_decisions(spark, sf_dir):
    """Skip reason, kind and hidden flag of each page, taken as a file at its path."""
    pages = read_table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", ""))
    content = F.encode("html", "utf-8")
    return pages.select("page_id", F.coalesce(files.skip_code(content, 20000), F.lit("")).alias("skip_code"), files.node_kind(F.col("path"), ("html", "md", "rst", "txt")).alias("kind"), files.is_hidden(F.col("path")).alias("hidden"))


@query(f"""SELECT page_id, CASE WHEN NOT regexp_matches(p, '[\\s%\\\\?#]') AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') THEN '/' || array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path,
regexp_replace(replace(regexp_replace(p, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') AS module FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS p FROM pages)""")
def canonical_paths(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return read_table(spark, sf_dir, "pages").select("page_id", tx.canonical_path(path).alias("path"), tx.module_name(path).alias("module"))


RULES = [
    {"glob": "doc://src1*/*", "trust_domain": "external_content"},
    {"glob": "doc://*/*7", "sensitivity": "sensitive"},
    {"glob": "doc://src12/*", "trust_domain": "unverified_tool", "sensitivity": "internal"},
    {"glob": "doc://src?/1*", "sensitivity": "secret"},
]


@query("""SELECT doc_id, CASE WHEN uri LIKE 'doc://src12/%' THEN 'unverified_tool' WHEN uri LIKE 'doc://src1%/%' THEN 'external_content' ELSE 'retrieved_document' END AS trust_domain,
CASE WHEN uri LIKE 'doc://src_/1%' THEN 'secret' WHEN uri LIKE 'doc://src12/%' THEN 'internal' WHEN uri LIKE 'doc://%/%7' THEN 'sensitive' ELSE 'public' END AS sensitivity,
(uri LIKE 'doc://src1%/%')::INT + (uri LIKE 'doc://%/%7')::INT + (uri LIKE 'doc://src12/%')::INT + (uri LIKE 'doc://src_/1%')::INT AS n_rules
FROM (SELECT doc_id, 'doc://' || source || '/' || doc_id AS uri FROM documents)""")
def source_fact_rules(spark, sf_dir):
    """Of the rules that match, the last that sets a fact decides it."""
    docs = tables.document_nodes(spark, sf_dir).select("doc_id", "uri")
    return rules.apply_rules(docs, RULES, {"trust_domain": "retrieved_document", "sensitivity": "public"}).select("doc_id", "trust_domain", "sensitivity", F.size("matched_globs").alias("n_rules"))


_RECORD = """'{"content":' || to_json(text) || ',"created_at":null,"instruction_authority":"none","kind":"document","metadata":{"lang":' || to_json(lang) || '},"node_id":"' || doc_id || '","provenance":{"end_line":null,"start_line":null,"uri":"doc://' || source || '/' || doc_id || '"},"sensitivity":"internal","transformations":[],"trust_domain":"' || CASE WHEN source LIKE 'src1%' THEN 'external_content' ELSE 'retrieved_document' END || '"}'"""


def _record():
    null = F.lit(None)
    provenance = F.struct(null.cast("int").alias("end_line"), null.cast("int").alias("start_line"), F.col("uri").alias("uri"))
    return render.structured_record(
        content=F.col("content"), created_at=null.cast("string"), instruction_authority=F.col("instruction_authority"), kind=F.col("kind"), metadata=F.struct("lang"), node_id=F.col("doc_id").cast("string"),
        provenance=provenance, sensitivity=F.lit("internal"), transformations=F.array().cast("array<string>"), trust_domain=F.col("trust_domain"),
    )


@query(f"WITH r AS (SELECT doc_id, {_RECORD} AS text FROM documents) SELECT doc_id AS node_id, sha256(text) AS record_sha256, {TOKENS_SQL} AS record_tokens FROM r")
def structured_records(spark, sf_dir):
    """Each document as the canonical JSON of a record, with the tokens that it costs in that form."""
    record = tables.document_nodes(spark, sf_dir).select(F.col("doc_id").alias("node_id"), _record().alias("record"))
    return record.select("node_id", F.sha2("record", 256).alias("record_sha256"), tx.token_count(F.col("record")).alias("record_tokens"))


@query("""SELECT doc_id AS node_id, 'sha256:' || sha256('{"content":' || to_json(text) || ',"kind":"document","node_schema_version":2,"source":{"end_line":null,"revision":null,"start_line":null,"uri":"doc://' || source || '/' || doc_id || '"}}') AS semantic_hash FROM documents""")
def semantic_hashes(spark, sf_dir):
    null = F.lit(None)
    source = F.struct(null.cast("int").alias("end_line"), null.cast("string").alias("revision"), null.cast("int").alias("start_line"), F.col("uri").alias("uri"))
    return tables.document_nodes(spark, sf_dir).select(F.col("doc_id").alias("node_id"), tx.semantic_hash(F.struct("content", "kind", F.lit(2).alias("node_schema_version"), source.alias("source"))).alias("semantic_hash"))


@query(f"SELECT doc_id AS node_id, round({_RELEVANCE}, 6) AS relevance, 1.0::DOUBLE AS trust, round({_RELEVANCE} + 0.2, 6) AS value FROM documents")
def smoke_analysis(spark, sf_dir):
    """The quick analysis: relevance, and full trust for all."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), tx.relevance(F.col("text"), TERMS).alias("relevance"), F.lit(1.0).alias("trust"))
    return rows.select("node_id", F.round("relevance", 6).alias("relevance"), "trust", F.round(tx.base_value(relevance=F.col("relevance"), trust=F.col("trust")), 6).alias("value"))
