"""Repository files as nodes: discovery, skip reasons, kinds, and Python modules split into their top-level definitions."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1_000_000
NODE = "node_id string, kind string, symbol string, uri string, start_line int, end_line int, content string, content_hash string, parse_status string, imports array<string>, calls array<string>"


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def skip_code(content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file gives no node: too large, binary, not UTF-8; null if it does."""
    raw = content.cast("binary")
    decoded = F.try_validate_utf8(raw.cast("string")) if hasattr(F, "try_validate_utf8") else raw.cast("string")
    return F.when(F.octet_length(raw) > max_bytes, "CTX002").when(F.position(F.lit("\u0000"), raw.cast("string")) > 0, "CTX001").when(decoded.isNull(), "CTX004")


def node_kind(path: Column, documents: tuple[str, ...] = ("md", "rst", "txt")) -> Column:
    return F.when(path.rlike(r"\.(" + "|".join(documents) + ")$"), "document").when(path.rlike(r"\.py$"), "module").otherwise("file")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def node_id(uri: str, kind: str, start: int, end: int, content: str, revision: str | None = None) -> str:
    source = {"uri": uri, "revision": revision, "start_line": start, "end_line": end}
    payload = {"source": source, "kind": kind, "content": content, "node_schema_version": 2}
    return "node-" + hashlib.sha256(canonical_json(payload).encode()).hexdigest()[:24]


def discover(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """path (relative), content of all files below root, whatever store it is in."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z0-9]+:/*", "/", root).rstrip("/")
    path = F.regexp_replace("path", f"^[a-z0-9]+:/*.*?{re.escape(base)}/", "")
    rows = found.select(path.alias("path"), "content", "length")
    return rows if include_hidden else rows.where(~is_hidden(F.col("path")))


def _row(uri: str, kind: str, symbol: str | None, start: int, end: int, content: str, status: str | None, imports=(), calls=()) -> tuple:
    return (node_id(uri, kind, start, end, content), kind, symbol, uri, start, end, content, "sha256:" + hashlib.sha256(content.encode()).hexdigest(), status, list(imports), list(calls))


def split_python(path: str, text: str) -> Iterator[tuple]:
    """The module, then each top-level function and class with its lines; a module alone where the source doesn't parse."""
    uri, lines = f"repo:///{path}", text.splitlines()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield _row(uri, "module", None, 1, max(1, len(lines)), text, "syntax_error_fallback")
        return
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module})
    yield _row(uri, "module", None, 1, max(1, len(lines)), text, "parsed", imports)
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            calls = sorted({n.func.id for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}) if kind == "function" else []
            yield _row(uri, kind, node.name, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), "parsed", (), calls)


def parse(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Nodes, and diagnostics (code, path) of the files that are skipped."""
    coded = files.withColumn("code", skip_code(F.col("content"), max_bytes))
    rows = coded.where("code IS NULL").select("path", F.replace(F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("text"), node_kind(F.col("path")).alias("kind"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in NODE.split(", ")]
        for batch in batches:
            out = []
            for path, text, kind in batch.itertuples(index=False):
                out += split_python(path, text) if kind == "module" else [_row(f"repo:///{path}", kind, None, 1, max(1, len(text.splitlines())), text, None)]
            yield pd.DataFrame(out, columns=names)

    broken = F.col("parse_status") == "syntax_error_fallback"
    nodes = rows.mapInPandas(split, NODE)
    diagnostics = coded.where("code IS NOT NULL").select("code", "path").unionAll(nodes.where(broken).select(F.lit("CTX003"), F.regexp_replace("uri", "^repo:///", "")))
    return nodes, diagnostics


def code_edges(nodes: DataFrame) -> DataFrame:
    """Imports (by exact module name), definitions (same file) and calls (all definitions of the name, not itself)."""
    from sieveline.functions.text import module_name

    modules = nodes.where("kind = 'module'").select("node_id", "uri", module_name(F.regexp_replace("uri", "^repo:///", "")).alias("name"), "imports")
    owned = nodes.where("kind IN ('function', 'class')")
    imports = modules.select(F.col("node_id").alias("src"), F.explode("imports").alias("name")).join(modules.select("name", F.col("node_id").alias("dst")), "name").select("src", "dst", F.lit("imports").alias("edge_type"))
    defines = modules.select(F.col("node_id").alias("src"), "uri").join(owned.select("uri", F.col("node_id").alias("dst")), "uri").select("src", "dst", F.lit("defines").alias("edge_type"))
    callers = nodes.where("kind = 'function'").select(F.col("node_id").alias("src"), F.explode("calls").alias("symbol"))
    calls = callers.join(owned.select("symbol", F.col("node_id").alias("dst")), "symbol").select("src", "dst", F.lit("calls").alias("edge_type"))
    return imports.unionAll(defines).unionAll(calls).where("src <> dst").distinct()
