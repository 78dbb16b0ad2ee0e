r"""Column functions on text: newline normalisation, hashes, token counts, relevance, freshness, names and spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern of the generic tokenizer (Unicode classes) and of task terms.
TOKEN = r"(?U)\w+|[^\w\s]"
TERM = r"[A-Za-z0-9_]+"
#: The places at which a text breaks into lines.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(normalize_newlines(text), 256))


def canonical_json(value: Column) -> Column:
    """Compact JSON of a struct, whose fields are to be in the order of their names; nulls are written."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def semantic_hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(value), 256))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_ids(text: Column) -> Column:
    """The first eight bytes of each token's SHA-256 as an unsigned number (decimal digits, as it may exceed a long)."""
    return F.transform(tokens(text), lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, 10))


def line_count(text: Column) -> Column:
    parts = F.split(text, LINE_BREAK, -1)
    return F.greatest(F.lit(1), F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def terms(text: str) -> list[str]:
    """The lower-case terms of a task; duplicates stay."""
    import re

    return [t.lower() for t in re.findall(TERM, text)]


def relevance(content: Column, task_terms: list[str]) -> Column:
    """The share of task terms, duplicates included, that are substrings of the lower-case content."""
    low = F.lower(content)
    hits = reduce(lambda a, b: a + b, (F.contains(low, F.lit(t)).cast("int") for t in task_terms), F.lit(0))
    return hits / F.lit(float(max(1, len(task_terms))))


def relevance_by_terms(content: Column, task_terms: Column) -> Column:
    """The same with the terms in an array column."""
    low = F.lower(content)
    hits = F.size(F.filter(task_terms, lambda t: F.contains(low, t)))
    return hits / F.greatest(F.lit(1), F.size(task_terms)).cast("double")


def freshness(created_at: Column, anchor: Column) -> Column:
    """1 / (1 + age in days); ages below zero count as zero, no time as no freshness."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(anchor) - F.unix_micros(created_at.cast("timestamp"))) / F.lit(1e6)) / F.lit(86400.0)
    return F.when(created_at.isNull() | anchor.isNull(), F.lit(0.0)).otherwise(1 / (1 + age))  # greatest() passes over nulls


#: The weights of a node's base value.
WEIGHTS = {"relevance": 1.0, "trust": 0.2, "freshness": 0.2, "redundancy": -0.2, "risk": -0.5}
DEPENDENCY_WEIGHT = 0.1


def base_value(**parts: Column) -> Column:
    return F.round(reduce(lambda a, b: a + b, (value * F.lit(WEIGHTS[name]) for name, value in parts.items())), 12)


def analysis(content: Column, task_terms: Column, created_at: Column, anchor: Column) -> dict[str, Column]:
    """What is found out of a node before selection. Trust, risk and redundancy have weights, but nothing measures them: they are zero."""
    nothing = F.lit(0.0)
    return {"relevance": relevance_by_terms(content, task_terms), "freshness": freshness(created_at, anchor), "token_count": token_count(content), "trust": nothing, "risk": nothing, "redundancy": nothing}


def module_name(path: Column) -> Column:
    """A source path as a dotted name, without the suffix of a package's own file."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def canonical_path(path: Column) -> Column:
    """A repository path with '.' and '//' collapsed; null where it holds spaces, '%', '\\', a query, a fragment or '..'."""
    bad = path.rlike(r"[\s%\\?#]") | path.rlike(r"(^|/)\.\.(/|$)")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(~bad, F.concat(F.lit("/"), F.array_join(parts, "/")))


def overlap_lines(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2) + 1)
