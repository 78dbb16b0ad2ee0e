"""Source-fact rules: ordered globs that set trust and sensitivity; the last match that sets a fact wins."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules may lower trust and raise sensitivity, never the reverse, and grant no authority.
ALLOWED = {
    "trust_domain": {"local_repository", "retrieved_document", "unverified_tool", "external_content"},
    "sensitivity": {"internal", "sensitive", "secret"},
    "instruction_authority": {"none"},
}


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression; '*' also crosses '/', and case counts."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def validate(rules: list[dict[str, str]]) -> None:
    for rule in rules:
        if not rule.get("glob"):
            raise ValueError("a rule needs a glob")
        for name, value in rule.items():
            if name != "glob" and value not in ALLOWED.get(name, ()):
                raise ValueError(f"a rule may not set {name} to {value}")


def read_rules(text: str, table: str = "source_rules") -> list[dict[str, str]]:
    """The rules of a TOML text, in order: an array of tables that hold texts, a glob and facts only. A text without that array has none."""
    found = tomllib.loads(text).get(table, [])
    if not isinstance(found, list):
        raise ValueError(f"{table} must be an array of tables")
    for k, rule in enumerate(found):
        if not isinstance(rule, dict):
            raise ValueError(f"{table}[{k}] must be a table")
        if unknown := sorted(set(rule) - {"glob", *ALLOWED}):
            raise ValueError(f"{table}[{k}] has unknown keys: {', '.join(unknown)}")
        if wrong := sorted(name for name, value in rule.items() if not isinstance(value, str)):
            raise ValueError(f"{table}[{k}] must hold texts: {', '.join(wrong)}")
    validate(found)
    return found


def apply_rules(nodes: DataFrame, rules: list[dict[str, str]], defaults: dict[str, str]) -> DataFrame:
    """nodes (with uri) and a column for each fact of defaults, plus matched_globs in rule order."""
    validate(rules)
    match = {k: F.col("uri").rlike(glob_regex(rule["glob"])) for k, rule in enumerate(rules)}
    out = nodes.withColumn("matched_globs", F.array_compact(F.array(*[F.when(match[k], F.lit(rule["glob"])) for k, rule in enumerate(rules)])))
    for fact, default in defaults.items():
        setting = [F.when(match[k], F.lit(rule[fact])) for k, rule in reversed(list(enumerate(rules))) if fact in rule]
        out = out.withColumn(fact, F.coalesce(*setting, F.lit(default)))
    return out
