"""Strict decoding of JSON: typed outcomes instead of silent nulls, and files whose comments are taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strict(rows: DataFrame, column: str, fields: dict[str, str], versions: tuple[str, ...], version_field: str = "schema_version") -> DataFrame:
    """rows, decoded (null unless sound) and outcome: ok, or the first that holds of not_an_object, unknown_field, missing_field,
    wrong_type, unsupported_version."""
    names = F.array(*map(F.lit, fields))
    keys = F.json_object_keys(F.col(column))
    decoded = F.from_json(F.col(column), ", ".join(f"`{n}` {t}" for n, t in fields.items()))
    raw = lambda name: F.get_json_object(F.col(column), f"$.{name}")
    none = F.lit(False)
    wrong = none
    for name in fields:
        wrong = wrong | (raw(name).isNotNull() & F.col("decoded")[name].isNull())
    outcome = F.when(keys.isNull(), "not_an_object").when(F.size(F.array_except(keys, names)) > 0, "unknown_field").when(F.size(F.array_except(names, keys)) > 0, "missing_field").when(wrong, "wrong_type").when(~F.col("decoded")[version_field].isin(*versions), "unsupported_version").otherwise("ok")
    told = rows.withColumn("decoded", decoded).withColumn("outcome", outcome)
    return told.withColumn("decoded", F.when(F.col("outcome") == "ok", F.col("decoded")))


def without_comments(text: Column) -> Column:
    """Whole lines that begin with # or // go; others stay, whatever they hold."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^\s*(#|//)")), "\n")


def read_commented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file with comment lines, one a file; what doesn't parse is an error."""
    text = spark.read.text(path, wholetext=True).select(without_comments(F.col("value")).alias("raw"))
    return text.select(F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
