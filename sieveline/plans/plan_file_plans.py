"""Plans as JSON texts made of conversations: each turn is a call that is bound to the one before. Some are no JSON or no object, lack the
version, have no list of calls, calls without an id, or bindings of no known form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.queries import query
from sieveline.sources import plan_files
from sieveline.store import read_table, stored


def texts(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", place.alias("place"))
    bindings = F.struct(F.concat(F.lit("resource:"), F.col("role")).alias("who"), F.when(F.col("place") > 0, F.concat(F.lit("call:c"), (F.col("place") - 1).cast("string"), F.lit(".text"))).alias("prev"), F.when(F.length("text") % 5 == 0, F.lit("nonsense")).alias("bad"))
    call = F.to_json(F.struct(F.when((F.col("conv_id") + F.col("place")) % 7 != 0, F.concat(F.lit("c"), F.col("place").cast("string"))).alias("call_id"), F.col("role").alias("tool_id"), bindings.alias("input_bindings")))
    calls = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", call.alias("json")))), lambda x: x["json"]), ","), F.lit("]"))
    kind = F.col("conv_id") % 10
    version = F.when(kind == 2, F.lit("")).otherwise('"schema_version":{"major":1,"minor":0},')
    body = F.concat(F.lit("{"), version, F.lit('"plan_id":"p'), F.col("conv_id").cast("string"), F.lit('","calls":'), F.when(kind == 3, F.lit('"none"')).otherwise(F.col("calls")), F.lit("}"))
    plans = turns.groupBy("conv_id").agg(calls.alias("calls"))
    return plans.select(F.col("conv_id").alias("file"), F.when(kind == 0, F.lit("{")).when(kind == 1, F.lit("[]")).otherwise(body).alias("text"))


_CALLS = """t AS MATERIALIZED (SELECT conv_id AS file, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS place FROM conversations),
c AS MATERIALIZED (SELECT *, (file + place) % 7 <> 0 AS named FROM t WHERE file % 10 NOT IN (0, 1, 3))"""


@query(f"""WITH {_CALLS}, e AS (SELECT DISTINCT file, NULL::INT AS place, NULL AS input_name, CASE file % 10 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'no_schema_version' ELSE 'calls_not_a_list' END AS code FROM t WHERE file % 10 < 4
UNION ALL SELECT file, place, NULL, 'call_id' FROM c WHERE NOT named UNION ALL SELECT file, place, 'bad', 'binding' FROM c WHERE length(text) % 5 = 0) SELECT file, place::INT AS place, input_name, code FROM e""")
def plan_errors(spark, sf_dir):
    """Every structural error of every plan."""
    return plan_files.scan(texts(spark, sf_dir)).errors


@query(f"""WITH {_CALLS} SELECT file, place::INT AS place, CASE WHEN named THEN 'c' || place ELSE '<invalid-call-' || place || '>' END AS call_id, 'who' AS input_name, 'resource' AS kind, role AS resource_id, NULL AS source_call, NULL AS output_name FROM c
UNION ALL SELECT file, place::INT, CASE WHEN named THEN 'c' || place ELSE '<invalid-call-' || place || '>' END, 'prev', 'call_output', NULL, 'c' || (place - 1), 'text' FROM c WHERE place > 0""")
def plan_bindings(spark, sf_dir):
    """The bindings of every call, by kind."""
    return plan_files.scan(texts(spark, sf_dir)).bindings


@query(f"""WITH {_CALLS} SELECT file, place::INT AS place, NULL AS input_name, 'unknown_tool' AS code FROM c WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT file, place::INT, 'who', 'unknown_resource' FROM c WHERE role <> 'user'
UNION ALL SELECT a.file, a.place::INT, 'prev', 'unknown_call' FROM c a JOIN c b ON b.file = a.file AND b.place = a.place - 1 WHERE NOT b.named""")
def plan_references(spark, sf_dir):
    """Unknown tools and resources, and bindings to calls that the plan doesn't have: only users are declared as resources, system turns as no tool."""
    plans = plan_files.scan(stored(texts(spark, sf_dir)))
    names = read_table(spark, sf_dir, "conversations").select("role").distinct()
    return plan_files.reference_errors(plans, names.where(F.col("role").isin("user", "assistant")).select(F.col("role").alias("tool_id")), names.where("role = 'user'").select(F.col("role").alias("resource_id")))
