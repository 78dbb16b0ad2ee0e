"""Capability flows over the events: a user's events are the calls of a plan, their types the tools, each call feeds the next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline.operators import capabilities as cp
from sieveline.operators import execution
from sieveline.operators import incremental as inc
from sieveline.queries import query
from sieveline.store import read_table, stored

TOOLS = [
    ("view", "events", "local_repository", ["file_read", "credential_access"], ["secrets"], [], "public"),
    ("signup", "events", "local_repository", ["database_read"], ["profile"], ["mailbox", "orders"], "internal"),
    ("error", "events", "unverified_tool", ["code_execute"], ["log"], [], "public"),
    ("click", "events", "local_repository", ["network_send"], [], [], "public"),
    ("purchase", "events", "local_repository", ["external_write"], ["orders"], ["orders"], "public"),
]
TOOL = "tool_id string, server_id string, trust_domain string, capabilities array<string>, resources_read array<string>, resources_written array<string>, output_sensitivity string"
RESOURCES = [
    ("secrets", "credential", "internal", "local_repository", ["external"]),
    ("profile", "user_data", "sensitive", "local_repository", ["external"]),
    ("log", "file", "public", "unverified_tool", []),
    ("orders", "database", "sensitive", "local_repository", ["external"]),
    ("mailbox", "message_store", "internal", "local_repository", []),
]
_CALLS = "c AS MATERIALIZED (SELECT user_id AS plan_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS ordinal FROM events)"
_READ = "CASE {0}.event_type WHEN 'view' THEN 'secrets' WHEN 'signup' THEN 'profile' WHEN 'error' THEN 'log' WHEN 'purchase' THEN 'orders' END"
_SINK = "CASE {0}.event_type WHEN 'click' THEN 'network' WHEN 'purchase' THEN 'external' WHEN 'error' THEN 'execution' WHEN 'signup' THEN 'message' END"
_FLOWS = f"""{_CALLS}, w AS (SELECT plan_id, ordinal, event_type, {_READ.format('c')} AS source_id, 0 AS later FROM c UNION ALL SELECT plan_id, ordinal, event_type, 'tool-output://events/' || event_type || '/' || event_id, 1 FROM c UNION ALL SELECT plan_id, ordinal, event_type, 'capability://' || event_id || '/credential_access', 1 FROM c WHERE event_type = 'view'),
p AS (SELECT a.plan_id, a.source_id, {_SINK.format('b')} AS sink, a.ordinal AS i, b.ordinal AS j FROM w a JOIN c b ON b.plan_id = a.plan_id AND b.ordinal BETWEEN a.ordinal + a.later AND a.ordinal + 7 WHERE a.source_id IS NOT NULL),
r AS (SELECT *, 'sensitive_to_external' AS risk FROM p WHERE (source_id IN ('profile', 'orders') AND sink IN ('network', 'message')) OR (source_id LIKE 'capability:%' AND sink IN ('network', 'message', 'external'))
UNION ALL SELECT *, 'untrusted_to_execution' FROM p WHERE (source_id = 'log' OR source_id LIKE 'tool-output://events/error/%') AND sink = 'execution' UNION ALL SELECT *, 'credential_to_network' FROM p WHERE (source_id = 'secrets' OR source_id LIKE 'capability:%') AND sink = 'network' AND j > i),
f AS MATERIALIZED (SELECT *, 'sha256:' || sha256(plan_id || '|' || risk || '|' || source_id || '|' || array_to_string(range(i, j + 1), ',') || '|' || sink) AS flow_id,
CASE WHEN risk = 'credential_to_network' THEN 'block' ELSE 'require_explicit_approval' END AS action, row_number() OVER (PARTITION BY plan_id ORDER BY risk, source_id, i, j, sink) AS flow FROM r QUALIFY flow <= 64)"""


def inputs(spark, sf_dir):
    tools = stored(spark.createDataFrame(TOOLS, TOOL).coalesce(1))
    resources = stored(spark.createDataFrame(RESOURCES, "resource_id string, kind string, sensitivity string, trust_domain string, allowed_sinks array<string>").coalesce(1))
    order = Window.partitionBy("plan_id").orderBy("ts", "call_id")
    events = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("call_id"), F.col("event_type").alias("tool_id"), "ts")
    calls = events.select("plan_id", F.row_number().over(order).alias("ordinal"), "call_id", "tool_id")
    bindings = calls.where("ordinal > 1 AND tool_id IS NOT NULL").select("plan_id", (F.col("ordinal") - 1).alias("from_ordinal"), F.col("ordinal").alias("to_ordinal"))
    return calls, bindings, tools, resources


def decided_flows(spark, sf_dir):
    calls, bindings, tools, resources = inputs(spark, sf_dir)
    return cp.decide(cp.plan_flows(calls, bindings, tools, resources))


@query(f"WITH {_FLOWS} SELECT plan_id, risk, source_id, sink, flow_id, flow::INT AS flow FROM f")
def capability_flows(spark, sf_dir):
    return decided_flows(spark, sf_dir).select("plan_id", "risk", "source_id", "sink", "flow_id", "flow")


@query(f"WITH {_FLOWS} SELECT risk, sink, action, count(*) AS n_flows, count(DISTINCT plan_id) AS n_plans FROM f GROUP BY ALL")
def policy_decisions(spark, sf_dir):
    return decided_flows(spark, sf_dir).groupBy("risk", "sink", "action").agg(F.count(F.lit(1)).alias("n_flows"), F.count_distinct("plan_id").alias("n_plans"))


_APPROVALS = """g AS (SELECT plan_id, CASE WHEN flow % 9 = 8 THEN flow_id || 'x' ELSE flow_id END AS flow_id, CASE WHEN flow % 4 = 2 AND plan_id % 3 = 0 THEN 'external_content' ELSE 'user_instruction' END AS approver_domain, flow % 6 <> 5 AS approved FROM f WHERE plan_id % 2 = 0 AND action <> 'block')"""
_STATUS = f"""{_FLOWS}, {_APPROVALS}, ok AS (SELECT DISTINCT plan_id, flow_id FROM g WHERE approved AND approver_domain = 'user_instruction'),
s AS (SELECT f.*, CASE WHEN action = 'block' THEN 'blocked' WHEN ok.flow_id IS NOT NULL THEN 'approved' ELSE 'pending' END AS status FROM f LEFT JOIN ok USING (plan_id, flow_id))"""


def approvals_for(decided):
    """Half of the plans have approvals: some for another flow, some by an untrusted approver, some refused."""
    # one condition, that Spark can't take apart: all that reads the flows then reads the same ones
    rows = decided.where("CASE WHEN plan_id % 2 = 0 THEN action <> 'block' END")
    return rows.select("plan_id", F.when(F.col("flow") % 9 == 8, F.concat("flow_id", F.lit("x"))).otherwise(F.col("flow_id")).alias("flow_id"), F.when((F.col("flow") % 4 == 2) & (F.col("plan_id") % 3 == 0), "external_content").otherwise("user_instruction").alias("approver_domain"), (F.col("flow") % 6 != 5).alias("approved"))


@query(f"WITH {_STATUS} SELECT plan_id, status, count(*) AS n_flows FROM s GROUP BY ALL")
def approval_match(spark, sf_dir):
    decided = decided_flows(spark, sf_dir)
    return cp.approve(decided, approvals_for(decided)).groupBy("plan_id", "status").agg(F.count(F.lit(1)).alias("n_flows"))


@query(f"""WITH {_STATUS}, b AS (SELECT plan_id, count(*) AS n_invalid FROM g WHERE NOT approved OR approver_domain <> 'user_instruction' OR flow_id NOT IN (SELECT flow_id FROM f) GROUP BY plan_id),
k AS (SELECT plan_id, count(*) FILTER (status = 'approved') AS n_approved, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'blocked') AS n_blocked FROM s GROUP BY plan_id)
SELECT plan_id, coalesce(n_approved, 0) AS n_approved, coalesce(n_pending, 0) AS n_pending, coalesce(n_blocked, 0) AS n_blocked, coalesce(n_invalid, 0) AS n_invalid, coalesce(n_blocked, 0) > 0 OR coalesce(n_invalid, 0) > 0 AS is_blocked
FROM (SELECT DISTINCT plan_id FROM c) LEFT JOIN k USING (plan_id) LEFT JOIN b USING (plan_id)""")
def capability_manifest(spark, sf_dir):
    calls, *_ = inputs(spark, sf_dir)
    decided = decided_flows(spark, sf_dir)
    approvals = approvals_for(decided)
    return cp.manifest(calls, cp.approve(decided, approvals), cp.invalid_approvals(decided, approvals))


_DECLARED = "CASE event_type WHEN 'view' THEN ['file_read'] WHEN 'signup' THEN ['database_read'] WHEN 'error' THEN ['code_execute'] WHEN 'click' THEN ['network_send'] ELSE ['external_write'] END"
_OBSERVED = f"CASE event_id % 11 WHEN 3 THEN NULL WHEN 5 THEN [] WHEN 7 THEN list_append({_DECLARED}, 'shell_execute') ELSE {_DECLARED} END"
_SEEN = f"{_CALLS}, q AS (SELECT *, CASE WHEN o IS NULL THEN 'unknown' WHEN len(list_filter(o, lambda x: NOT list_contains(d, x))) > 0 THEN 'observed_mismatch' WHEN len(list_filter(d, lambda x: NOT list_contains(o, x))) > 0 THEN 'declared_but_unobserved' ELSE 'observed_match' END AS status FROM (SELECT *, {_DECLARED} AS d, {_OBSERVED} AS o FROM c))"


def observations(spark, sf_dir):
    calls, _, tools, _ = inputs(spark, sf_dir)
    rows = calls.join(tools.select("tool_id", F.col("capabilities").alias("declared")), "tool_id")
    kind = F.col("call_id") % 11
    observed = F.when(kind == 3, F.lit(None)).when(kind == 5, F.array().cast("array<string>")).when(kind == 7, F.array_append("declared", F.lit("shell_execute"))).otherwise(F.col("declared"))
    return rows.select("plan_id", "ordinal", "tool_id", cp.correspondence(F.col("declared"), observed).alias("status"))


@query(f"WITH {_SEEN} SELECT event_type AS tool_id, status, count(*) AS n_calls FROM q GROUP BY ALL")
def correspondence_status(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("tool_id", "status").agg(F.count(F.lit(1)).alias("n_calls"))


@query(f"WITH {_SEEN}, m AS (SELECT plan_id, min(ordinal) AS drift_at FROM q WHERE status = 'observed_mismatch' GROUP BY plan_id) SELECT plan_id, count(*) FILTER (drift_at IS NULL OR ordinal <= drift_at) AS n_invoked, count(*) FILTER (ordinal > drift_at) AS n_stopped FROM q LEFT JOIN m USING (plan_id) GROUP BY plan_id")
def execution_replay(spark, sf_dir):
    done = cp.replay(observations(spark, sf_dir))
    return done.groupBy("plan_id").agg(F.count_if("invoked").alias("n_invoked"), F.count_if(~F.col("invoked")).alias("n_stopped"))


@query(f"""WITH {_STATUS}, {_SEEN.split(', q AS')[0].replace('c AS MATERIALIZED', 'c2 AS MATERIALIZED')}, q AS{_SEEN.split(', q AS')[1].replace('FROM c)', 'FROM c2)')},
k AS (SELECT plan_id, bool_or(status = 'blocked') AS b, bool_or(status = 'pending') AS p FROM s GROUP BY plan_id), m AS (SELECT plan_id, bool_or(status = 'observed_mismatch') AS d FROM q GROUP BY plan_id)
SELECT plan_id, CASE WHEN d OR coalesce(b, false) THEN 'block' WHEN coalesce(p, false) THEN 'require_approval' ELSE 'allow' END AS decision FROM m LEFT JOIN k USING (plan_id)""")
def execution_gate(spark, sf_dir):
    """Drift or a blocked flow blocks a plan, a pending flow asks for approval."""
    decided = decided_flows(spark, sf_dir)
    flows = cp.approve(decided, approvals_for(decided)).groupBy("plan_id").agg(F.bool_or(F.col("status") == "blocked").alias("b"), F.bool_or(F.col("status") == "pending").alias("p"))
    drift = observations(spark, sf_dir).groupBy("plan_id").agg(F.bool_or(F.col("status") == "observed_mismatch").alias("d"))
    choice = F.when(F.col("d") | F.coalesce("b", F.lit(False)), "block").when(F.coalesce("p", F.lit(False)), "require_approval").otherwise("allow")
    return drift.join(flows, "plan_id", "left").select("plan_id", choice.alias("decision"))


@query(f"""WITH {_CALLS}, k AS (SELECT c.*, c.event_id - json_extract(e.props, '$.k')::BIGINT AS ref FROM c JOIN events e USING (event_id))
SELECT CASE WHEN r.event_id IS NULL THEN 'unknown_call' WHEN r.plan_id <> k.plan_id THEN 'other_plan' WHEN r.ordinal >= k.ordinal THEN 'forward_binding' ELSE 'valid' END AS outcome, count(*) AS n_bindings FROM k LEFT JOIN c r ON r.event_id = k.ref GROUP BY 1""")
def plan_validation(spark, sf_dir):
    """A call binds to the output of the call whose id lies as far back as its properties say."""
    calls, *_ = inputs(spark, sf_dir)
    props = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), (F.col("event_id") - F.get_json_object("props", "$.k").cast("long")).alias("ref"))
    other = calls.select(F.col("call_id").alias("ref"), F.col("plan_id").alias("r_plan"), F.col("ordinal").alias("r_ordinal"))
    joined = calls.join(props, "call_id").join(other, "ref", "left")
    outcome = F.when(F.col("r_plan").isNull(), "unknown_call").when(F.col("r_plan") != F.col("plan_id"), "other_plan").when(F.col("r_ordinal") >= F.col("ordinal"), "forward_binding").otherwise("valid")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n_bindings"))


@query("""SELECT p_partkey AS tool_id, count(DISTINCT l_suppkey) AS n_undeclared FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def undeclared_resources(spark, sf_dir):
    """Parts as tools that read suppliers; those in debt are not declared."""
    declared = read_table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    reads = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(declared, "l_suppkey", "left_anti")
    return reads.groupBy(F.col("l_partkey").alias("tool_id")).agg(F.count(F.lit(1)).alias("n_undeclared"))


@query(f"""WITH {_CALLS}, g AS (SELECT plan_id, 'tool:' || event_type AS src, 'call:' || event_id AS dst, 'invoked_as' AS kind FROM c UNION ALL SELECT plan_id, 'call:' || event_id, 'output:' || event_id, 'produces' FROM c
UNION ALL SELECT plan_id, 'output:' || event_id, 'call:' || lead(event_id) OVER (PARTITION BY plan_id ORDER BY ordinal), 'binding:previous' FROM c
UNION ALL SELECT plan_id, 'resource:' || {_READ.format('c')}, 'call:' || event_id, 'declared_read' FROM c WHERE event_type <> 'click'
UNION ALL SELECT plan_id, 'call:' || event_id, 'resource:orders', 'declared_write' FROM c WHERE event_type IN ('signup', 'purchase') UNION ALL SELECT plan_id, 'call:' || event_id, 'resource:mailbox', 'declared_write' FROM c WHERE event_type = 'signup'),
k AS (SELECT plan_id, event_id, unnest(CASE event_type WHEN 'view' THEN ['file_read', 'credential_access'] WHEN 'signup' THEN ['database_read'] WHEN 'error' THEN ['code_execute'] WHEN 'click' THEN ['network_send'] ELSE ['external_write'] END) AS cap FROM c)
SELECT plan_id, kind, count(DISTINCT (src, dst)) AS n_edges, count(DISTINCT src) AS n_sources FROM (FROM g WHERE dst IS NOT NULL UNION ALL SELECT plan_id, 'call:' || event_id, 'capability:' || event_id || ':' || cap, 'declares' FROM k UNION ALL SELECT plan_id, 'capability:' || event_id || ':' || cap, 'output:' || event_id, 'enables' FROM k) GROUP BY ALL""")
def capability_graph(spark, sf_dir):
    """How many edges of each kind a plan's graph has."""
    calls, bindings, tools, resources = inputs(spark, sf_dir)
    edges = cp.capability_graph(calls, bindings.withColumn("input_name", F.lit("previous")), tools, resources)
    return edges.groupBy("plan_id", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_sources"))


@query(f"""WITH {_STATUS}, x AS (SELECT s.*, 0 AS step, 'source' AS what, source_id AS name FROM s UNION ALL SELECT s.*, j - i + 2, 'sink', sink FROM s UNION ALL SELECT s.*, j - i + 3, 'decision', action || ' ' || status FROM s
UNION ALL SELECT s.*, c.ordinal - i + 1, 'call', c.event_id || ' ' || c.event_type FROM s JOIN c ON c.plan_id = s.plan_id AND c.ordinal BETWEEN s.i AND s.j) SELECT plan_id, flow_id, step::INT AS step, what, name FROM x""")
def flow_explanations(spark, sf_dir):
    """Every decided flow step by step: source, calls, sink, decision."""
    decided = decided_flows(spark, sf_dir)
    calls, *_ = inputs(spark, sf_dir)
    return cp.explain_flows(cp.approve(decided, approvals_for(decided)), calls)


@query(f"""WITH {_STATUS}, {_SEEN.split(', q AS')[0].replace('c AS MATERIALIZED', 'c2 AS MATERIALIZED')}, q AS{_SEEN.split(', q AS')[1].replace('FROM c)', 'FROM c2)')},
m AS (SELECT plan_id, min(ordinal) AS drift_at FROM q WHERE status = 'observed_mismatch' GROUP BY plan_id)
SELECT s.plan_id, s.status, drift_at IS NULL OR j <= drift_at AS sink_invoked, count(*) AS n_flows FROM s LEFT JOIN m ON m.plan_id = s.plan_id GROUP BY ALL""")
def live_explanations(spark, sf_dir):
    """From stored evidence alone: of which risky flows the sink was reached before drift stopped the plan."""
    decided = decided_flows(spark, sf_dir)
    invoked = cp.replay(observations(spark, sf_dir)).where("invoked")
    told = cp.explain_live(cp.approve(decided, approvals_for(decided)), invoked)
    return told.groupBy("plan_id", "status", "sink_invoked").agg(F.count(F.lit(1)).alias("n_flows"))


@query("""SELECT event_id AS call_id, 'm10b-' || substr(sha256('{"arguments":"' || (value > 100) || '","call_id":"' || event_id || '","plan_id":"' || user_id || '","server_id":"events","tool_id":"' || event_type || '","version":"1"}'), 1, 24) AS interaction_id,
'sha256:' || sha256(props) AS content_hash, octet_length(props::BLOB) AS content_bytes, contains(props, '"k": 7') AS seven, contains(props, '99') AS late FROM events""")
def observation_records(spark, sf_dir):
    """Events as recorded tool results."""
    rows = read_table(spark, sf_dir, "events").select(F.lit("events").alias("server_id"), F.col("event_type").alias("tool_id"), F.col("user_id").alias("plan_id"), F.col("event_id").alias("call_id"), (F.col("value") > 100).alias("arguments"), F.col("props").alias("text"), F.lit("1").alias("version"))
    return cp.observed(rows, {"seven": '"k": 7', "late": "99"}).drop("plan_id", "source_uri")


@query("""SELECT 'p' || p_partkey AS tool_id, 'CTX444' AS code, unnest(list_filter([CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'allows_execution' END, CASE WHEN p_size % 5 = 0 THEN 'allows_network' END, CASE WHEN p_size % 7 = 0 AND p_size % 2 = 1 THEN 'allows_external_write' END], lambda x: x IS NOT NULL)) AS flag FROM part""")
def flag_contradictions(spark, sf_dir):
    """Parts as tools, whose sizes tell capabilities and what their flags deny."""
    size = F.col("p_size")
    tools = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("tool_id"), F.when(size % 2 == 0, F.array(F.lit("code_execute"), F.lit("network_send"))).otherwise(F.array(F.lit("message_send"), F.lit("network_send"))).alias("capabilities"),
        (size % 3 != 0).alias("allows_execution"), (size % 5 != 0).alias("allows_network"), F.when(size % 7 == 0, F.lit(False)).alias("allows_external_write"),
    )
    return cp.contradictions(tools)


@query("SELECT user_id % 4 = 0 AS changed, CASE WHEN user_id % 4 = 0 THEN 'recomputed' ELSE 'reused' END AS status, count(DISTINCT user_id) AS n_plans FROM events GROUP BY ALL")
def capability_cache(spark, sf_dir):
    """Analyses are kept under the hash of the plan, the declarations and the limits; every fourth plan has one more call now."""
    calls, *_ = inputs(spark, sf_dir)
    declared = F.lit(repr((TOOLS, RESOURCES, cp.RULES, cp.MAX_LENGTH, cp.MAX_FLOWS)))

    def keys(rows):
        listed = rows.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "call_id", "tool_id"))), lambda c: F.concat_ws(":", c["call_id"].cast("string"), c["tool_id"])), ",").alias("plan"))
        return listed.select("plan_id", F.lit("capability").alias("stage"), inc.stage_key("capability", F.col("plan"), declared).alias("key_identity"))

    more = calls.where("plan_id % 4 = 0 AND ordinal = 1").withColumn("ordinal", F.lit(0))
    reused, fresh = inc.split_by_cache(stored(keys(calls.unionByName(more))), stored(keys(calls)).select("stage", "key_identity"))
    counted = lambda df, status: df.groupBy((F.col("plan_id") % 4 == 0).alias("changed")).agg(F.lit(status).alias("status"), F.count(F.lit(1)).alias("n_plans"))
    return counted(reused, "reused").unionAll(counted(fresh, "recomputed"))


@query("""WITH t AS (SELECT conv_id AS plan_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS place, role, conv_id % 17 = 3 AS whole, length(text) % 7 = 0 AS blocked, length(text) % 11 = 0 AS drift FROM conversations),
d AS (SELECT plan_id, min(place) AS drift_at FROM t WHERE drift AND NOT blocked AND NOT whole GROUP BY plan_id)
SELECT t.plan_id, place, role || place AS call_id, CASE WHEN place > drift_at THEN 'stopped' WHEN whole OR blocked THEN 'blocked' WHEN drift THEN 'drifted' ELSE 'invoked' END AS status FROM t LEFT JOIN d USING (plan_id)""")
def execution_loop(spark, sf_dir):
    """Turns as the calls of a plan: blocked sinks are passed over, a drift stops what comes after it."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    turns = read_table(spark, sf_dir, "conversations").withColumn("place", place.cast("long"))
    return execution.run(turns.select(F.col("conv_id").alias("plan_id"), "place", F.concat("role", F.col("place").cast("string")).alias("call_id"), (F.col("conv_id") % 17 == 3).alias("plan_blocked"), (F.length("text") % 7 == 0).alias("blocked"), (F.length("text") % 11 == 0).alias("drift")))


@query("""WITH t AS (SELECT conv_id AS plan_id, conv_id % 7 AS suite, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS place, role, text, conv_id % 17 = 3 AS whole, length(text) % 7 = 0 AS blocked, length(text) % 11 = 0 AS drift FROM conversations),
d AS (SELECT plan_id, min(place) AS drift_at FROM t WHERE drift AND NOT blocked AND NOT whole GROUP BY plan_id),
r AS (SELECT t.*, role || place AS call_id, CASE WHEN place > drift_at THEN 'stopped' WHEN whole OR blocked THEN 'blocked' WHEN drift THEN 'drifted' ELSE 'invoked' END AS status FROM t LEFT JOIN d USING (plan_id)),
p AS (SELECT suite, plan_id, count(*) FILTER (length(text) % 13 = 0 AND status IN ('invoked', 'drifted')) AS leaks, count(*) FILTER (status = 'invoked') AS i, count(*) FILTER (status = 'drifted') AS d, count(*) FILTER (status = 'blocked') AS b, count(*) FILTER (status = 'stopped') AS s FROM r GROUP BY ALL),
c AS (SELECT suite, count(DISTINCT call_id) FILTER (status = 'blocked') AS n_blocked_calls, count(DISTINCT plan_id || ':' || place) FILTER (role = 'user') AS n_approvals FROM r GROUP BY suite)
SELECT p.suite, count(*) AS n_plans, count(*) FILTER (leaks = 0) AS n_passed, sum(i)::BIGINT AS n_invoked, sum(d)::BIGINT AS n_drifted, sum(b)::BIGINT AS n_blocked, sum(s)::BIGINT AS n_stopped, any_value(n_blocked_calls) AS n_blocked_calls, any_value(n_approvals) AS n_approvals, sum(leaks)::BIGINT AS n_leaks, true AS repeats, true AS tells_changes
FROM p JOIN c USING (suite) GROUP BY p.suite""")
def suite_rollup(spark, sf_dir):
    """Conversations as plans in seven suites. The identity must repeat from rows in another order and partitioning, and differ where one status does."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    turns = stored(read_table(spark, sf_dir, "conversations").withColumn("place", place.cast("long")))
    calls = turns.select(F.col("conv_id").alias("plan_id"), "place", F.concat("role", F.col("place").cast("string")).alias("call_id"), (F.col("conv_id") % 17 == 3).alias("plan_blocked"), (F.length("text") % 7 == 0).alias("blocked"), (F.length("text") % 11 == 0).alias("drift"))
    leaks = turns.select(F.col("conv_id").alias("plan_id"), "place", (F.length("text") % 13 == 0).alias("leaked"))
    ran = stored(execution.run(calls).join(leaks, ["plan_id", "place"]).withColumn("suite", F.col("plan_id") % 7))
    flows = turns.select((F.col("conv_id") % 7).alias("suite"), F.col("conv_id").alias("plan_id"), F.concat_ws(":", "conv_id", "place").alias("flow_id"), F.when(F.col("role") == "user", "pending").otherwise("allowed").alias("status"))
    one = stored(execution.suite(ran, flows, "suite"))
    again = execution.suite(ran.repartitionByRange(5, F.desc("place")), flows.repartition(3, "flow_id"), "suite").select("suite", F.col("identity").alias("second"))
    other = execution.suite(ran.withColumn("status", F.when(F.col("place") == 0, "altered").otherwise(F.col("status"))), flows, "suite").select("suite", F.col("identity").alias("third"))
    return one.join(again, "suite").join(other, "suite").withColumn("repeats", F.col("identity") == F.col("second")).withColumn("tells_changes", F.col("identity") != F.col("third")).drop("identity", "second", "third")
