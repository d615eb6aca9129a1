"""Queries on records of chat logs and result files, and on views of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, logs, protocol, views
from .registry import query, table

c, lit = F.col, F.lit


def text(x):
    return c(x).cast("string") if isinstance(x, str) else x.cast("string")


def _task(spark, sf):
    """Messages of conversations as agent logs; the first user message is a task."""
    m = table(spark, sf, "conversations")
    path = F.concat(lit("run/seed_7/cli_only_agent_t"), text("conv_id"), lit("__trial_2.md"))
    said = F.when((c("role") == "user") & (c("turn") < 2), F.concat(lit("Task: ### instruction\nsort "), text("conv_id"), lit("\n### instruction_type\ncells\n"))).when((c("role") == "user") & F.startswith("text", lit("E")), F.concat(lit("Observation: "), "text")).otherwise(
        F.when(c("turn") % 4 == 1, F.concat("text", lit('\nAction: {"name": "bash", "n": '), text("turn"), lit("}"))).otherwise(c("text"))
    )
    return m.select(path.alias("path"), "turn", "role", said.alias("text"))


def _results(spark, sf):
    """Result rows of two thirds of the conversations: of trial 2 and seed 7, or of the task alone."""
    one = table(spark, sf, "conversations").select("conv_id").distinct().where("conv_id % 3 <> 2")
    ident = F.concat(lit("t"), text("conv_id"))
    row = F.when(c("conv_id") % 3 == 0, F.concat(lit('{"id": "'), ident, lit('", "trial_index": 2, "seed": 7, "soft_score": 0.5, "hard_score": 0}'))).otherwise(F.concat(lit('{"task_id": "'), ident, lit('", "success": "Yes", "error": "e"}')))
    return logs.results_index(one.select(F.when(c("conv_id") % 3 == 0, "res/a.json").otherwise("res/b.json").alias("path"), c("conv_id").alias("pos"), row.alias("row")))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn < 2 THEN 'task' WHEN role = 'user' AND starts_with(text, 'E') THEN 'observation' WHEN role = 'user' THEN 'user' WHEN turn % 4 = 1 THEN 'action' ELSE 'said' END AS kind, text FROM conversations),
n AS (SELECT *, lead(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM m),
s AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS steps, count(*) FILTER (role = 'assistant' AND kind = 'action') AS actions, count(*) FILTER (role = 'assistant' AND next = 'observation') AS observed, bool_or(kind = 'task') AS has_task FROM n GROUP BY 1)
SELECT 't' || conv_id || '::trial2::seed7::log' || left(sha1('run/seed_7/cli_only_agent_t' || conv_id || '__trial_2.md'), 10) AS trajectory_id, 't' || conv_id AS task_id, 2::BIGINT AS trial_index, '7' AS seed,
CASE WHEN has_task THEN 'sort ' || conv_id ELSE '' END AS instruction, conv_id % 3 = 1 AS success, CASE conv_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END::DOUBLE AS verifier_score, CASE conv_id % 3 WHEN 1 THEN 'e' END AS verifier_feedback, steps::INT AS steps, actions::INT AS actions, observed::INT AS observed FROM s""")
def log_records(spark, sf):
    r = logs.log_records(_task(spark, sf), _results(spark, sf), "markdown")
    count = lambda f: F.size(F.filter("steps", f))
    return r.select("trajectory_id", "task_id", "trial_index", "seed", "instruction", "success", "verifier_score", "verifier_feedback", F.size("steps").alias("steps"), count(lambda s: s["action_valid"] & (s["tool_name"] == "bash")).alias("actions"), count(lambda s: s["observation"] != "").alias("observed"))


@query("""WITH o AS (SELECT 't' || o_custkey AS id, o_orderkey % 4 AS trial, o_orderkey AS n, 'f' || o_orderkey % 5 AS path FROM orders WHERE o_orderkey % 7 <> 0),
k AS (SELECT id AS key, path, n FROM o UNION ALL SELECT id || '::trial' || trial || '::seed' || CASE WHEN n % 2 = 0 THEN 's' ELSE 'none' END, path, n FROM o)
SELECT key, arg_max(n, path || lpad(n::VARCHAR, 9, '0')) AS n FROM k GROUP BY key""")
def result_index(spark, sf):
    """Result files of four layouts, one of them broken; the last row of a key wins."""
    n = c("o_orderkey")
    ident = F.concat(lit('"t'), text("o_custkey"), lit('"'))
    row = F.concat(F.when(n % 3 == 0, '{"id": ').when(n % 3 == 1, '{"id": "", "task_id": ').otherwise('{"instance_id": '), ident, lit(', "trial": '), text(n % 4), F.when(n % 2 == 0, ', "seed": "s"').otherwise(""), lit(', "n": '), text(n), lit("}"))
    rows = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.concat(lit("f"), text(n % 5)).alias("path"), n.alias("pos"), row.alias("row"))
    held = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda s: s["row"]), ", ").alias("r"))
    k, some = F.right("path", lit(1)), F.concat(lit("["), "r", lit(", 5]"))
    body = F.when(k == "0", some).when(k == "1", F.concat(lit('{"results": [], "records": '), some, lit("}"))).otherwise(F.concat(lit(' {"results": '), some, lit("}")))
    one = rows.limit(0).select("path", lit("").alias("text"))
    files = held.select("path", body.alias("text")).unionByName(one).unionByName(spark.createDataFrame([("z", "{broken"), ("y", '{"other": 1}'), ("x", "[]")], "path string, text string"))
    return logs.results_index(logs.result_rows(files)).select("key", F.get_json_object("row", "$.n").cast("long").alias("n"))


@query("""SELECT p_partkey, CASE k WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN p_size = 3 WHEN 3 THEN p_size % 2 = 0 WHEN 4 THEN true ELSE false END AS success,
CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN p_size / 3.0 WHEN 3 THEN (p_size % 2 = 0)::INT WHEN 4 THEN 0.25 ELSE NULL END::DOUBLE AS score, CASE k WHEN 0 THEN 'top; wrong' WHEN 3 THEN 'm' END AS feedback
FROM (SELECT *, p_partkey % 6 AS k FROM (SELECT p_partkey, 1 + p_partkey % 5 AS p_size FROM part))""")
def result_fields(spark, sf):
    """Scores and feedback of result rows by their cases, counts, flags, or none."""
    k, size = c("p_partkey") % 6, 1 + c("p_partkey") % 5
    row = (
        F.when(k == 0, '{"error": "top", "test_cases": [{"passed": true, "message": " "}, {"result": "no", "message": "wrong"}]}').when(k == 1, '{"cases": [{"hard_pass": 1}], "hard_score": null}')
        .when(k == 2, F.concat(lit('{"passed_count": '), text(size), lit(', "total_count": 3}'))).when(k == 3, F.concat(lit('{"message": "m", "passed": '), F.when(size % 2 == 0, '"SUCCEEDED"').otherwise("false"), lit("}")))
        .when(k == 4, '{"soft_score": "0.25", "hard_score": 1.0, "success": false}')
    )
    return table(spark, sf, "part").select("p_partkey", logs.result_fields(row).alias("f")).select("p_partkey", "f.*")


@query("""WITH r AS (SELECT o_orderkey % 300 AS t, 'p' || o_custkey AS path, o_orderkey % 2 AS rank, o_orderkey AS n FROM orders)
SELECT 't' || t AS trajectory_id, min({'r': rank, 'p': path}).p AS path FROM r GROUP BY t""")
def one_record_per_run(spark, sf):
    """Logs of two formats: the first format's record of a run, then the least path."""
    r = table(spark, sf, "orders").select(F.concat(lit("t"), text(c("o_orderkey") % 300)).alias("trajectory_id"), F.concat(lit("p"), text("o_custkey")).alias("path"), (c("o_orderkey") % 2).alias("k"))
    return logs.one_per_run(r.where("k = 0").select("trajectory_id", "path", lit("md").alias("log_format")), r.where("k = 1").select("trajectory_id", "path", lit("jsonl").alias("log_format"))).select("trajectory_id", "path")


@query("""WITH e AS (SELECT user_id AS path, event_id AS line, CASE WHEN event_id % 3 = 0 THEN event_id END AS seed, CASE WHEN event_id % 5 = 0 THEN event_type END AS task FROM events WHERE event_id % 11 <> 0)
SELECT path, arg_min(seed, line) FILTER (seed IS NOT NULL) AS seed, arg_min(task, line) FILTER (task IS NOT NULL) AS task_id FROM e GROUP BY path""")
def first_seen_metadata(spark, sf):
    """The first seed and task that the lines of a log tell, broken lines left out."""
    n = c("event_id")
    line = F.when(n % 11 == 0, F.concat(lit('{"seed": '), text(n))).otherwise(F.concat(lit('{"x": 1'), F.when(n % 3 == 0, F.concat(lit(', "seed": '), text(n))).otherwise(""), F.when(n % 5 == 0, F.concat(lit(', "task_id": "'), c("event_type"), lit('"'))).otherwise(""), lit("}")))
    seen = logs.first_seen_metadata(table(spark, sf, "events").select(c("user_id").alias("path"), n.alias("line"), line.alias("value")))
    return seen.select("path", F.get_json_object("row", "$.seed").cast("long").alias("seed"), F.get_json_object("row", "$.task_id").alias("task_id"))


def _records(spark, sf):
    """Customers' orders as run records, a step each."""
    step = F.struct(c("o_orderkey").alias("_at"), c("o_orderstatus").alias("raw_model_output"), F.concat(lit(" "), "o_orderpriority").alias("action"), lit("seen\n").alias("observation"), lit(None).cast("string").alias("tool_name"), lit(True).alias("action_valid"))
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(step)).alias("s"))
    steps = F.transform("s", lambda s, i: F.struct(i.cast("long").alias("step_id"), *(s[n].alias(n) for n in ("raw_model_output", "action", "observation", "tool_name", "action_valid"))))
    none = lambda n: lit("").alias(n)
    return held.select(F.concat(lit("r"), text("o_custkey")).alias("trajectory_id"), text("o_custkey").alias("task_id"), lit(0).cast("long").alias("trial_index"), F.concat(lit("do "), text("o_custkey")).alias("instruction"), lit("cells").alias("instruction_type"), none("answer_position"), none("spreadsheet_path"), none("output_path"), none("final_response"), (c("o_custkey") % 2 == 0).alias("success"), lit(0.5).alias("verifier_score"), lit(None).cast("string").alias("verifier_feedback"), steps.alias("steps"))


VIEW_SQL = """s AS (SELECT o_custkey, '[step ' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || '] raw_model_output:' || chr(10) || o_orderstatus || chr(10) || 'action:' || chr(10) || o_orderpriority || chr(10) || 'observation:' || chr(10) || 'seen' AS s, o_orderkey FROM orders),
v AS (SELECT o_custkey, 'instruction: do ' || o_custkey || chr(10) || 'instruction_type: cells' || chr(10) || 'trajectory_steps:' || chr(10) || string_agg(s, chr(10) ORDER BY o_orderkey) AS text, count(*) AS n FROM s GROUP BY 1)"""


@query(f"WITH {VIEW_SQL} SELECT 'r' || o_custkey AS trajectory_id, text FROM v")
def similarity_views(spark, sf):
    return _records(spark, sf).select("trajectory_id", views.similarity_text(c("instruction"), c("instruction_type"), c("steps")).alias("text"))


@query("""SELECT 'r' || o_custkey AS trajectory_id, 'do ' || o_custkey AS instruction, o_custkey % 2 = 0 AS success, count(*)::INT AS steps, arg_max(o_orderstatus, o_orderkey) AS last, true AS has_null FROM orders GROUP BY o_custkey""")
def evidence_views(spark, sf):
    """Evidence of runs as JSON, read back."""
    r = _records(spark, sf)
    j = r.select("trajectory_id", views.evidence_text(r).alias("j"))
    get = lambda p: F.get_json_object("j", p)
    steps = F.from_json(get("$.trajectory_steps"), "array<struct<step_id:long,raw_model_output:string>>")
    return j.select("trajectory_id", get("$.q_i.instruction").alias("instruction"), get("$.y_i.success").cast("boolean").alias("success"), F.size(steps).alias("steps"), F.element_at(steps, lit(-1))["raw_model_output"].alias("last"), F.contains("j", lit('"verifier_feedback":null')).alias("has_null"))


@query(f"WITH {VIEW_SQL} SELECT 'r' || o_custkey AS item_id, 0 AS level, 'trajectory' AS kind, text, 1.0::DOUBLE AS support_mass, o_custkey % 2 = 0 AS success, greatest(1, (length(text) + 3) // 4)::BIGINT AS text_tokens, true AS overhead FROM v")
def record_items(spark, sf):
    r = views.items_of(_records(spark, sf), 2000)
    return r.select("item_id", "level", "kind", "text", "support_mass", "success", "text_tokens", (c("tokens") == F.floor((F.length("evidence") + 3) / 4) + 128).alias("overhead"))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'tool_call' WHEN 'error' THEN 'other' ELSE 'tool_call' END AS type, event_id % 13 = 0 AS calls FROM events),
u AS (SELECT *, lead(type) OVER o AS next, last_value(CASE WHEN type = 'message' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS said FROM e WHERE type <> 'other' WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT * FROM u WHERE type = 'tool_call' OR (NOT calls AND (next IS NULL OR next <> 'tool_call')))
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS step_id, CASE WHEN said IS NULL THEN '' ELSE 'm' || said END AS raw_model_output, CASE type WHEN 'message' THEN '' ELSE 'grep(' || event_id || ')' END AS action, CASE type WHEN 'tool_call' THEN 'grep' END AS tool_name, type = 'message' OR event_id % 2 = 1 AS action_valid FROM k""")
def conversation_steps(spark, sf):
    """Messages and tool calls of users' events folded into steps."""
    n, kind = c("event_id"), c("event_type")
    e = table(spark, sf, "events").select("user_id", n.alias("pos"), F.when(kind.isin("view", "click"), "message").when(kind == "error", "other").otherwise("tool_call").alias("type"), F.concat(lit("m"), text(n)).alias("content"), F.concat(lit("grep("), text(n), lit(")")).alias("cmd"), F.when(n % 2 == 0, "[tool error: x]").otherwise("fine").alias("obs"), lit(None).cast("string").alias("tool"), (n % 13 == 0).alias("has_calls"))
    return views.conversation_steps(e, "user_id").drop("observation")


@query("""SELECT 'qa:' || d.doc_id AS trajectory_id, d.doc_id::VARCHAR AS task_id, 'q' || d.doc_id AS instruction, CASE WHEN d.doc_id % 2 = 0 THEN 'qa' ELSE lang END AS instruction_type, l.quality = 1 AS success, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN 0.25 END, 0)::DOUBLE AS verifier_score, CASE WHEN l.quality = 1 THEN 'correct' WHEN d.doc_id % 5 = 0 THEN 'answer_mismatch' ELSE 'timeout' END AS verifier_feedback FROM documents d JOIN labels l USING (doc_id)""")
def question_records(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = c("doc_id")
    r = j.select(n.alias("id"), F.concat(lit("q"), text(n)).alias("question"), F.when(n % 2 == 0, "").otherwise(c("lang")).alias("task_type"), lit("a").alias("response"), c("quality").alias("hard"), F.when(n % 3 != 0, 0.25).alias("soft"), F.when(n % 5 == 0, "Expected 7").otherwise(" timeout ").alias("fail_reason"))
    return views.question_records(r).select("trajectory_id", "task_id", "instruction", "instruction_type", "success", "verifier_score", "verifier_feedback")


@query("""WITH s AS (SELECT l_orderkey AS t, l_partkey AS n, l_linenumber AS r FROM lineitem WHERE l_linenumber <= 3)
SELECT o_orderkey AS instance_id, 'q' || o_orderkey AS query, 3 AS top_k, coalesce(array_to_string(list(n ORDER BY r, n) FILTER (n IS NOT NULL), ','), '') AS nodes, coalesce(sum(r), 0)::DOUBLE AS score FROM orders LEFT JOIN s ON t = o_orderkey AND o_orderkey % 4 <> 0 GROUP BY 1""")
def selection_log(spark, sf):
    """What each task was given, as it is logged."""
    tasks = table(spark, sf, "orders").select(c("o_orderkey").alias("instance_id"), lit("do").alias("instruction"), lit("t").alias("instruction_type"), lit("A1").alias("answer_position"), F.concat(lit("q"), text("o_orderkey")).alias("query"))
    hits = table(spark, sf, "lineitem").where("l_orderkey % 4 <> 0").select(c("l_orderkey").alias("instance_id"), c("l_partkey").alias("node_id"), c("l_linenumber").cast("double").alias("score"), c("l_linenumber").alias("rank"))
    r = protocol.selection_records(tasks, hits, 3, "agent")
    return r.select("instance_id", "query", "top_k", F.array_join("selected_node_ids", ",").alias("nodes"), F.aggregate("selected_node_scores", lit(0.0), lambda a, x: a + x).alias("score"))


@query("""WITH f AS (SELECT event_type AS namespace, user_id AS key, arg_max(value, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), o AS (SELECT event_type AS namespace, user_id AS key, arg_min(value, event_id) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT * FROM f UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.namespace = o.namespace AND f.key = o.key)""")
def cache_upsert(spark, sf):
    e = table(spark, sf, "events").select(c("event_type").alias("namespace"), c("user_id").alias("key"), F.array("value").alias("vec"), c("event_id").alias("seq"))
    old = e.where("seq % 2 = 1").groupBy("namespace", "key").agg(F.min_by("vec", "seq").alias("vec"))
    return protocol.upserted(old, e.where("seq % 2 = 0")).select("namespace", "key", F.get("vec", lit(0)).alias("v"))


@query("""WITH r AS (SELECT p_partkey AS run, 1000 * (1 + p_partkey % 3) AS most, CASE p_partkey % 2 WHEN 0 THEN 0.95 ELSE 0.5 END AS ratio, 400 * (p_partkey % 4) AS reserve, p_partkey % 5 AS level, p_partkey % 7 AS workers FROM part),
b AS (SELECT *, floor(most * ratio)::BIGINT AS budget FROM r), e AS (SELECT *, budget - reserve AS room FROM b)
SELECT run, 'high' AS severity, 'summary_budget' AS area, 'analyst_budget=' || budget || ', max_model_tokens=' || most AS evidence FROM e WHERE budget >= most * 0.9
UNION ALL SELECT run, 'blocker', 'summary_budget', 'analyst_budget=' || budget || ', overhead=' || reserve FROM e WHERE room <= 0
UNION ALL SELECT run, 'high', 'analyst_budget_override', 'analyst_max_prompt_tokens=300, evidence_budget=' || room FROM e WHERE 300 < room
UNION ALL SELECT run, 'watch', 'budget_refinement', 'budget_refinement_apply_to_level=0' FROM e WHERE level = 0
UNION ALL SELECT run, 'info', 'soft_membership', 'recursive_assignment=cumulative_mass, top_r=2' FROM e WHERE run % 2 = 0
UNION ALL SELECT run, 'info', 'soft_membership', 'coverage=0.9, max_gap=0.25' FROM e WHERE run % 2 = 0
UNION ALL SELECT run, 'watch', 'concurrency_timeout', 'workers=' || workers || ', generation_timeout=60, rollout_timeout=90' FROM e WHERE workers > 4
UNION ALL SELECT run, 'high', 'dynamic_coverage', 'train_count=200, initial_count=120, arrival_count=' || least(80, run % 100) FROM e WHERE run % 100 BETWEEN 1 AND 79""")
def config_findings(spark, sf):
    n = c("p_partkey")
    cols = {"summary_max_model_tokens": 1000 * (1 + n % 3), "summary_budget_ratio": F.when(n % 2 == 0, 0.95).otherwise(0.5), "summary_prompt_overhead_reserve_tokens": 400 * (n % 4), "analyst_max_prompt_tokens": lit(300), "budget_refinement_apply_to_level": n % 5, "soft_recursive_assignment": F.when(n % 2 == 0, "cumulative_mass").otherwise("primary_argmax"), "soft_top_r_memberships": lit(2), "soft_cumulative_mass_coverage": lit(0.9), "soft_max_membership_gap": lit(0.25), "workers": n % 7, "thinking": lit(True), "generation_timeout_seconds": lit(60), "rollout_client_timeout_seconds": lit(90), "chunked_embedding_enabled": lit(False), "embedding_batch_size": lit(8), "embedding_chunk_tokens": lit(8000), "embedding_max_model_len": lit(8192), "train_start": lit(0), "train_end": lit(200), "tree_scenario": lit("dynamic_update"), "dynamic_initial_count": lit(120), "dynamic_arrival_count": n % 100}
    return protocol.config_findings(table(spark, sf, "part").select(n.alias("run"), *(v.alias(k) for k, v in cols.items())), "run").drop("finding")


@query("""WITH a AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT 's' || p_partkey AS name, p_name AS source, v AS target FROM a FULL JOIN b USING (p_partkey) WHERE p_name IS DISTINCT FROM v AND p_partkey <> 1""")
def protocol_differences(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(lit("s"), text("p_partkey")).alias("name")
    a = p.where("p_partkey % 5 <> 0").select(name, c("p_name").alias("value"))
    b = p.where("p_partkey % 7 <> 0").select(name, F.when(c("p_partkey") % 3 == 0, c("p_brand")).otherwise(c("p_name")).alias("value"))
    return protocol.differing_settings(a, b, ("s1",))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'ACTION: TASK_COMPLETE' WHEN 1 THEN '{"a": 1} then' || chr(10) || 'Action: {"a": 2}' ELSE '' END AS action FROM conversations""")
def reply_actions(spark, sf):
    k = c("turn") % 3
    reply = F.when(k == 0, "done ACTION: TASK_COMPLETE Action: {}").when(k == 1, 'Action: {"a": 1} then\nAction: {"a": 2}\n').otherwise(c("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", logs.action(reply).alias("action"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'skill_md' WHEN 1 THEN 'reference' WHEN 2 THEN 'script' ELSE 'reference' END AS target FROM events""")
def placements(spark, sf):
    k = c("event_id") % 4
    return table(spark, sf, "events").select("event_id", evidence.placement(F.when(k == 0, " Main ").when(k == 1, "ref").when(k == 2, "SCRIPTS").otherwise("reference")).alias("target"))
