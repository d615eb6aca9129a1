"""Queries on evidence, patches, data sets and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets, evidence, patches
from .members import rounded
from .registry import query, table

# ---- evidence ----------------------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['run', '--api-key', lang, '--out', source] WHEN 1 THEN ['--Token', source, 'PASSWORD=' || lang, 'x=' || lang] WHEN 2 THEN ['Bearer ' || source, '--lang=' || lang] ELSE ['--secret', '--token', lang] END AS a FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'run --api-key <redacted> --out ' || a[5] WHEN 1 THEN '--Token <redacted> PASSWORD=<redacted> ' || a[4] WHEN 2 THEN 'Bearer <redacted> ' || a[2] ELSE '--secret <redacted> ' || a[3] END AS command FROM a""")
def redact_command(spark, sf):
    lit, c = F.lit, F.col
    kinds = [F.array(lit("run"), lit("--api-key"), c("lang"), lit("--out"), c("source")), F.array(lit("--Token"), c("source"), F.concat(lit("PASSWORD="), "lang"), F.concat(lit("x="), "lang")), F.array(F.concat(lit("Bearer "), "source"), F.concat(lit("--lang="), "lang")), F.array(lit("--secret"), lit("--token"), c("lang"))]
    k = c("doc_id") % 4
    args = F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).when(k == 2, kinds[2]).otherwise(kinds[3])
    return table(spark, sf, "documents").select("doc_id", F.array_join(evidence.redacted(args), " ").alias("command"))


@query(r"""WITH m AS (SELECT conv_id, arg_min(text, turn) AS t, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, 'do it' AS instruction, nullif(regexp_replace(split_part(t, chr(10), 1), '^\s+|\s+$', '', 'g'), '') AS answer_position, NULL::VARCHAR AS output_path FROM m""")
def task_sections(spark, sf):
    """First user messages dressed as task messages, and their sections read back."""
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    dressed = F.concat(F.lit("Task: ### instruction\ndo it\n### answer_position\n"), first, F.lit("\n---\nfooter ### output_path"))
    c = table(spark, sf, "conversations").withColumn("text", dressed)
    got = evidence.first_task(c, "conv_id")
    fields = {f: col for f, col in zip(evidence.TASK_FIELDS, evidence.task_fields(F.col("task")))}
    return got.select("conv_id", *(fields[f] for f in ("instruction", "answer_position", "output_path")))


@query("""WITH x AS (SELECT event_id, event_id % 5 AS k, user_id, event_type FROM events)
SELECT event_id, CASE k WHEN 0 THEN 't-' || user_id WHEN 1 THEN 't-' || user_id WHEN 2 THEN 'w' || user_id ELSE 'log' || event_id END AS task_id, CASE k WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 4 THEN 9 ELSE 0 END::BIGINT AS trial FROM x""")
def trial_ids(spark, sf):
    """Task and trial of logs by their paths, with the workbook's folder where the name says nothing."""
    c, lit = F.col, F.lit
    k, user, event = c("event_id") % 5, c("user_id").cast("string"), c("event_id").cast("string")
    path = (
        F.when(k == 0, F.concat(lit("logs/cli_only_agent_t-"), user, lit("__trial_3_seed_7.md")))
        .when(k == 1, F.concat(lit("logs/Run-12/cli_skill_preloaded_agent_t-"), user, lit(".md")))
        .otherwise(F.concat(lit("logs/log"), event, lit(".jsonl")))
    )
    sheet = F.when(k == 2, F.concat(lit("data/w"), user, lit("/in.xlsx")))
    return table(spark, sf, "events").select("event_id", evidence.inferred_task_id(path, sheet).alias("task_id"), evidence.inferred_trial(path, F.when(k == 4, 9)).alias("trial"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value > 50 WHEN event_id % 3 = 1 THEN value - 50 > 0 ELSE CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END END AS success FROM events""")
def outcome_inference(spark, sf):
    k = F.col("event_id") % 3
    word = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "PASSED").otherwise("unclear")
    return table(spark, sf, "events").select("event_id", evidence.inferred_success(F.when(k == 0, F.col("value") > 50), F.when(k == 1, F.col("value") - 50), word).alias("success"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'read' WHEN turn % 3 = 1 THEN 'grep' END AS name, CASE WHEN turn % 3 = 0 THEN turn WHEN turn % 3 = 1 THEN NULL END::BIGINT AS page FROM conversations""")
def tool_calls(spark, sf):
    c, k = F.col, F.col("turn") % 3
    body = F.when(k == 0, F.concat(F.lit('<think>no</think><tool_call>{"name": "read", "arguments": {"page": '), c("turn").cast("string"), F.lit("}}</tool_call>"))).when(k == 1, '<TOOL>\n{"tool": "grep", "args": []}\n</TOOL>').otherwise('<tool>{"name": "bash"}</tool>')
    call = evidence.tool_call(body)
    return table(spark, sf, "conversations").select("conv_id", "turn", call["name"].alias("name"), F.get_json_object(call["arguments"], "$.page").cast("long").alias("page"))


@query("""WITH l AS (SELECT l_orderkey, list(l_comment_line ORDER BY l_linenumber, l_comment_line) AS s, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linenumber AS l_comment_line FROM lineitem) GROUP BY 1)
SELECT l_orderkey, array_to_string(CASE WHEN n <= 4 THEN s ELSE list_concat(list_concat(s[1:2], ['...']), s[n - 1:n]) END, '|') AS steps FROM l""")
def head_tail_steps(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat_ws(" ", "l_returnflag", F.col("l_linenumber").cast("string")).alias("s")).alias("x"))
    held = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("steps"))
    return held.select("l_orderkey", F.array_join(evidence.head_tail(F.col("steps"), 4, F.lit("...")), "|").alias("steps"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'answer_mismatch' WHEN doc_id % 3 = 1 THEN 'answer_mismatch' ELSE source END AS reason, CASE WHEN doc_id % 3 = 0 THEN 'grep' WHEN doc_id % 3 = 1 THEN lang ELSE 'tool' END AS tool, doc_id % 3 = 2 AS passing, doc_id % 5 IN (0, 2, 4) AS retry FROM documents""")
def failure_labels(spark, sf):
    c, k, s = F.col, F.col("doc_id") % 3, F.col("doc_id") % 5
    reason = F.when(k == 0, F.concat(F.lit("Expected "), "lang")).when(k == 1, "  \n").otherwise(F.concat(F.lit(" "), "source", F.lit("\t")))
    command = F.when(k == 0, "grep (x)").otherwise("no bracket")
    status = F.when(s == 0, 429).when(s == 1, 400).when(s == 2, 503).when(s == 3, 404)
    fault = F.when(k == 2, F.concat("lang", F.lit(": Too Many Requests"))).otherwise("code 4290")
    return table(spark, sf, "documents").select("doc_id", evidence.failure_reason(reason).alias("reason"), evidence.tool_name(F.when(k == 1, c("lang")), command).alias("tool"), evidence.is_passing_fault(fault).alias("passing"), evidence.is_retryable(status).alias("retry"))


# ---- patches -----------------------------------------------------------------------------------

_CARDS_SQL = "cards AS (SELECT 'i' || p_partkey AS item_id, 'c' || (p_partkey % 40) AS source_community_id, 1 AS level, p_name AS text, (1 + p_size % 3)::DOUBLE AS confidence FROM part), com AS (SELECT DISTINCT 'c' || (p_partkey % 40) AS community_id, (10 + p_partkey % 40)::DOUBLE AS support_mass FROM part), total AS (SELECT source_community_id, sum(confidence) AS t FROM cards GROUP BY 1)"


def _cards(spark, sf):
    p = table(spark, sf, "part")
    source = F.concat(F.lit("c"), (F.col("p_partkey") % 40).cast("string"))
    com = p.select(source.alias("community_id"), F.lit(0).alias("level"), (10 + F.col("p_partkey") % 40).cast("double").alias("support_mass")).distinct()
    cards = p.select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("item_id"), source.alias("source_community_id"), F.lit(1).alias("level"), F.col("p_name").alias("text"), F.array(F.lit(1.0)).alias("vec"), (1 + F.col("p_size") % 3).cast("double").alias("confidence"), F.lit(1).alias("version"))
    total = cards.groupBy("source_community_id").agg(F.sum("confidence").alias("_t"))
    mass = com.select(F.col("community_id").alias("source_community_id"), F.col("support_mass").alias("_m"))
    return cards.join(total, "source_community_id").join(mass, "source_community_id").withColumn("support_mass", F.col("_m") * F.col("confidence") / F.col("_t")).drop("_m", "_t"), com


@query(f"""WITH {_CARDS_SQL}, u AS (SELECT item_id, 5.0::DOUBLE AS c2, source_community_id FROM cards WHERE source_community_id IN ('c3', 'c7') AND substr(item_id, 2)::BIGINT % 80 < 40),
n AS (SELECT 'new' || community_id AS item_id, community_id AS source_community_id, 2.0::DOUBLE AS c2 FROM com WHERE community_id IN ('c7', 'c9')),
m AS (SELECT cards.item_id, cards.source_community_id, coalesce(c2, confidence) AS confidence, confidence AS was, CASE WHEN u.item_id IS NOT NULL THEN 'updated' END AS change FROM cards LEFT JOIN u USING (item_id) UNION ALL SELECT item_id, source_community_id, c2, NULL, 'added' FROM n),
s AS (SELECT m.*, support_mass * confidence / sum(confidence) OVER (PARTITION BY m.source_community_id) AS mass, support_mass * was / (SELECT t FROM total WHERE total.source_community_id = m.source_community_id) AS before FROM m JOIN com ON com.community_id = m.source_community_id)
SELECT item_id, source_community_id, round(mass, 6) AS support_mass, coalesce(change, CASE WHEN abs(mass - before) > 1e-9 THEN 'mass' END) AS change, change IS NOT NULL AS reroute FROM s""")
def patch_commit(spark, sf):
    """Updates in two communities and additions in two: masses shared out anew there, and there alone."""
    cards, com = _cards(spark, sf)
    number = F.substring("item_id", 2, 20).cast("long")
    updates = cards.where(F.col("source_community_id").isin("c3", "c7") & (number % 80 < 40)).select("source_community_id", F.lit("update").alias("operation"), "item_id", F.concat("text", F.lit(" new")).alias("text"), "vec", F.lit(5.0).alias("confidence"))
    adds = com.where(F.col("community_id").isin("c7", "c9")).select(F.col("community_id").alias("source_community_id"), F.lit("add").alias("operation"), F.concat(F.lit("new"), "community_id").alias("item_id"), F.lit("t").alias("text"), F.array(F.lit(2.0)).alias("vec"), F.lit(2.0).alias("confidence"))
    out = patches.patched(cards, com, updates.unionByName(adds))
    return rounded(out.select("item_id", "source_community_id", "support_mass", "change", "reroute"), "support_mass")


@query("""SELECT fault, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 1 THEN 'unknown_community' WHEN 2 THEN 'unknown_operation' WHEN 3 THEN 'update_of_another_card' WHEN 4 THEN 'add_of_a_known_id' WHEN 5 THEN 'confidence' END AS fault FROM part) WHERE fault IS NOT NULL GROUP BY 1""")
def patch_checks(spark, sf):
    cards, com = _cards(spark, sf)
    k = F.substring("item_id", 2, 20).cast("long") % 6
    asked = cards.select(
        F.when(k == 1, "nowhere").when(k == 3, F.when(F.col("source_community_id") == "c0", "c1").otherwise("c0")).otherwise(F.col("source_community_id")).alias("source_community_id"),
        F.when(k == 2, "move").when(k == 4, "add").otherwise("update").alias("operation"), "item_id", "text", "vec", F.when(k == 5, 0.0).otherwise(1.0).alias("confidence"),
    )
    return patches.patch_faults(cards, com, asked).groupBy("fault").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id AS item_id, event_type AS community_id, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2) SELECT * FROM e WHERE item_id % 3 <> 0 UNION ALL SELECT DISTINCT item_id, 'new', 1.0::DOUBLE FROM e WHERE item_id % 3 = 0""")
def reroute_edges(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("item_id"), F.col("event_type").alias("community_id")).agg(F.count("*").cast("double").alias("w"))
    fresh = e.where("item_id % 3 = 0").select("item_id", F.lit("new").alias("community_id"), F.lit(1.0).alias("w")).distinct()
    return patches.rerouted(e, fresh)


@query("""WITH r AS (SELECT p_partkey, p_partkey % 40 AS c, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_partkey % 40) AS n FROM part) SELECT p_partkey AS position, c AS source_community_id, greatest(n - 3, 0) AS extra FROM r WHERE k <= 3""")
def card_caps(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("position"), (F.col("p_partkey") % 40).alias("source_community_id"))
    return patches.capped(p, 3)


@query(r"""WITH k AS (SELECT *, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM documents) SELECT doc_id FROM k a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id % 2 = 0 AND b.source = a.source AND b.key = a.key)""")
def novel_cards(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_community_id"), "text")
    return patches.novel(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), T.text_key).select("doc_id")


# ---- data sets ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 150 OFFSET 100")
def task_slice(spark, sf):
    return datasets.sliced(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 250)


@query("""WITH f AS (SELECT o_custkey AS instance_id, o_orderkey, CASE WHEN o_orderkey % 9 = 1 THEN '1_' || o_custkey ELSE o_orderkey::VARCHAR END AS p, sha256(o_orderstatus) AS i, sha256(o_orderpriority) AS a FROM orders),
h AS (SELECT instance_id, arg_min(i, o_orderkey) AS i, arg_min(a, o_orderkey) AS a FROM f GROUP BY 1), s AS (SELECT f.instance_id, count(*) AS n, min(p) AS p FROM f JOIN h USING (instance_id, i, a) GROUP BY 1), t AS (SELECT DISTINCT instance_id, p AS q FROM f WHERE p = '1_' || instance_id)
SELECT instance_id, CASE WHEN n = 1 THEN s.p ELSE q END AS prefix, CASE WHEN n = 1 THEN 'hash_input_and_answer' WHEN q IS NOT NULL THEN 'name' END AS method FROM h LEFT JOIN s USING (instance_id) LEFT JOIN t USING (instance_id)""")
def excluded_cases(spark, sf):
    c = F.col
    prefix = F.when(c("o_orderkey") % 9 == 1, F.concat(F.lit("1_"), c("o_custkey").cast("string"))).otherwise(c("o_orderkey").cast("string"))
    f = table(spark, sf, "orders").select(c("o_custkey").alias("instance_id"), "o_orderkey", prefix.alias("prefix"), F.sha2("o_orderstatus", 256).alias("input_sha"), F.sha2("o_orderpriority", 256).alias("answer_sha"))
    held = f.groupBy("instance_id").agg(F.min_by(F.struct("input_sha", "answer_sha"), "o_orderkey").alias("h")).select("instance_id", "h.*")
    return datasets.excluded_cases(f, held)


@query("""WITH w AS (SELECT o_custkey AS instance_id, o_orderkey AS k, o_orderdate::VARCHAR AS want, CASE WHEN o_orderkey % 5 <> 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderdate::VARCHAR END END AS got FROM orders), c AS (SELECT *, coalesce(want = got, false) AS passed, CASE WHEN got IS NULL THEN 'missing output' WHEN want <> got THEN 'value differs' END AS m FROM w)
SELECT instance_id, round(avg(passed::INT), 6) AS soft, bool_and(passed)::INT AS hard, arg_min(m, k) FILTER (m IS NOT NULL) AS message FROM c GROUP BY 1""")
def answer_compare(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("case"), F.col("o_orderdate").cast("string").alias("value"))
    got = o.where("`case` % 5 <> 4").withColumn("value", F.when(F.col("case") % 3 == 0, "x").otherwise(F.col("value")))
    return rounded(datasets.instance_results(datasets.compared_answers(o, got)), "soft")


@query("""WITH d AS (SELECT o_orderkey AS instance_id, count(DISTINCT l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey AS instance_id FROM orders WHERE o_orderkey NOT IN (SELECT instance_id FROM d WHERE n >= 4)""")
def unfinished_tasks(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"))
    return datasets.unfinished(t, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("case")), 4)


@query("""WITH s AS (SELECT event_type AS stage, sum(value) AS seconds, count(*) AS runs FROM events GROUP BY 1), u AS (SELECT event_type AS stage, sum((props->>'$.k')::BIGINT) AS t FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT stage, round(seconds, 4) AS seconds, runs, coalesce(t, 0)::BIGINT AS total_tokens FROM s LEFT JOIN u USING (stage)""")
def stage_report(spark, sf):
    e = table(spark, sf, "events").withColumn("stage", F.col("event_type"))
    out = datasets.stage_report(e.select("stage", F.col("value").alias("seconds")), e.where("stage <> 'error'").select("stage", F.get_json_object("props", "$.k").cast("long").alias("total_tokens")))
    return out.withColumn("seconds", F.round("seconds", 4))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events WHERE event_type <> 'view' GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS "values" FROM f GROUP BY 1""")
def ordered_unique(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" "))
    return datasets.ordered_unique(e, "user_id", "event_id", "v").select("user_id", F.array_join("values", ",").alias("values"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS position, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 200 THEN 'train' ELSE 'heldout' END AS split FROM orders")
def split_manifest(spark, sf):
    return datasets.split_manifest(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200)


@query("SELECT 1 AS level, count(DISTINCT p_partkey % 40) AS communities, count(*) AS cards, (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey % 40)) AS most_cards, true AS passed FROM part")
def audit_rollup(spark, sf):
    cards, com = _cards(spark, sf)
    out = datasets.audit_rollup(cards, com.withColumn("level", F.lit(1)), 64)
    return out.drop("max_error")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('42:' || o_orderkey), o_orderkey LIMIT 100")
def task_sample(spark, sf):
    """A hundred orders of a seeded shuffle; the sample is the feature."""
    return datasets.sampled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42, 100)


@query("""WITH e AS (SELECT sha256(doc_id || chr(10) || strlen(text) || chr(10) || sha256(text)) AS h FROM documents), c AS (SELECT ('0x' || h[1:2])::INT % 64 AS c, count(*) AS n, sum(('0x' || h[3:17])::HUGEINT) AS a, sum(('0x' || h[18:32])::HUGEINT) AS b FROM e GROUP BY 1)
SELECT sum(n)::BIGINT AS files, sha256(string_agg(c || ':' || n || ':' || a || ':' || b, ',' ORDER BY c)) AS digest FROM c""")
def set_digest(spark, sf):
    """One digest of all document texts, whatever their order."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    return datasets.set_digest(d)
