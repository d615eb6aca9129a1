"""Queries on run records, scores, usage logs, files and arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, records, scoring
from ..sources import readers, sinks
from ..streaming import admission
from .members import rounded
from .registry import query, table

RESULTS_SQL = """res AS (SELECT d.doc_id AS instance_id, d.lang AS instruction_type, l.quality::DOUBLE AS hard, CASE WHEN d.doc_id % 5 <> 0 THEN (l.quality + d.doc_id % 2) / 2.0 END AS soft, l.quality = 1 AS passed, l.toxic = 0 AS passed_b
FROM documents d JOIN labels l USING (doc_id))"""


def results(spark, sf):
    """Labelled documents as scored runs."""
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return j.select(F.col("doc_id").alias("instance_id"), F.col("lang").alias("instruction_type"), F.col("quality").cast("double").alias("hard"), F.when(F.col("doc_id") % 5 != 0, (F.col("quality") + F.col("doc_id") % 2) / 2.0).alias("soft"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("passed_b"))


ACC = "count(*) AS total, round(avg(soft), 6) AS mean_soft, count(*) FILTER (hard >= 1) AS hard_passes, round(avg(CASE WHEN soft IS NOT NULL THEN hard END), 6) AS mean_hard"


@query(f"WITH {RESULTS_SQL} SELECT {ACC} FROM res")
def score_overall(spark, sf):
    return rounded(scoring.accuracy(results(spark, sf)).where("is_all = 1").drop("is_all", "instruction_type"), "mean_soft", "mean_hard")


@query(f"WITH {RESULTS_SQL} SELECT instruction_type, {ACC} FROM res GROUP BY 1")
def score_by_type(spark, sf):
    return rounded(scoring.accuracy(results(spark, sf)).where("is_all = 0").drop("is_all"), "mean_soft", "mean_hard")


@query("""WITH s AS (SELECT user_id AS instance_id, bool_or(value > 50) AS a, bool_and(value > 50) AS b FROM events GROUP BY 1)
SELECT count(*) AS instances, round(avg(a::INT), 6) AS pass_any, round(avg(b::INT), 6) AS pass_all FROM s""")
def pass_any_all(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("instance_id"), (F.col("value") > 50).alias("passed"))
    return rounded(scoring.pass_rates(e), "pass_any", "pass_all")


@query(f"""WITH {RESULTS_SQL}, a AS (SELECT instance_id, passed FROM res WHERE instance_id % 7 <> 0), b AS (SELECT instance_id, passed_b AS passed FROM res WHERE instance_id % 11 <> 0)
SELECT CASE WHEN a.passed IS NULL THEN 'only_b' WHEN b.passed IS NULL THEN 'only_a' WHEN a.passed AND b.passed THEN 'both_pass' WHEN b.passed THEN 'gained' WHEN a.passed THEN 'lost' ELSE 'both_fail' END AS outcome, count(*) AS n
FROM a FULL JOIN b USING (instance_id) GROUP BY 1""")
def paired_flips(spark, sf):
    r = results(spark, sf)
    return scoring.paired_flips(r.where("instance_id % 7 <> 0").select("instance_id", "passed"), r.where("instance_id % 11 <> 0").select("instance_id", F.col("passed_b").alias("passed")))


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS n, round(avg(hard), 6) AS hard, round(avg((hard >= 1 AND instance_id % 2 = 0)::INT), 6) AS em, round(coalesce(avg(soft), 0), 6) AS f1 FROM res")
def qa_summary(spark, sf):
    r = results(spark, sf).select("hard", ((F.col("hard") >= 1) & (F.col("instance_id") % 2 == 0)).cast("double").alias("em"), F.col("soft").alias("f1"))
    return rounded(scoring.qa_summary(r), "hard", "em", "f1")


def usage_log(spark, sf):
    """Events as a usage log: views are cached, errors come without usage."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select((F.col("event_type") == "view").alias("cache_hit"), (F.col("event_id") % 97 == 0).alias("malformed"), (F.col("event_type") != "error").alias("has_usage"), k.alias("prompt_tokens"), F.floor("value").cast("long").alias("completion_tokens"), (k + F.floor("value")).cast("long").alias("total_tokens"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"))


LOG_SQL = """log AS (SELECT event_type = 'view' AS cache_hit, event_id % 97 = 0 AS malformed, event_type <> 'error' AS has_usage, (props->>'$.k')::BIGINT AS p, floor(value)::BIGINT AS c FROM events),
f AS (SELECT *, NOT malformed AND NOT cache_hit AS fresh FROM log)"""


@query(f"""WITH {LOG_SQL}, r AS (SELECT count(*) AS records, count(*) FILTER (malformed) AS malformed_records, count(*) FILTER (NOT malformed AND cache_hit) AS cache_hits, count(*) FILTER (fresh) AS non_cache_records, count(*) FILTER (fresh AND has_usage) AS records_with_usage, count(*) FILTER (fresh AND NOT has_usage) AS records_without_usage,
coalesce(sum(p) FILTER (fresh AND has_usage), 0)::BIGINT AS prompt_tokens, coalesce(sum(c) FILTER (fresh AND has_usage), 0)::BIGINT AS completion_tokens, coalesce(sum(p + c) FILTER (fresh AND has_usage), 0)::BIGINT AS total_tokens, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens FROM f)
SELECT *, CASE WHEN records = 0 THEN 'missing' WHEN non_cache_records = 0 THEN 'all_cached' WHEN records_with_usage = 0 THEN 'missing' WHEN records_with_usage = non_cache_records THEN 'complete' ELSE 'partial' END AS provider_usage_status,
CASE WHEN records = 0 THEN 'empty_log' WHEN non_cache_records = 0 THEN 'all_cached' WHEN records_with_usage = 0 THEN CASE WHEN cache_hits = 0 THEN 'uncached_without_usage' ELSE 'mixed_cached_missing_usage' END ELSE CASE WHEN cache_hits = 0 THEN 'uncached_' ELSE 'mixed_cached_' END || CASE WHEN records_with_usage = non_cache_records THEN 'complete' ELSE 'partial' END END AS call_source_status FROM r""")
def usage_rollup(spark, sf):
    return scoring.usage_rollup(usage_log(spark, sf))


@query(f"WITH {LOG_SQL} SELECT count(*) AS records, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens FROM f")
def usage_simple(spark, sf):
    return scoring.usage_simple(usage_log(spark, sf))


@query("SELECT count(*) AS events, max(n_chars) AS max_tokens, count(*) FILTER (n_chars >= 1900) AS near_limit, count(*) FILTER (n_chars > 2000) AS over_limit FROM documents")
def prompt_stats(spark, sf):
    return scoring.prompt_stats(table(spark, sf, "documents").select(F.col("n_chars").alias("tokens")), 2000)


@query("""WITH n AS (SELECT *, lead(role) OVER o AS nr, lead(text) OVER o AS nt FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS step, text AS output, CASE WHEN nr = 'user' AND starts_with(nt, 'E') THEN trim(substr(nt, 2)) END AS observation FROM n WHERE role = 'assistant'""")
def steps_from_messages(spark, sf):
    return records.steps(table(spark, sf, "conversations"), prefix="E").withColumn("step", F.col("step").cast("long"))


@query("SELECT conv_id, arg_max(text, turn) AS final_response FROM conversations WHERE role = 'assistant' GROUP BY 1")
def final_response(spark, sf):
    return records.final_response(table(spark, sf, "conversations"))


@query("""WITH s AS (SELECT conv_id, turn, '## [' || turn || '] ' || upper(role) || chr(10) || chr(10) || text AS s FROM conversations)
SELECT conv_id, string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS log FROM s GROUP BY 1""")
def chat_log_write(spark, sf):
    return sinks.chat_log(table(spark, sf, "conversations"))


@query(r"SELECT conv_id::VARCHAR AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text FROM conversations")
def chat_log_read(spark, sf):
    """Chat logs written and parsed again: the messages come back."""
    logs = sinks.chat_log(table(spark, sf, "conversations")).select(F.col("conv_id").cast("string").alias("path"), F.col("log").alias("text"))
    out = readers.markdown_messages(logs)
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


@query("SELECT conv_id::VARCHAR AS path, turn AS line, role, text FROM conversations WHERE turn % 4 <> 3")
def jsonl_shapes(spark, sf):
    c = table(spark, sf, "conversations")
    bare, kind = F.struct("role", F.col("text").alias("content")), F.col("turn") % 4
    line = F.when(kind == 0, F.to_json(bare)).when(kind == 1, F.to_json(F.struct(bare.alias("message")))).when(kind == 2, F.to_json(F.struct(F.lit("message").alias("type"), bare.alias("data")))).otherwise("{not json")
    return readers.jsonl_messages(c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), line.alias("value")))


@query("""WITH r AS (SELECT c_custkey % 500 AS task_id, c_custkey % 3 AS trial FROM customer),
s AS (SELECT o_custkey % 500 AS task_id, o_orderkey % 3 AS trial, o_orderkey AS seq, o_totalprice AS score FROM orders WHERE o_custkey % 2 = 0),
t AS (SELECT task_id, trial, arg_max(score, seq) AS a FROM s GROUP BY 1, 2), k AS (SELECT task_id, arg_max(score, seq) AS b FROM s GROUP BY 1)
SELECT task_id, trial, coalesce(a, b) AS score FROM r LEFT JOIN t USING (task_id, trial) LEFT JOIN k USING (task_id)""")
def trial_lookup_fallback(spark, sf):
    r = table(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("task_id"), (F.col("c_custkey") % 3).alias("trial"))
    s = table(spark, sf, "orders").where("o_custkey % 2 = 0").select((F.col("o_custkey") % 500).alias("task_id"), (F.col("o_orderkey") % 3).alias("trial"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("score"))
    return records.with_result(r, s)


@query("""WITH e AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' ELSE 'duplicate' END AS problem, k FROM e FULL JOIN a USING (k) WHERE a.n IS NULL OR e.n IS NULL OR a.n > 1 OR e.n > 1""")
def exact_split_join(spark, sf):
    return records.split_mismatches(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT 'left_only' AS side, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS n
UNION ALL SELECT 'right_only', (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem))""")
def multiset_check(spark, sf):
    return records.multiset_difference(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def resume_latest(spark, sf):
    return records.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""WITH w AS (SELECT DISTINCT n AS namespace, sha256(text) AS key, text FROM documents, (VALUES ('m1'), ('m2')) AS v(n)), h AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'm2' ELSE 'm1' END AS namespace, sha256(text) AS key FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.namespace = w.namespace AND h.key = w.key)""")
def cache_misses(spark, sf):
    """Texts asked for under two models, of which each has some."""
    d = table(spark, sf, "documents")
    wanted = d.select(F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("namespace"), "text")
    have = d.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 4 == 0, "m2").otherwise("m1").alias("namespace"), F.sha2("text", 256).alias("key"))
    return records.cache_misses(wanted, have)


@query(r"""WITH p AS (SELECT 'docs/' || (page_id % 5) || '/f' || (page_id % 120) || '.json' AS path FROM pages GROUP BY 1), n AS (SELECT regexp_extract(path, '([^/]+)$', 1) AS f, count(*) AS n, min(path) AS one FROM p GROUP BY 1),
w AS (SELECT path AS file FROM p UNION SELECT f FROM n UNION SELECT 'none.json')
SELECT file, coalesce(p.path, CASE WHEN n.n = 1 THEN one END) AS path FROM w LEFT JOIN p ON p.path = file LEFT JOIN n ON n.f = file""")
def file_resolution(spark, sf):
    paths = table(spark, sf, "pages").select(F.concat(F.lit("docs/"), (F.col("page_id") % 5).cast("string"), F.lit("/f"), (F.col("page_id") % 120).cast("string"), F.lit(".json")).alias("path")).distinct()
    names = paths.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    wanted = paths.select(F.col("path").alias("file")).union(names).union(spark.range(1).select(F.lit("none.json").alias("file"))).distinct()
    return records.resolve_files(wanted, paths)


@query("""WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '["a", " b ", ""]' WHEN 1 THEN 'x.txt, y.txt' WHEN 2 THEN 'p, q,,r' ELSE 'one' || chr(10) || chr(10) || 'two' END AS v FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'x.txt, y.txt' WHEN 2 THEN 'p|q|r' ELSE 'one|two' END AS items FROM l""")
def list_fields(spark, sf):
    q = F.col("c_custkey") % 4
    v = F.when(q == 0, '["a", " b ", ""]').when(q == 1, "x.txt, y.txt").when(q == 2, "p, q,,r").otherwise("one\n\ntwo")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(readers.list_field(v), "|").alias("items"))


@query("SELECT p_partkey % 50 AS path, p_size AS page_id, string_agg(p_name, chr(10) || chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1, 2")
def page_texts(spark, sf):
    e = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("path"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("content"), F.array("p_size").alias("page_ids"))
    return readers.page_text(e)


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 8)::BIGINT AS batch FROM events")
def arrivals_micro_batches(spark, sf):
    return admission.micro_batches(table(spark, sf, "events").select("event_id"), "event_id", 8)


@query("""WITH f AS (SELECT label AS component, (1 + vec_id % 3)::DOUBLE AS share, unnest(range(0, 64)) AS dim, unnest(list_transform(embedding, lambda y: y::DOUBLE)) AS x FROM embeddings)
SELECT component, dim::INT AS dim, round(sum(share), 6) AS mass, round(sum(share * x), 6) AS first, round(sum(share * x * x), 6) AS second FROM f GROUP BY 1, 2""")
def online_statistics(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("component"), (1 + F.col("vec_id") % 3).cast("double").alias("share"), F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(admission.online_update(e, 64), "mass", "first", "second")


@query("""WITH w AS (SELECT p_partkey, 1 + p_partkey % 60 AS c0, p_size % 3 AS dc, 1 + p_size AS r0 FROM part), x AS (SELECT p_partkey, c0, r0, unnest(range(c0, c0 + dc + 1)) AS c FROM w), y AS (SELECT *, unnest(range(r0, r0 + 2)) AS r FROM x)
SELECT p_partkey, CASE WHEN c <= 26 THEN chr((64 + c)::INT) ELSE chr((64 + (c - 1) // 26)::INT) || chr((65 + (c - 1) % 26)::INT) END || r AS cell, (row_number() OVER (PARTITION BY p_partkey ORDER BY c, r) - 1)::INT AS pos FROM y""")
def a1_range_cells(spark, sf):
    """Cells of a range per part, columns before rows, across the step from Z to AA."""
    first, size = (1 + F.col("p_partkey") % 60).cast("int"), F.col("p_size")
    spec = F.concat(cells.column_name(first), F.lit("$"), (1 + size).cast("string"), F.lit(":"), cells.column_name(first + (size % 3).cast("int")), (2 + size).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(cells.range_cells(spec)).alias("pos", "cell"))


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS n, count(*) FILTER (passed) AS passed FROM res")
def run_summary(spark, sf):
    return results(spark, sf).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query("SELECT o_orderkey, 'L0_DYN_' || left(sha1('l0-dyn:i' || o_orderkey), 12) AS id FROM orders")
def dynamic_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", admission.grown_name(F.concat(F.lit("i"), F.col("o_orderkey").cast("string"))).alias("id"))

