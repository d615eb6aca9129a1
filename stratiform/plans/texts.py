"""Queries on texts: tokens, keys, clipping, hashes, chunks, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import budget, chunks, records
from .members import rounded
from .registry import query, table

TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
HASHED = """t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9_\\x{{4e00}}-\\x{{9fff}}]+')) AS w FROM {table}),
h AS (SELECT k, sha256(w) AS h FROM t),
v AS (SELECT k, (('0x' || h[1:8])::BIGINT % 384)::INT AS dim, sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY 1, 2 HAVING v <> 0),
n AS (SELECT k, sqrt(sum(v * v)) AS l FROM v GROUP BY 1)"""


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS n FROM documents")
def token_count_unicode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


@query(f"SELECT doc_id, CASE WHEN len({TOKENS}) > 20 THEN array_to_string({TOKENS}[1:20], ' ') ELSE text END AS head FROM documents")
def token_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_tokens(F.col("text"), 20).alias("head"))


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 AND n_chars > 0 THEN n_chars ELSE greatest(1, (length(text) + 3) // 4) END::BIGINT AS tokens FROM documents")
def token_cost_fallback(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_cost(F.col("text"), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars"))).alias("tokens"))


@query("""WITH m AS (SELECT doc_id, text, length(text) AS n, chr(10) || '...[truncated ' || (length(text) - 200) || ' chars]...' || chr(10) AS mark FROM documents)
SELECT doc_id, CASE WHEN n <= 200 THEN text ELSE left(text, (200 - length(mark)) // 2) || mark || right(text, 200 - length(mark) - (200 - length(mark)) // 2) END AS clipped FROM m""")
def clip_middle(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clip_total(F.col("text"), 200).alias("clipped"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 300) || chr(10) || chr(10) || '[WARNING: Output truncated. Showing first 300 and last 200 characters. ' || (length(text) - 500) || ' characters elided.]' || chr(10) || chr(10) || right(text, 200) END AS clipped FROM documents""")
def clip_ends(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clip_ends(F.col("text"), 1000, 300, 200).alias("clipped"))


@query("""WITH k AS (SELECT doc_id, replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 'ß', 'ss') AS t FROM documents)
SELECT min(doc_id) AS doc_id FROM k GROUP BY t""")
def dedup_text_key(spark, sf):
    return records.first_distinct(table(spark, sf, "documents"), "doc_id").select("doc_id")


@query("SELECT doc_id, sha256(text) AS sha, 'T_' || left(sha1(text), 10) AS short_id FROM documents")
def content_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), T.short_id("T_", F.col("text"), 10).alias("short_id"))


@query("""SELECT c_custkey, sha256('{"content": "' || c_mktsegment || '", "name": "' || c_name || '", "trigger": "' || c_nationkey || '"}') AS sha FROM customer""")
def node_content_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.content_hash(F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("sha"))


@query("WITH " + HASHED.format(key="doc_id", table="documents") + " SELECT k AS doc_id, dim, round(v / l, 6) AS value FROM v JOIN n USING (k)")
def hash_vector_sparse(spark, sf):
    return rounded(V.hashed_entries(table(spark, sf, "documents"), "doc_id", "text"), "value")


@query(f"""WITH t AS (SELECT doc_id, text, {TOKENS} AS t FROM documents), n AS (SELECT *, len(t) AS n FROM t),
s AS (SELECT doc_id, text, t, n, unnest(CASE WHEN n <= 200 THEN [0] ELSE range(0, greatest(n - 50 - 1, 0) + 1, 150) END) AS first FROM n)
SELECT doc_id, first // 150 AS chunk, first, least(first + 200, n) AS last, CASE WHEN n <= 200 THEN text ELSE array_to_string(t[first + 1 : first + 200], ' ') END AS text FROM s""")
def chunk_windows(spark, sf):
    return chunks.windows(table(spark, sf, "documents"), "doc_id", "text", 200, 50).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "text")


@query(f"""WITH t AS (SELECT doc_id, len({TOKENS}) AS n FROM documents), c AS (SELECT n, CASE WHEN n <= 200 THEN 1 ELSE len(range(0, greatest(n - 51, 0) + 1, 150)) END AS k FROM t)
SELECT count(*) AS texts, sum(k)::BIGINT AS chunks, max(n)::BIGINT AS max_tokens, round(avg(k), 6) AS mean_chunks, count(*) FILTER (k > 1) AS over_limit FROM c""")
def chunk_report(spark, sf):
    from ..operators import scoring

    cut = chunks.windows(table(spark, sf, "documents"), "doc_id", "text", 200, 50).groupBy("doc_id").agg(F.max("last").cast("long").alias("n_tokens"), F.count("*").alias("n_chunks"))
    return rounded(scoring.chunk_report(cut), "mean_chunks")


@query("""WITH x AS (SELECT label, vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS e FROM embeddings), f AS (SELECT label, vec_id % 7 + 1 AS w, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM x)
SELECT label, dim::INT AS dim, round(sum(w * x) / sum(w), 6) AS mean FROM f GROUP BY 1, 2""")
def pooled_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("w"), V.doubles(F.col("embedding")).alias("vec"))
    return rounded(chunks.pooled(e, "label", "vec", "w"), "mean")


@query("""WITH b AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, left(text, (5000 - before)::BIGINT) AS text FROM b WHERE before < 5000""")
def context_prefix_budget(spark, sf):
    return budget.prefix_within(table(spark, sf, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 5000)


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>x</think><answer> 2,602 ' || left(text, 20) || '</answer> then <answer>' || left(text, 30) || '</answer>' WHEN turn % 3 = 1 THEN text ELSE '<ANSWER>yes</ANSWER>' END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(regexp_replace(left(text, 30), '^\s+|\s+$', '', 'g')) WHEN turn % 3 = 1 THEN '' ELSE 'yes' END AS answer FROM c JOIN conversations USING (conv_id, turn)""")
def answer_extract(spark, sf):
    c = table(spark, sf, "conversations")
    third = F.col("turn") % 3
    t = F.when(third == 0, F.concat(F.lit("<think>x</think><answer> 2,602 "), F.left("text", F.lit(20)), F.lit("</answer> then <answer>"), F.left("text", F.lit(30)), F.lit("</answer>"))).when(third == 1, F.col("text")).otherwise("<ANSWER>yes</ANSWER>")
    return c.select("conv_id", "turn", T.answer(t).alias("answer"))


NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[!"#$&''()*+,/:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\b(million|millions|billion|billions|dollars|dollar|nominal)\b', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT item_id, {NORMAL.format(x='text')} AS answer FROM benchmark")
def answer_normalise(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.normal_answer(F.col("text")).alias("answer"))


@query(f"""WITH p AS (SELECT a.item_id, {NORMAL.format(x='a.text')} AS x, {NORMAL.format(x='b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 4),
l AS (SELECT item_id, list_filter(string_split(x, ' '), lambda w: w <> '') AS x, list_filter(string_split(y, ' '), lambda w: w <> '') AS y FROM p),
c AS (SELECT item_id, x, y, list_sum(list_transform(list_intersect(x, y), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS n FROM l)
SELECT item_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN CASE WHEN len(x) = len(y) THEN 1.0 ELSE 0.0 END ELSE 2.0 * coalesce(n, 0) / (len(x) + len(y)) END::DOUBLE, 6) AS f1, (x = y)::INT::DOUBLE AS em FROM c""")
def token_f1(spark, sf):
    b = table(spark, sf, "benchmark")
    pair = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") - F.col("a.item_id") % 4)
    return rounded(pair.select("a.item_id", T.token_f1(F.col("a.text"), F.col("b.text")).alias("f1"), T.exact_match(F.col("a.text"), F.col("b.text")).alias("em")), "f1")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '\\p{L}') THEN 'numeric_like' WHEN regexp_matches(t, '[0-9]') THEN 'contains_digit' ELSE 'text' END AS term_class,
CASE WHEN (length(lower(trim(t))) >= 4 OR (regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '\\p{L}'))) AND regexp_matches(t, '[\\p{L}\\p{N}]') THEN lower(trim(t)) END AS term
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '--' ELSE ' Ab' END AS t FROM part)""")
def term_classes(spark, sf):
    q = F.col("p_partkey") % 4
    t = F.when(q == 0, F.col("p_name")).when(q == 1, F.col("p_size").cast("string")).when(q == 2, "--").otherwise(" Ab")
    return table(spark, sf, "part").select("p_partkey", T.term_class(t).alias("term_class"), T.forbidden_term(t).alias("term"))
