"""Queries on memberships, masses, outcomes and the choice of K."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mass, membership, selection
from .registry import query, table

EDGES_SQL = """c AS (SELECT user_id AS item_id, event_type AS community_id, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT item_id, community_id, n / sum(n) OVER (PARTITION BY item_id) AS w FROM c)"""
RANKED_SQL = f"""WITH {EDGES_SQL}, r AS (
  SELECT *, row_number() OVER o AS rk, first_value(w) OVER o AS best,
    coalesce(sum(w) OVER (PARTITION BY item_id ORDER BY w DESC, community_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e WINDOW o AS (PARTITION BY item_id ORDER BY w DESC, community_id))"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each type in a user's events: soft edges that sum to one."""
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("item_id"), F.col("event_type").alias("community_id")).agg(F.count("*").alias("n"))
    total = n.groupBy("item_id").agg(F.sum("n").alias("t"))
    return n.join(total, "item_id").select("item_id", "community_id", (F.col("n") / F.col("t")).alias("w"))


ITEMS_SQL = """items AS (SELECT d.doc_id AS item_id, 1.0 + d.doc_id % 3 AS support_mass, d.n_chars AS tokens, l.quality = 1 AS success
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)),
m AS (SELECT doc_id AS item_id, source AS community_id, 0.75::DOUBLE AS w FROM documents
  UNION ALL SELECT doc_id, lang, 0.25::DOUBLE FROM documents)"""


def doc_items(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("item_id"), (1.0 + F.col("doc_id") % 3).alias("support_mass"), F.col("n_chars").alias("tokens"), (F.col("quality") == 1).alias("success"))


def doc_edges(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("community_id"), F.lit(0.75).alias("w")).unionByName(docs.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("community_id"), F.lit(0.25).alias("w")))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"{RANKED_SQL} SELECT item_id, community_id, 1.0::DOUBLE AS w FROM r WHERE rk = 1")
def member_argmax(spark, sf):
    return membership.argmax_members(edges(spark, sf))


@query(f"{RANKED_SQL} SELECT item_id, community_id, round(w, 6) AS w FROM r WHERE rk = 1 OR (rk <= 3 AND w >= 0.1 AND best - w <= 0.2)")
def member_top_r(spark, sf):
    return rounded(membership.top_r_members(edges(spark, sf), 3, 0.1, 0.2), "w")


@query(f"{RANKED_SQL} SELECT item_id, community_id, round(w, 6) AS w FROM r WHERE rk = 1 OR (best - w <= 0.25 AND (rk = 2 OR before < 0.9))")
def member_cumulative(spark, sf):
    return rounded(membership.cumulative_members(edges(spark, sf)), "w")


@query(f"""WITH {EDGES_SQL}, k AS (SELECT * FROM e WHERE w > 0.15), r AS (
  SELECT *, row_number() OVER o AS rk, first_value(w) OVER o AS best,
    coalesce(sum(w) OVER (PARTITION BY item_id ORDER BY w DESC, community_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k WINDOW o AS (PARTITION BY item_id ORDER BY w DESC, community_id))
SELECT item_id, community_id, round(w, 6) AS w FROM r WHERE rk = 1 OR (best - w <= 0.25 AND (rk = 2 OR before < 0.9))""")
def member_cumulative_masked(spark, sf):
    return rounded(membership.cumulative_members(edges(spark, sf), least=0.15), "w")


@query(f"{RANKED_SQL} SELECT item_id, community_id FROM r WHERE rk = 1")
def primary_community(spark, sf):
    return membership.primary(edges(spark, sf))


@query("SELECT c_custkey AS item_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0) AND c_nationkey <> 3")
def uncovered_items(spark, sf):
    items = table(spark, sf, "customer")
    gone = items.where("c_nationkey = 3").select(F.col("c_custkey").alias("item_id"))
    return membership.uncovered(items.select(F.col("c_custkey").alias("item_id")), table(spark, sf, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("item_id")), gone)


@query(f"WITH {ITEMS_SQL} SELECT community_id, round(sum(support_mass * w), 6) AS support_mass FROM m JOIN items USING (item_id) GROUP BY 1")
def support_mass(spark, sf):
    return rounded(mass.support_mass(doc_items(spark, sf), doc_edges(spark, sf)), "support_mass")


@query(f"""WITH {ITEMS_SQL}, o AS (SELECT community_id, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count FROM m JOIN items USING (item_id) GROUP BY 1)
SELECT *, CASE WHEN success_count > 0 AND failure_count = 0 THEN 'success' WHEN failure_count > 0 AND success_count = 0 THEN 'failure' ELSE 'mixed' END AS outcome_mode FROM o""")
def outcome_mode(spark, sf):
    return mass.outcomes(doc_items(spark, sf), doc_edges(spark, sf))


@query("""WITH co AS (SELECT source AS s, sum(n_chars)::DOUBLE AS ms FROM documents GROUP BY 1)
SELECT doc_id AS item_id, source AS source_community_id, round(ms * (1 + doc_id % 5) / sum(1 + doc_id % 5) OVER (PARTITION BY source), 6) AS support_mass FROM documents JOIN co ON source = s""")
def mass_redistribute(spark, sf):
    docs = table(spark, sf, "documents")
    co = docs.groupBy(F.col("source").alias("community_id")).agg(F.sum("n_chars").cast("double").alias("support_mass"))
    cards = docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("source_community_id"), (1 + F.col("doc_id") % 5).cast("double").alias("confidence"))
    return rounded(mass.redistribute(co, cards), "support_mass")


@query(f"WITH {ITEMS_SQL} SELECT item_id, round(support_mass * count(*) OVER () / sum(support_mass) OVER (), 6) AS w FROM items")
def sample_weights(spark, sf):
    return rounded(mass.sample_weights(doc_items(spark, sf)), "w")


@query(f"WITH {ITEMS_SQL}, w AS (SELECT support_mass * count(*) OVER () / sum(support_mass) OVER () AS w FROM items) SELECT count(*) AS n, round(sum(w), 6) AS sum_w, round(min(w), 6) AS min_w, round(max(w), 6) AS max_w FROM w")
def sample_weight_stats(spark, sf):
    return rounded(mass.weight_stats(mass.sample_weights(doc_items(spark, sf))), "sum_w", "min_w", "max_w")


@query(f"WITH {ITEMS_SQL} SELECT community_id, sum(tokens)::BIGINT AS token_cost FROM (SELECT DISTINCT community_id, item_id FROM m) JOIN items USING (item_id) GROUP BY 1")
def token_cost(spark, sf):
    return mass.token_costs(doc_items(spark, sf), doc_edges(spark, sf))


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT community_id, sum(support_mass * w) AS x FROM m JOIN items USING (item_id) GROUP BY 1)
SELECT count(*) AS communities, round(max(abs(x - round(x, 1))), 6) AS max_error, round(sum(abs(x - round(x, 1))), 6) AS sum_error FROM a""")
def mass_conservation(spark, sf):
    now = mass.support_mass(doc_items(spark, sf), doc_edges(spark, sf))
    return rounded(mass.conservation(now.withColumn("support_mass", F.round("support_mass", 1)), now), "max_error", "sum_error")


@query(f"WITH {EDGES_SQL} SELECT members, count(*) AS communities FROM (SELECT item_id, count(DISTINCT community_id) AS members FROM e GROUP BY 1) GROUP BY 1")
def level_histogram(spark, sf):
    return mass.community_sizes(edges(spark, sf).select(F.col("item_id").alias("community_id"), F.col("community_id").alias("item_id")))


@query("""WITH k AS (SELECT doc_id, source, replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 'ß', 'ss') AS t FROM documents),
s AS (SELECT t, min(doc_id) AS doc_id, count(*) AS n FROM k GROUP BY 1)
SELECT source, count(*) FILTER (n = 1) AS singletons, count(*) AS distinct_texts FROM s JOIN documents USING (doc_id) GROUP BY 1""")
def singleton_stats(spark, sf):
    docs = table(spark, sf, "documents")
    s = docs.groupBy(T.text_key(F.col("text")).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return s.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count("*").alias("distinct_texts"))


@query("SELECT n_nationkey AS n, CASE WHEN n_nationkey < 2 THEN 1 ELSE greatest(1, least(64, floor(n_nationkey / 2.0), n_nationkey)) END::BIGINT AS kmax FROM nation")
def kmax_bound(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), selection.kmax(F.col("n_nationkey").cast("long")).alias("kmax"))


FITS_SQL = """fits AS (SELECT c_nationkey AS grp, (c_custkey % 12 + 1)::BIGINT AS k, min(c_acctbal)::DOUBLE AS score, min(c_custkey) % 4 <> 0 AS valid FROM customer GROUP BY 1, 2)"""


def fits(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up fits per nation: k, a score, and whether the fit counts."""
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("grp"), (F.col("c_custkey") % 12 + 1).cast("long").alias("k")).agg(F.min("c_acctbal").cast("double").alias("score"), (F.min("c_custkey") % 4 != 0).alias("valid"))


@query(f"""WITH {FITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY valid DESC, CASE WHEN valid THEN score END, k) AS rn, lead(CASE WHEN valid THEN score END) OVER (PARTITION BY grp ORDER BY valid DESC, CASE WHEN valid THEN score END, k) AS nxt FROM fits)
SELECT grp, k, round(score, 6) AS bic, CASE WHEN valid THEN round(nxt - score, 6) END AS margin FROM r WHERE rn = 1""")
def k_choice(spark, sf):
    return rounded(selection.choose_bic(fits(spark, sf).withColumnRenamed("score", "bic"), "grp"), "bic", "margin")


@query(f"""WITH {FITS_SQL}, e AS (SELECT *, first_value(k) OVER o AS k0, last_value(k) OVER o AS k1, first_value(score) OVER o AS s0, last_value(score) OVER o AS s1, min(score) OVER (PARTITION BY grp) AS lo, max(score) OVER (PARTITION BY grp) AS hi, count(*) OVER (PARTITION BY grp) AS n
  FROM fits WINDOW o AS (PARTITION BY grp ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, (k - k0) / greatest(1, k1 - k0) AS x, (score - lo) / CASE WHEN hi - lo <= 1e-12 THEN 1 ELSE hi - lo END AS y, (s0 - lo) / CASE WHEN hi - lo <= 1e-12 THEN 1 ELSE hi - lo END AS y0, (s1 - lo) / CASE WHEN hi - lo <= 1e-12 THEN 1 ELSE hi - lo END AS y1 FROM e),
d AS (SELECT *, round(abs((y1 - y0) * x - y + y0) / sqrt((y1 - y0) * (y1 - y0) + 1), 12) AS d FROM u)
SELECT grp, CASE WHEN any_value(n) <= 2 THEN any_value(k1) WHEN any_value(hi - lo) <= 1e-12 THEN any_value(k0) ELSE arg_min(k, (-d, k)) END AS k FROM d GROUP BY grp""")
def elbow_choice(spark, sf):
    return selection.choose_elbow(fits(spark, sf), "grp")


@query(f"WITH {FITS_SQL} SELECT grp, arg_min(k, (abs(k - 8), k)) AS k FROM fits GROUP BY 1")
def fixed_k_choice(spark, sf):
    return selection.choose_fixed(fits(spark, sf), "grp", 8)


@query(f"""WITH {FITS_SQL} SELECT grp, k, round(-2 * score + ((k - 1) + k * 8 + k) * ln(greatest(1.0, 1000.0)), 6) AS bic FROM fits""")
def bic_from_fit(spark, sf):
    f = fits(spark, sf)
    return rounded(f.select("grp", "k", selection.bic(F.col("score"), selection.parameters(F.col("k"), F.lit(8), "spherical"), F.lit(1000.0)).alias("bic")), "bic")


@query("""SELECT 'level_mismatch' AS kind, 2 AS level, n_name AS id FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'support_mass', CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 2 END, n_name FROM nation WHERE n_nationkey = 7
UNION ALL SELECT 'no_card', 2, r_name FROM region""")
def hierarchy_violations(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    items = n.select(F.col("n_name").alias("item_id"), F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(2).alias("level"), F.lit("trajectory").alias("kind"), F.lit(None).cast("string").alias("source_community_id"), F.when(F.col("n_nationkey") == 7, 0.0).otherwise(1.0).alias("support_mass"))
    co = r.select(F.col("r_name").alias("community_id"), F.lit(2).alias("level"))
    sel = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("item_id"), F.col("r_name").alias("community_id"))
    return membership.violations(items, co, sel, sel)
