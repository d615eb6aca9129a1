"""Queries on what is written and read back, on fingerprints, routing, hooks and admission."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evidence, hierarchy
from ..sources import readers, sinks
from ..sources.scratch import new_path
from ..streaming import admission, routing
from .logs import _records
from .members import doc_edges, doc_items, rounded
from .registry import query, table
from .vectors import E_SQL, vectors

c, lit = F.col, F.lit


def text(x):
    return c(x).cast("string") if isinstance(x, str) else x.cast("string")


# ---- records, splits, logs ---------------------------------------------------------------------


@query("""SELECT 'r' || o_custkey AS trajectory_id, 'do ' || o_custkey AS instruction, o_custkey % 2 = 0 AS success, 0.5::DOUBLE AS verifier_score, count(*)::INT AS steps, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def record_files(spark, sf):
    """Run records written as JSON and read under their schema."""
    at = new_path(spark, "records")
    sinks.write_records(_records(spark, sf), at)
    r = readers.read_records(spark, at, lines=True)
    return r.select("trajectory_id", "instruction", "success", "verifier_score", F.size("steps").alias("steps"), F.trim(F.element_at("steps", lit(-1))["action"]).alias("last"))


@query("""SELECT 'd' || doc_id AS uid, 'what is ' || doc_id AS question, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS ground_truth, CASE doc_id % 2 WHEN 0 THEN source ELSE 'qa' END AS task_type, 'a' || doc_id || '.txt|b.txt' AS files FROM documents""")
def qa_split(spark, sf):
    """Questions under other names, with blanks and lists in text."""
    n = c("doc_id")
    d = table(spark, sf, "documents").select(lit("").alias("uid"), F.concat(lit(" d"), text(n)).alias("id"), F.concat(lit("what is "), text(n)).alias("question"), F.when(n % 3 != 0, c("lang")).otherwise("  ").alias("answer"), F.when(n % 2 == 0, c("source")).alias("category"), F.concat(lit("a"), text(n), lit(".txt\n\n b.txt")).alias("source_files"), lit(None).cast("string").alias("source_docs"))
    return readers.qa_split(d).select("uid", "question", "ground_truth", "task_type", F.array_join("source_files", "|").alias("files"))


@query("""SELECT component, count(*) AS events, sum(tokens)::BIGINT AS tokens FROM (SELECT event_type AS component, (props->>'$.k')::BIGINT AS tokens FROM events UNION ALL SELECT event_type, 7 FROM events WHERE event_id % 10 = 0) GROUP BY 1""")
def log_append(spark, sf):
    """A usage log that is appended to twice."""
    at = new_path(spark, "usage")
    e = table(spark, sf, "events").select(c("event_type").alias("component"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), "event_id")
    sinks.append_log(e.drop("event_id"), at)
    sinks.append_log(e.where("event_id % 10 = 0").select("component", lit(7).cast("long").alias("tokens")), at)
    return spark.read.schema("component string, tokens long").json(at).groupBy("component").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"))


@query("SELECT sha256(string_agg('s' || p_partkey || '=' || p_name, chr(10) ORDER BY 's' || p_partkey)) AS fingerprint FROM part")
def config_fingerprint(spark, sf):
    return sinks.config_fingerprint(table(spark, sf, "part").select(F.concat(lit("s"), text("p_partkey")).alias("name"), c("p_name").alias("value")))


@query("""SELECT count(*) AS nodes, sum(('0x' || sha256('n' || doc_id || chr(10) || sha256(text))[1:15])::HUGEINT)::VARCHAR AS digest, 'm' AS model, 'p' AS protocol FROM documents""")
def index_fingerprint(spark, sf):
    n = table(spark, sf, "documents").select(F.concat(lit("n"), text("doc_id")).alias("node_id"), F.sha2("text", 256).alias("sha256"))
    return sinks.index_fingerprint(n, "m", "p")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, repeat(l_returnflag, (l_partkey % 30 + 1)::INT) AS s FROM lineitem), o AS (SELECT l_orderkey, list(s ORDER BY l_linenumber, s) AS s, count(*) AS n FROM l GROUP BY 1), f AS (SELECT *, array_to_string(s, chr(10)) AS a, array_to_string(list_concat(list_concat(s[1:2], ['...']), s[n - 1:n]), chr(10)) AS b FROM o)
SELECT l_orderkey, CASE WHEN length(a) <= 90 THEN a WHEN n <= 4 THEN left(a, 20) || '|' || right(a, 20) WHEN length(b) <= 90 THEN b ELSE left(b, 20) || '|' || right(b, 20) END AS view FROM f""")
def compact_views(spark, sf):
    """Steps within 90 characters: all of them, else the first and last two, else a clipped rest."""
    line = F.repeat("l_returnflag", (c("l_partkey") % 30 + 1).cast("int"))
    held = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("s")))), lambda x: x["s"]).alias("s"))
    shown = held.select("l_orderkey", "s", evidence.compact_view(c("s"), 90, 4, 2000).alias("v"))
    clipped = F.contains("v", lit("[truncated "))
    return shown.select("l_orderkey", F.when(clipped, F.concat(F.left("v", lit(20)), lit("|"), F.right("v", lit(20)))).otherwise(c("v")).alias("view"))


# ---- layers, hooks -----------------------------------------------------------------------------


@query("""WITH e AS (SELECT doc_id, source AS community_id, 0.75 AS w FROM documents UNION ALL SELECT doc_id, lang, 0.25 FROM documents)
SELECT community_id, count(DISTINCT doc_id) AS size, round(sum((1 + doc_id % 3) * w), 6) AS support_mass, sum(n_chars)::BIGINT AS token_cost, 4 AS level FROM e JOIN documents USING (doc_id) GROUP BY 1""")
def layer_communities(spark, sf):
    return rounded(hierarchy.describe(doc_items(spark, sf), doc_edges(spark, sf), 4), "support_mass")


@query("""WITH m AS (SELECT label, count(*) AS n, sum(1 + vec_id % 2)::DOUBLE AS mass FROM embeddings GROUP BY 1 HAVING count(*) > 1), k AS (SELECT *, unnest([1, 3]) AS j FROM m)
SELECT 'C' || label AS source_community_id, 'n' || n || '_' || j AS name, 'L3_' || left(sha1('C' || label || chr(10) || 'n' || n || '_' || j || chr(10) || 'text'), 12) AS item_id, round(mass * j / 4, 6) AS support_mass, 3 AS level FROM k""")
def card_hook(spark, sf):
    """Cards that a user's function makes of communities and their members: two each, shared by confidence."""
    v = vectors(spark, sf)
    items = v.select(c("vec_id").alias("item_id"), "vec", (1 + c("vec_id") % 2).cast("double").alias("support_mass"), lit(10).cast("long").alias("tokens"))
    members = v.select(c("vec_id").alias("item_id"), F.concat(lit("C"), text("label")).alias("community_id"), lit(1.0).alias("w"))

    def make(communities, held):
        n = held.groupBy("community_id").agg(F.count("*").alias("n"))
        two = communities.join(n, "community_id").select("community_id", "n", F.explode(F.array(lit(1), lit(3))).alias("j"))
        return two.select("community_id", F.concat(lit("n"), text("n"), lit("_"), text("j")).alias("name"), lit("text").alias("content"), c("j").cast("double").alias("confidence"))

    cards = hierarchy.cards_of(items, members, hierarchy.describe(items, members, 2), 2, make)
    return rounded(cards.select("source_community_id", "name", "item_id", "support_mass", "level"), "support_mass")


@query("""SELECT event_id, event_id % 5 NOT IN (1, 2, 3) AS finite FROM events""")
def vector_checks(spark, sf):
    k = c("event_id") % 5
    x = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k != 3, c("value"))
    return table(spark, sf, "events").select("event_id", V.finite(F.array(lit(1.0), x)).alias("finite"))


# ---- routing and admission ---------------------------------------------------------------------

_AXES = np.eye(3, 64)
_AXES_SQL = "a AS (SELECT vec_id, [e[1] / l, e[2] / l, e[3] / l] AS s FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS l FROM x))"


@query(f"""WITH {E_SQL}, {_AXES_SQL}, r AS (SELECT vec_id, exp(8 * s[1]) AS p, exp(8 * s[2]) AS q FROM a), t AS (SELECT vec_id, exp(8 * s[1]) AS p, exp(8 * s[3]) AS q FROM a),
w AS (SELECT r.vec_id, 0.5 * r.p / (r.p + r.q) AS left_w, 0.5 * r.q / (r.p + r.q) AS right_w, t.p / (t.p + t.q) AS ll FROM r JOIN t USING (vec_id))
SELECT vec_id::VARCHAR AS item_id, unnest(['A', 'B', 'L', 'other']) AS community_id, round(unnest([left_w * ll, right_w, left_w * (1 - ll), 0.25]), 6) AS w FROM w""")
def routing_tree(spark, sf):
    """Vectors through two routers, one of which has an excluded branch; a coarse community without a tree stays."""
    tree = {
        "root": routing.Node("router", children=("left", "B", "gone"), centroids=_AXES),
        "left": routing.Node("router", children=("A", "L"), centroids=_AXES[[0, 2]]),
        "gone": routing.Node("excluded"),
        **{n: routing.Node("leaf", community=n) for n in ("A", "B", "L")},
    }
    v = vectors(spark, sf).select(text("vec_id").alias("item_id"), "vec")
    edge = lambda name, w: v.withColumns({"community_id": lit(name), "w": lit(w)})
    return rounded(routing.route(edge("C0", 0.5).unionByName(edge("other", 0.25)), {"C0": "root"}, tree), "w")


@query("""SELECT * FROM (VALUES (0, 'x', 'joined', 'C1', NULL::DOUBLE, 0.5::DOUBLE), (0, 'x', 'joined', 'C2', 0.5, 0.5), (1, 'x', 'joined', 'C1', 0.5, 0.5), (1, 'x', 'joined', 'C2', 0.5, 0.5),
(2, 'x', 'grown', 'L0_DYN_' || left(sha1('l0-dyn:x'), 12), 1.0, 1.0), (3, 'x', 'excluded_oversize', NULL, NULL, NULL)) AS t("case", item_id, status, community_id, selected_w, posterior_w)""")
def admission_cases(spark, sf):
    """One arrival between two communities: room in one, in both, in none, and an arrival over the budget."""
    out = None
    for case, (loads, tokens) in enumerate((((45, 20), 10), ((20, 20), 10), ((45, 45), 10), ((20, 20), 51))):
        state = admission.LevelState(["C1", "C2"], np.array([0.5, 0.5]), np.eye(2), np.ones((2, 2)), np.ones(2), np.array(loads))
        at = new_path(spark, "case")
        admission.admit_batch(state, spark.createDataFrame([("x", [0.5, 0.5], tokens, 0)], "item_id string, vec array<double>, tokens long, pos long"), 50, f"{at}/batch=0")
        got = admission.admitted(spark, at).select(lit(case).alias("case"), "item_id", "status", "community_id", F.round("selected_w", 6).alias("selected_w"), F.round("posterior_w", 6).alias("posterior_w"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""SELECT count(DISTINCT user_id) AS arrivals, count(DISTINCT user_id) FILTER (user_id % 4 <> 0) AS updated, count(DISTINCT user_id) FILTER (user_id % 4 = 0) AS excluded FROM events""")
def arrival_accounting(spark, sf):
    status = F.when(c("user_id") % 4 == 0, "excluded_oversize").when(c("user_id") % 4 == 1, "grown").otherwise("joined")
    return admission.accounting(table(spark, sf, "events").select(c("user_id").alias("item_id"), status.alias("status")))


@query("""WITH RECURSIVE t AS (SELECT r_regionkey AS root, 'R' || r_regionkey AS node FROM region UNION SELECT t.root, e.child FROM t JOIN (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION SELECT 'N' || c_nationkey, 'S' || c_mktsegment FROM customer) e ON e.parent = t.node) SELECT 'R' || root AS root, node FROM t""")
def reachability(spark, sf):
    """What lies below each region: nations, and the segments of their customers."""
    nations = table(spark, sf, "nation").select(F.concat(lit("R"), text("n_regionkey")).alias("parent"), F.concat(lit("N"), text("n_nationkey")).alias("child"))
    segments = table(spark, sf, "customer").select(F.concat(lit("N"), text("c_nationkey")).alias("parent"), F.concat(lit("S"), "c_mktsegment").alias("child")).distinct()
    return hierarchy.reachable(nations.unionByName(segments), table(spark, sf, "region").select(F.concat(lit("R"), text("r_regionkey")).alias("node")))
