"""Queries on the hierarchy's tables: checks, commits, snapshots, banks, propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bank, mass, selection
from ..operators import state as S
from ..sources import readers, sinks
from ..sources.scratch import kept, new_path
from ..streaming import propagation
from .members import doc_edges, doc_items, rounded
from .registry import query, table

c, lit = F.col, F.lit


def text(x):
    return c(x).cast("string") if isinstance(x, str) else x.cast("string")


# ---- a small hierarchy over parts: 40 communities by key, two cards of each


def _vec(x):
    return F.array(x.cast("double"), lit(1.0))


def level0(spark, sf):
    """Items, communities, members and cards of level 0."""
    p = table(spark, sf, "part")
    n, com = c("p_partkey"), F.concat(lit("L0_C"), text(c("p_partkey") % 40))
    none = lambda kind, name: lit(None).cast(kind).alias(name)
    items = p.select(F.concat(lit("i"), text(n)).alias("item_id"), lit(0).alias("level"), lit(S.TRAJECTORY).alias("kind"), c("p_name").alias("text"), _vec(n).alias("vec"), (1 + n % 3).cast("double").alias("support_mass"), none("double", "confidence"), none("string", "source_community_id"), lit(0).alias("version"))
    members = p.select(lit(0).alias("level"), com.alias("community_id"), F.concat(lit("i"), text(n)).alias("item_id"), F.when(n % 2 == 0, 1.0).otherwise(0.5).alias("w"), lit(1.0).alias("posterior"))
    k = p.select((n % 40).alias("k")).distinct()
    communities = k.select(F.concat(lit("L0_C"), text("k")).alias("community_id"), lit(0).alias("level"), none("double", "support_mass"), F.when(c("k") % 10 == 9, F.create_map(lit("llm_summary_skipped"), lit("true"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    two = k.where("k % 10 <> 9").select("k", F.explode(F.array(lit(1), lit(2))).alias("j"))
    cards = two.select(F.concat(lit("c"), text("k"), lit("_"), text("j")).alias("item_id"), lit(1).alias("level"), lit(S.CARD).alias("kind"), F.concat(lit("card "), text("k")).alias("text"), _vec(c("k")).alias("vec"), none("double", "support_mass"), c("j").cast("double").alias("confidence"), F.concat(lit("L0_C"), text("k")).alias("source_community_id"), lit(0).alias("version"))
    return items, communities, members, cards


def committed(spark, sf):
    items, communities, members, cards = level0(spark, sf)
    return S.committed(S.initialised(items), 0, communities, members, cards, "split")


MASS_SQL = "m AS (SELECT p_partkey % 40 AS k, sum((1 + p_partkey % 3) * CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END)::DOUBLE AS mass FROM part GROUP BY 1)"


@query(f"""WITH {MASS_SQL} SELECT 'card' AS what, 'c' || k || '_' || j AS id, round(mass * j / 3, 6) AS support_mass FROM m, (SELECT unnest([1, 2]) AS j) WHERE k % 10 <> 9
UNION ALL SELECT 'community', 'L0_C' || k, round(mass, 6) FROM m UNION ALL SELECT 'item', 'i' || p_partkey, (1 + p_partkey % 3)::DOUBLE FROM part UNION ALL SELECT 'layer', '0 split', NULL""")
def level_commit(spark, sf):
    """A level committed twice: what the first commit put above it is dropped by the second."""
    items, communities, members, cards = level0(spark, sf)
    first = committed(spark, sf)
    s = S.committed(first, 0, communities, members, cards, "split")
    rows = [s.items.select(F.when(c("kind") == S.CARD, "card").otherwise("item").alias("what"), c("item_id").alias("id"), "support_mass"), s.communities.select(lit("community").alias("what"), c("community_id").alias("id"), "support_mass"), s.layers.select(lit("layer").alias("what"), F.concat_ws(" ", text("level"), "stop_reason").alias("id"), lit(None).cast("double").alias("support_mass"))]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), "support_mass")


@query(f"WITH {MASS_SQL} SELECT k, round(mass, 6) AS mass, count(*) AS items, 2 * (k % 10 <> 9)::INT AS cards FROM m JOIN part ON p_partkey % 40 = k GROUP BY 1, 2, 4")
def snapshot_round_trip(spark, sf):
    """A state saved as batches 3 and 12 without vectors, and the last read back with them."""
    s, at = committed(spark, sf), new_path(spark, "snapshots")
    S.saved(S.initialised(level0(spark, sf)[0]), at, 3)
    bare = S.State(s.items.withColumn("vec", F.when(c("level") == 1, c("vec"))), s.communities, s.members, s.layers)
    S.saved(bare, at, 12)
    got, batch = S.restored(spark, at, s.items.select("item_id", "vec"))
    held = got.members.groupBy("community_id").agg(F.count("*").alias("items"))
    cards = S.cards_of(got.items, got.communities).groupBy("community_id").agg(F.count("*").cast("int").alias("cards"))
    out = got.communities.join(held, "community_id").join(cards, "community_id", "left").where(lit(batch) == 12)
    return rounded(out.select(F.substring("community_id", 5, 9).cast("long").alias("k"), c("support_mass").alias("mass"), "items", F.coalesce("cards", lit(0)).alias("cards")), "mass")


@query("""SELECT CASE p_partkey % 6 WHEN 1 THEN 'repeated' WHEN 2 THEN 'known' WHEN 3 THEN 'kind' WHEN 4 THEN 'level' WHEN 5 THEN 'no_vector' END AS fault, 'a' || p_partkey AS item_id FROM part WHERE p_partkey % 6 <> 0""")
def arrival_validation(spark, sf):
    n = c("p_partkey")
    p = table(spark, sf, "part").select(F.concat(lit("a"), text(n)).alias("item_id"), F.when(n % 6 == 3, S.CARD).otherwise(S.TRAJECTORY).alias("kind"), F.when(n % 6 == 4, 1).otherwise(0).alias("level"), F.when(n % 6 == 5, F.array().cast("array<double>")).otherwise(F.array(lit(1.0))).alias("vec"), (n % 6).alias("k"))
    known = p.where("k = 2")
    return S.arrival_faults(p.unionByName(p.where("k = 1")), known)


@query("""WITH k AS (SELECT n_nationkey AS k FROM nation) SELECT CASE k % 7 WHEN 0 THEN 'no_card' WHEN 1 THEN 'kind' WHEN 2 THEN 'level' WHEN 3 THEN 'no_vector' WHEN 4 THEN 'confidence' WHEN 5 THEN 'repeated' END AS fault, 'C' || k AS community_id, CASE k % 7 WHEN 0 THEN NULL ELSE 'x' || k END AS item_id FROM k WHERE k % 7 <> 6 AND k <> 7
UNION ALL SELECT 'source', 'other', 'y' || k FROM k WHERE k % 7 = 6""")
def card_validation(spark, sf):
    """Cards at fault in one way each; community 7 is excused from giving one."""
    k = c("n_nationkey")
    n = table(spark, sf, "nation").select(k.alias("k"))
    com = n.where("k % 7 <> 6").select(F.concat(lit("C"), text("k")).alias("community_id"), lit(2).alias("level"), F.when(c("k") == 7, F.create_map(lit("oversize_singleton"), lit("True"))).otherwise(F.create_map(lit("llm_summary_skipped"), lit("false"))).alias("metadata"))
    kind = c("k") % 7
    made = n.where("k % 7 BETWEEN 1 AND 5").select(F.concat(lit("x"), text("k")).alias("item_id"), F.when(kind == 1, S.TRAJECTORY).otherwise(S.CARD).alias("kind"), F.when(kind == 2, 2).otherwise(3).alias("level"), F.concat(lit("C"), text("k")).alias("source_community_id"), F.when(kind != 3, F.array(lit(1.0))).alias("vec"), F.when(kind == 4, float("inf")).otherwise(1.0).alias("confidence"))
    other = n.where("k % 7 = 6").select(F.concat(lit("y"), text("k")).alias("item_id"), lit(S.CARD).alias("kind"), lit(1).alias("level"), lit("other").alias("source_community_id"), F.array(lit(1.0)).alias("vec"), lit(1.0).alias("confidence"))
    return S.card_faults(com, made.unionByName(made.where("item_id IN ('x5', 'x12', 'x19')")).unionByName(other))


@query("""SELECT n_nationkey AS k, n_nationkey % 4 IN (0, 2, 3) AS build, n_nationkey % 4 IN (0, 1, 2, 3) AS commit, n_nationkey % 4 IN (0, 1, 2) AS diagnostic FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT n_nationkey, false, false, false FROM nation WHERE n_nationkey % 5 = 0""")
def synthesis_skips(spark, sf):
    """Which metadata excuse a community, by who asks: build, commit and diagnosis differ."""
    k = c("n_nationkey")
    flag = F.when(k % 4 == 0, "llm_summary_skipped").when(k % 4 == 1, "dynamic_llm_summary_skipped").when(k % 4 == 2, "oversize_singleton").otherwise("higher_level_abstraction_skipped")
    m = F.create_map(flag, F.when(k % 5 == 0, "").otherwise("yes"))
    return table(spark, sf, "nation").select(k.alias("k"), *(S.skips_synthesis(m, who).alias(who) for who in S.SKIPS))


@query("""WITH m AS (SELECT p_partkey % 40 AS k, list('i' || p_partkey ORDER BY 'i' || p_partkey) AS items FROM part GROUP BY 1)
SELECT 'L0_C' || k AS community_id, 'raw_extractor' AS mode, 'update,add' AS operations, array_to_string(items, ',') AS items, CASE WHEN k % 10 = 9 THEN '' ELSE 'c' || k || '_1,c' || k || '_2' END AS previous FROM m""")
def synthesis_payloads(spark, sf):
    s = committed(spark, sf)
    ids = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["item_id"]), ","), lit(""))
    return S.synthesis_payloads(s, s.communities).select("community_id", "mode", F.array_join("operations", ",").alias("operations"), ids("member_items").alias("items"), ids("previous").alias("previous"))


@query("""WITH e AS (SELECT 'i' || p_partkey AS item_id, 'L0_C' || p_partkey % 40 AS community_id, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM part)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, community_id) AS community_rank, row_number() OVER (PARTITION BY community_id ORDER BY w DESC, item_id) AS item_rank FROM e""")
def membership_index(spark, sf):
    return S.ranked_index(level0(spark, sf)[2])


@query("""SELECT 'i' || p_partkey AS item_id, 'L0_C' || p_partkey % 40 AS community_id, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS selected, 1.0::DOUBLE AS posterior FROM part WHERE p_partkey % 9 = 0""")
def item_lookup(spark, sf):
    m = level0(spark, sf)[2]
    asked = table(spark, sf, "part").where("p_partkey % 9 = 0").select(F.concat(lit("i"), text("p_partkey")).alias("item_id"))
    return S.communities_of(m, asked).withColumnRenamed("w", "selected").join(S.communities_of(m, asked, True).withColumnRenamed("w", "posterior"), ["item_id", "community_id"])


@query("""SELECT 'item' AS what, 'L0_C' || p_partkey % 40 AS community_id, 'i' || p_partkey AS id FROM part WHERE p_partkey % 40 < 5 UNION ALL SELECT 'card', 'L0_C' || k, 'c' || k || '_' || j FROM (SELECT DISTINCT p_partkey % 40 AS k FROM part), (SELECT unnest([1, 2]) AS j) WHERE k < 5 AND k % 10 <> 9""")
def community_lookup(spark, sf):
    items, communities, members, cards = level0(spark, sf)
    asked = communities.where(F.substring("community_id", 5, 9).cast("int") < 5)
    a = S.items_of(members, asked).select(lit("item").alias("what"), "community_id", c("item_id").alias("id"))
    return a.unionByName(S.cards_of(cards, asked).select(lit("card").alias("what"), "community_id", c("item_id").alias("id")))


@query("SELECT 'i' || p_partkey AS item_id FROM part")
def layer_inputs(spark, sf):
    """Items of level 0 that a community holds, in order of id."""
    return S.layer_inputs(committed(spark, sf), 0).select("item_id")


@query("""SELECT 'L0_C' || k AS community_id, CASE WHEN k % 10 = 9 THEN 'llm_summary_skipped=true;note=n' || k WHEN k % 2 = 0 THEN 'note=n' || k ELSE '' END AS metadata, 'why=again' AS layer FROM (SELECT DISTINCT p_partkey % 40 AS k FROM part)""")
def metadata_updates(spark, sf):
    """Metadata of communities merged, of a layer replaced."""
    s = committed(spark, sf)
    k = F.substring("community_id", 5, 9).cast("int")
    changes = s.communities.where((k % 2 == 0) | (k % 10 == 9)).select("community_id", F.create_map(lit("note"), F.concat(lit("n"), text(k))).alias("metadata"))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    layer = S.layer_described(s.layers, 0, {"why": "again"}).select(flat("metadata").alias("layer"))
    return S.communities_described(s.communities, changes).select("community_id", flat("metadata").alias("metadata")).crossJoin(F.broadcast(layer))  # one layer


@query("SELECT 0 AS level, true AS stale, 'new_trajectory_items' AS reason, false AS after, count(*) + 2 AS items FROM part")
def stale_marks(spark, sf):
    """Two arrivals make level 0 stale; the mark is cleared again."""
    s = committed(spark, sf)
    new = s.items.where("level = 0").orderBy("item_id").limit(2).withColumn("item_id", F.concat(lit("new"), "item_id"))
    t = S.inserted(s, new)
    cleared = S.stale_cleared(t.layers, 0).select(c("stale").alias("after"))
    n = t.items.where("level = 0").agg(F.count("*").alias("items"))
    return t.layers.select("level", "stale", c("stale_reason").alias("reason")).crossJoin(cleared).crossJoin(n)  # one row each


@query("""SELECT 'i' || p_partkey AS item_id, 'bank.json#n' || p_partkey AS reference FROM part WHERE p_partkey % 6 = 0""")
def node_references(spark, sf):
    p = table(spark, sf, "part")
    ident = lambda x: F.concat(lit(x), text("p_partkey"))
    return S.node_references(p.where("p_partkey % 2 = 0").select(ident("i").alias("item_id")), p.where("p_partkey % 3 = 0").select(ident("i").alias("item_id"), ident("n").alias("node_id")), "bank.json")


def refinement_nodes(spark, sf):
    """Coarse nodes of regions, split into nations, and nations into customers' segments."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    leaf = j.select(F.concat(lit("n"), text("n_nationkey")).alias("node_id"), lit("leaf").alias("kind"), F.concat(lit("N"), text("n_nationkey")).alias("community_id"), F.array().cast("array<string>").alias("child_node_ids"))
    mid = j.groupBy("r_regionkey", (c("n_nationkey") % 2).alias("half")).agg(F.collect_list(F.concat(lit("n"), text("n_nationkey"))).alias("child_node_ids"))
    split = mid.select(F.concat(lit("r"), text("r_regionkey"), lit("_"), text("half")).alias("node_id"), lit("split").alias("kind"), lit(None).cast("string").alias("community_id"), "child_node_ids")
    root = mid.groupBy("r_regionkey").agg(F.collect_list(F.concat(lit("r"), text("r_regionkey"), lit("_"), text("half"))).alias("child_node_ids"))
    top = root.select(F.concat(lit("r"), text("r_regionkey")).alias("node_id"), lit("router").alias("kind"), lit(None).cast("string").alias("community_id"), "child_node_ids")
    roots = root.select(F.concat(lit("R"), text("r_regionkey")).alias("coarse"), F.concat(lit("r"), text("r_regionkey")).alias("node_id"))
    return leaf.unionByName(split).unionByName(top), roots


@query("SELECT 'N' || n_nationkey AS leaf, 'R' || n_regionkey AS coarse FROM nation")
def leaf_to_coarse(spark, sf):
    return S.leaf_to_coarse(*refinement_nodes(spark, sf))


@query("""WITH e AS (SELECT c_custkey, c_nationkey AS n, 0.75::DOUBLE AS w FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 7) % 25, 0.2 FROM customer), u AS (SELECT c_custkey, 'R' || n_regionkey AS community_id, w FROM e JOIN nation ON n_nationkey = n UNION ALL SELECT c_custkey, 'R0', 0.05 FROM customer)
SELECT c_custkey AS item_id, community_id, round(sum(w), 6) AS w FROM u WHERE community_id <> 'R4' GROUP BY 1, 2""")
def coarse_posterior(spark, sf):
    """Posterior edges on leaves and on a coarse community itself, summed up; one coarse community is unknown."""
    cust = table(spark, sf, "customer")
    edge = lambda name, w: cust.select(c("c_custkey").alias("item_id"), name.alias("community_id"), lit(w).alias("w"))
    p = edge(F.concat(lit("N"), text("c_nationkey")), 0.75).unionByName(edge(F.concat(lit("N"), text((c("c_nationkey") + 7) % 25)), 0.2)).unionByName(edge(lit("R0"), 0.05)).unionByName(edge(lit("lost"), 0.5))
    nodes, roots = refinement_nodes(spark, sf)
    return rounded(S.coarse_posterior(p, roots.where("coarse <> 'R4'").select(c("coarse").alias("community_id")), S.leaf_to_coarse(nodes, roots)), "w")


@query("""WITH t AS (SELECT source AS community_id, sum(n_chars)::BIGINT AS cost, max(n_chars) AS top FROM documents GROUP BY 1 UNION ALL SELECT lang, sum(n_chars)::BIGINT, max(n_chars) FROM documents GROUP BY 1)
SELECT community_id, CASE WHEN cost <= 100000 THEN greatest(1, top) ELSE cost END AS token_cost, CASE WHEN cost <= 100000 THEN greatest(1, top) ELSE cost END > 90000 AS over_budget FROM t""")
def prompt_costs(spark, sf):
    """Costs of communities: an estimate where the members' sum is within the budget, else the sum."""
    estimate = lambda held: held.groupBy("community_id").agg(F.max("tokens").alias("tokens"))
    costs = S.prompt_costs(doc_edges(spark, sf), doc_items(spark, sf), 100_000, estimate)
    return costs.withColumn("over_budget", c("token_cost") > 90_000)


@query("""WITH m AS (SELECT p_partkey, 'P' || p_partkey % 8 AS community_id, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS w FROM part)
SELECT community_id, 3 AS level, round(sum(w * 2), 6) AS support_mass, count(*) FILTER (p_partkey % 5 = 0) AS success_count, count(*) FILTER (p_partkey % 5 <> 0) AS failure_count, sum(p_partkey)::BIGINT AS token_cost FROM m GROUP BY 1""")
def refinement_probes(spark, sf):
    p = table(spark, sf, "part")
    n = c("p_partkey")
    items = p.select(n.alias("item_id"), lit(2.0).alias("support_mass"), (n % 5 == 0).alias("success"), n.alias("tokens"))
    members = p.select(n.alias("item_id"), F.concat(lit("P"), text(n % 8)).alias("community_id"), lit("top").alias("parent"), F.when(n % 3 == 0, 0.5).alias("w"))
    top = spark.createDataFrame([("top", 3, {"a": "b"})], "community_id string, level int, metadata map<string,string>")
    return rounded(S.probes(members, items, top).drop("outcome_mode", "parent", "metadata"), "support_mass")


# ---- banks -------------------------------------------------------------------------------------


@query("""SELECT 'n' || doc_id AS node_id, 'i' || doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id ELSE source END AS name, 'name: ' || CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id ELSE source END || chr(10) || 'trigger: ' || lang || chr(10) || 'content: ' || trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS embedding_text, round(n_chars / 7.0, 6) AS support_mass, (doc_id % 4)::INT AS level FROM documents WHERE doc_id % 5 <> 0 AND regexp_matches(text, '\\S')""")
def bank_round_trip(spark, sf):
    """A bank written as JSON and read back; nodes without content go, names and texts are filled in."""
    n = c("doc_id")
    d = table(spark, sf, "documents").select(F.concat(lit("n"), text(n)).alias("node_id"), F.concat(lit("i"), text(n)).alias("item_id"), F.when(n % 3 != 0, c("source")).alias("name"), c("lang").alias("trigger"), F.when(n % 5 != 0, c("text")).alias("content"), (c("n_chars") / 7.0).alias("support_mass"), (n % 4).alias("level"))
    at = new_path(spark, "bank")
    sinks.write_bank(d, at, {"order": "mass"})
    return rounded(readers.read_bank(spark, at).select("node_id", "item_id", "name", "embedding_text", "support_mass", "level"), "support_mass")


@query("SELECT c_custkey, sha256('name: ' || c_name || chr(10) || 'trigger: t' || chr(10) || 'content: ' || c_mktsegment) AS sha256 FROM customer")
def bank_defaults(spark, sf):
    """The hash of a node that comes without one is that of its text."""
    at = new_path(spark, "bank")
    sinks.write_bank(table(spark, sf, "customer").select(text("c_custkey").alias("node_id"), c("c_name").alias("name"), lit("t").alias("trigger"), c("c_mktsegment").alias("content")), at)
    return readers.read_bank(spark, at).select(c("node_id").cast("long").alias("c_custkey"), "sha256")


# ---- propagation and contributions -------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey % 40 AS k, sum((1 + p_partkey % 3) * CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END)::DOUBLE AS mass FROM part GROUP BY 1)
SELECT 'c' || k || '_' || j AS item_id, round(CASE WHEN k < 4 THEN mass * CASE j WHEN 1 THEN 4 ELSE 2 END / 6 ELSE mass * j / 3 END, 6) AS support_mass, CASE WHEN k < 4 THEN CASE j WHEN 1 THEN 2 ELSE 1 END ELSE 0 END AS version, CASE WHEN k < 4 AND j = 1 THEN 'new ' || k ELSE 'card ' || k END AS text, k < 4 AS terminal FROM p, (SELECT unnest([1, 2]) AS j) WHERE k % 10 <> 9""")
def propagation_terminal(spark, sf):
    """Patches of four communities with nothing above them: cards change, masses follow, the changes are terminal."""
    s = committed(spark, sf)
    ids = spark.range(4).select(F.concat(lit("L0_C"), text("id")).alias("community_id"))

    def patch(payloads):
        one = F.element_at("previous", 1)
        return payloads.select(c("community_id").alias("source_community_id"), lit("update").alias("operation"), one["item_id"].alias("item_id"), F.concat(lit("new "), F.substring("community_id", 5, 9)).alias("text"), lit(None).cast("array<double>").alias("vec"), lit(4.0).alias("confidence"))

    out = propagation.propagated(s, ids, patch, lambda items, level: None)
    cards = out.state.items.where("level = 1")
    return rounded(cards.join(out.terminal.withColumn("terminal", lit(True)), "item_id", "left").select("item_id", "support_mass", "version", "text", F.coalesce("terminal", lit(False)).alias("terminal")), "support_mass")


def two_levels(spark, sf):
    """``committed`` with a second level: its cards in four communities by key, a card of each."""
    s = committed(spark, sf)
    cards = s.items.where("level = 1")
    k = F.regexp_extract("item_id", r"^c(\d+)_", 1).cast("int")
    members = cards.select(lit(1).alias("level"), F.concat(lit("L1_C"), text(k % 4)).alias("community_id"), "item_id", lit(1.0).alias("w"), lit(1.0).alias("posterior"))
    four = spark.range(4)
    communities = four.select(F.concat(lit("L1_C"), text("id")).alias("community_id"), lit(1).alias("level"), lit(None).cast("double").alias("support_mass"), F.create_map().cast("map<string,string>").alias("metadata"))
    top = four.select(F.concat(lit("t"), text("id")).alias("item_id"), lit(2).alias("level"), lit(S.CARD).alias("kind"), F.concat(lit("top "), text("id")).alias("text"), _vec(c("id")).alias("vec"), lit(None).cast("double").alias("support_mass"), lit(1.0).alias("confidence"), F.concat(lit("L1_C"), text("id")).alias("source_community_id"), lit(0).alias("version"))
    return S.committed(S.State(*(kept(getattr(s, n)) for n in S.TABLES)), 1, communities, members, top, "split")


@query(f"""WITH {MASS_SQL}, c AS (SELECT k, j, CASE WHEN k = 0 THEN CASE j WHEN 1 THEN mass * 4 / 6 ELSE mass * 2 / 6 END ELSE mass * j / 3 END AS mass, CASE WHEN k = 0 AND j = 1 THEN 3 ELSE k % 4 END AS g FROM m, (SELECT unnest([1, 2]) AS j) WHERE k % 10 <> 9)
SELECT 'L1_C' || g AS community_id, round(sum(mass), 6) AS support_mass, round(sum(mass), 6) AS card_mass, CASE WHEN g IN (0, 3) THEN 'moved ' || g ELSE 'top ' || g END AS text, g IN (0, 3) AS updated, 2 AS rounds FROM c GROUP BY g""")
def propagation_upward(spark, sf):
    """One card changes, moves to another community of its level, and the cards of both follow."""
    s = two_levels(spark, sf)

    def patch(payloads):
        one, low = F.element_at("previous", 1), c("level") == 0
        name = F.when(low, "changed").otherwise(F.concat(lit("moved "), F.substring("community_id", 5, 9)))
        return payloads.select(c("community_id").alias("source_community_id"), lit("update").alias("operation"), one["item_id"].alias("item_id"), name.alias("text"), lit(None).cast("array<double>").alias("vec"), F.when(low, 4.0).otherwise(1.0).alias("confidence"))

    def route(items, level):
        return items.select("item_id", lit("L1_C3").alias("community_id"), lit(1.0).alias("w"), lit(1.0).alias("posterior")) if level == 1 else None

    out = propagation.propagated(s, spark.createDataFrame([("L0_C0",)], "community_id string"), patch, route)
    cards = out.state.items.where("level = 2").select(c("source_community_id").alias("community_id"), c("support_mass").alias("card_mass"), "text")
    coms = out.state.communities.where("level = 1").select("community_id", "support_mass").join(cards, "community_id")
    return rounded(coms.join(out.updated.withColumn("updated", lit(True)), "community_id", "left").withColumns({"updated": F.coalesce("updated", lit(False)), "rounds": lit(out.rounds)}), "support_mass", "card_mass")


@query("""WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda y: y::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS l FROM x)
SELECT vec_id, round((e[1] / l - 0.1) + (e[2] / l - 0.2), 6) AS first, round(2 * (e[2] / l - 0.2), 6) AS second, 'C' || label || '=0.75' AS posterior FROM n WHERE label % 2 = 0""")
def routing_contributions(spark, sf):
    """What items give a model: their vectors on a saved basis, and their posterior edges."""
    e = table(spark, sf, "embeddings")
    items = e.select(c("vec_id").alias("item_id"), lit(1.0).alias("support_mass"), c("embedding").alias("vec"))
    edges = e.where("label % 2 = 0").select(c("vec_id").alias("item_id"), F.concat(lit("C"), text("label")).alias("community_id"), lit(0.75).alias("w"))
    rows = [[1.0, 1.0] + [0.0] * 62, [0.0, 2.0] + [0.0] * 62]
    got = propagation.contributions(items, edges, [0.1, 0.2] + [0.0] * 62, rows)
    flat = F.array_join(F.transform(F.map_entries("posterior"), lambda x: F.concat(x["key"], lit("="), x["value"].cast("string"))), ",")
    return rounded(got.select(c("item_id").alias("vec_id"), F.get("x", lit(0)).alias("first"), F.get("x", lit(1)).alias("second"), flat.alias("posterior")), "first", "second")
