"""Queries on vectors and the card bank: retrieval, projections, mixtures, trees, leakage."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import bank, budget, hierarchy, index, mixture, refinement, resuming
from ..sources.scratch import kept, new_path
from ..streaming import admission
from .members import rounded
from .registry import query, table
from .texts import HASHED

E_SQL = "x AS (SELECT vec_id, label, list_transform(embedding, lambda y: y::DOUBLE) AS e FROM embeddings)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("vec"))


@query("WITH " + HASHED.format(key="item_id", table="benchmark").replace("t AS", "qt AS").replace(" t)", " qt)").replace("h AS (SELECT k", "qh AS (SELECT k").replace("FROM h ", "FROM qh ").replace("v AS (SELECT", "qv AS (SELECT").replace("FROM v ", "FROM qv ").replace("n AS (SELECT", "qn AS (SELECT") + ",\n" + HASHED.format(key="doc_id", table="documents") + """,
s AS (SELECT q.k AS query_id, b.k AS node_id, sum(q.v / qn.l * (b.v / n.l)) AS score FROM qv q JOIN qn ON qn.k = q.k JOIN v b ON b.dim = q.dim JOIN n ON n.k = b.k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM s)
SELECT query_id, node_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def bank_topk_docs(spark, sf):
    q = V.hashed_entries(table(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    b = V.hashed_entries(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "node_id")
    return rounded(bank.sparse_top_k(q, b, 10), "score")


NEAREST_SQL = f"""WITH {E_SQL}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS l FROM x),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS node_id, list_dot_product(q.e, b.e) / q.l / b.l AS score FROM n q JOIN n b ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM s)
SELECT query_id, node_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""


@query(NEAREST_SQL)
def embedding_topk(spark, sf):
    """The ten nearest of all vectors, for every vector whose id is divisible by 50."""
    v = vectors(spark, sf)
    return rounded(bank.dense_top_k(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("node_id"), "vec"), 10), "score")


def _asked_and_bank(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries, every vector whose id is divisible by 50, and all vectors."""
    v = vectors(spark, sf)
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("node_id"), "vec")


@query(NEAREST_SQL)
def index_topk(spark, sf):
    """The same from a stored index: a few cells a query, then those that could hold better ones."""
    asked, nodes = _asked_and_bank(spark, sf)
    stored, _ = index.ensured(nodes, new_path(spark, "index"), "embeddings", "cosine")
    return rounded(index.searched(stored, asked, 10, probes=4, exact=True), "score")


@query()
def index_recall(spark, sf):
    """query_id, n_found of n_exact: how many of the ten nearest a search of as many cells finds as other vectors need."""
    asked, nodes = _asked_and_bank(spark, sf)
    stored, _ = index.ensured(nodes, new_path(spark, "index"), "embeddings", "cosine")
    probes = index.calibrated(stored, nodes.where("node_id % 50 <> 0"), 10)
    found = index.searched(stored, asked, 10, probes).select("query_id", "node_id", F.lit(1).alias("hit"))
    exact = bank.dense_top_k(asked, nodes, 10).select("query_id", "node_id")
    return exact.join(found, ["query_id", "node_id"], "left").groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("n_found"), F.count("*").alias("n_exact"))


@query("""WITH m AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 7 <> 0)
SELECT 'first' AS bank, n AS stored, true AS built FROM m UNION ALL SELECT 'same', n, false FROM m UNION ALL SELECT 'other_model', n, true FROM m UNION ALL SELECT 'fewer', n, true FROM l UNION ALL SELECT 'first_again', n, false FROM m""")
def index_reuse(spark, sf):
    """An index is read where model and vectors are as they were, whatever the order of rows, else built."""
    _, nodes = _asked_and_bank(spark, sf)
    at, rows = new_path(spark, "index"), None
    for name, bank_now, model in (("first", nodes, "a"), ("same", nodes.orderBy(F.desc("node_id")), "a"), ("other_model", nodes, "b"), ("fewer", nodes.where("node_id % 7 <> 0"), "a"), ("first_again", nodes, "a")):
        stored, built = index.ensured(bank_now, at, model, "cosine")
        one = stored.manifest.select(F.lit(name).alias("bank"), "stored", F.lit(built).alias("built"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("SELECT doc_id AS node_id, n_chars::DOUBLE AS support_mass, (doc_id % 4)::INT AS level FROM documents ORDER BY n_chars DESC, doc_id % 4 DESC, doc_id LIMIT 100")
def bank_order(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.col("n_chars").cast("double").alias("support_mass"), (F.col("doc_id") % 4).cast("int").alias("level"))
    return bank.in_bank_order(d, 100)


@query("SELECT doc_id AS node_id, (doc_id % 4)::INT AS level FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 BETWEEN 1 AND 2 AND doc_id % 7 <> 0")
def bank_level_filter(spark, sf):
    flags = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("oversize"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), (F.col("doc_id") % 4).cast("int").alias("level"), F.when(F.col("doc_id") % 3 == 0, "trajectory").otherwise("experience_card").alias("kind"), flags.alias("skip_flags"))
    return bank.exportable(d, 1, 2).select("node_id", "level")


@query(f"""WITH {E_SQL}, n AS (SELECT label, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS l FROM x), f AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(e) / CASE WHEN l > 1e-12 THEN l ELSE 1 END AS y FROM n)
SELECT label, dim::INT AS dim, round(avg(y), 6) AS mean FROM f GROUP BY 1, 2""")
def centroid_by_label(spark, sf):
    v = vectors(spark, sf).select("label", V.normalised(F.col("vec")).alias("vec"))
    return rounded(V.by_dimension(v, ["label"], "vec"), "mean")


@query(f"WITH {E_SQL} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) AS norm, round(e[1] / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) AS first FROM x")
def l2_normalise(spark, sf):
    return rounded(vectors(spark, sf).select("vec_id", V.norm(F.col("vec")).alias("norm"), F.get(V.normalised(F.col("vec")), F.lit(0)).alias("first")), "norm", "first")


@query(f"""WITH {E_SQL}, f AS (SELECT label, (1 + vec_id % 3)::DOUBLE AS w, unnest(range(0, 64)) AS dim, unnest(e) AS y FROM x), m AS (SELECT *, sum(w * y) OVER (PARTITION BY label, dim) / sum(w) OVER (PARTITION BY label, dim) AS mu FROM f)
SELECT label, round(sum(w * (y - mu) * (y - mu)), 4) AS inertia FROM m GROUP BY 1""")
def weighted_mean_inertia(spark, sf):
    v = vectors(spark, sf).withColumn("w", (1 + F.col("vec_id") % 3).cast("double"))
    flat = v.select("label", "w", F.posexplode("vec").alias("dim", "x"))
    by = flat.groupBy("label", "dim").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"))
    return by.groupBy("label").agg(F.round(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")), 4).alias("inertia"))


_MEANS = [[math.sin(3.0 * c + d) / 8 for d in range(64)] for c in range(4)]
_VARS = [0.02, 0.015, 0.02, 0.01]
_MODEL_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {v}::DOUBLE, [{', '.join(f'{x!r}::DOUBLE' for x in m)}])" for c, (v, m) in enumerate(zip(_VARS, _MEANS))) + ") AS g(c, v, m))"


@query(f"""WITH {E_SQL}, {_MODEL_SQL}, lp AS (SELECT vec_id, c, ln(0.25::DOUBLE) - 0.5 * (64 * ln(2 * pi()) + 64 * ln(v) + list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i]))) / v) AS lp FROM x, g),
t AS (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS top FROM lp)
SELECT vec_id::VARCHAR AS item_id, 'C' || c AS community_id, round(exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY vec_id), 6) AS w FROM t""")
def responsibilities_fixed_model(spark, sf):
    fit = mixture.Fit(4, np.full(4, 0.25), np.array(_MEANS), np.repeat(np.array(_VARS)[:, None], 64, axis=1))
    v = vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), "vec")
    return rounded(mixture.posterior(v, fit, [f"C{i}" for i in range(4)]), "w")


@query(f"""WITH {E_SQL}, {_MODEL_SQL}, s AS (SELECT vec_id, c, list_dot_product(e, m) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(e, e)) AS s FROM x, g), t AS (SELECT *, exp(8 * (s - max(s) OVER (PARTITION BY vec_id))) AS z FROM s)
SELECT vec_id, c, round(z / sum(z) OVER (PARTITION BY vec_id), 6) AS w FROM t""")
def centroid_softmax(spark, sf):
    v = vectors(spark, sf).select("vec_id", V.normalised(F.col("vec")).alias("vec"))
    score = F.array(*(V.dot(F.col("vec"), V.normalised(F.array(*map(F.lit, m)))) for m in _MEANS))
    each = v.select("vec_id", score.alias("s")).withColumn("z", F.transform("s", lambda x: F.exp(8.0 * (x - F.array_max("s")))))
    return rounded(each.select("vec_id", F.posexplode(F.transform("z", lambda x: x / V.total(F.col("z")))).alias("c", "w")), "w")


# ---- fits and trees: no SQL form; tests hold them to brute force and invariants


def _rows(spark, sf) -> DataFrame:
    return vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), "vec", F.lit(1.0).alias("w"))


@query()
def pca_project(spark, sf):
    rows = _rows(spark, sf)
    b = mixture.pca(rows)
    return rows.select("item_id", V.projected(F.col("vec"), b.mean, b.rows).alias("projected"))


@query()
def mixture_fit(spark, sf):
    fits = mixture.fit_mixtures(kept(_rows(spark, sf)), [1, 2, 4], mixture.MixtureConfig(restarts=2, rounds=20), 42)
    return spark.createDataFrame([(f.k, f.log_likelihood, f.bic, f.valid) for f in fits], "k int, log_likelihood double, bic double, valid boolean")


@query()
def kmeans_fit(spark, sf):
    f = mixture.kmeans(kept(_rows(spark, sf)), 8, mixture.MixtureConfig(restarts=2, rounds=20), 42)
    return spark.createDataFrame([(i, float(s), float(n)) for i, (s, n) in enumerate(zip(f.pi, f.leads))], "component int, share double, leads double")


@query()
def budget_refine(spark, sf):
    """Two communities of all vectors, split until their leaves hold 6000 tokens at most."""
    v = vectors(spark, sf).select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("item_id"), "vec", (20 + F.col("vec_id") % 30).cast("long").alias("tokens"), F.concat(F.lit("C"), (F.col("label") % 2).cast("string")).alias("community_id"))
    items = kept(v)
    members = items.select("item_id", "community_id", F.lit(1.0).alias("w"))
    leaves, _ = refinement.refined(members, items, refinement.RefineConfig(6000, ks=(2, 4), most_depth=2), mixture.MixtureConfig(restarts=1, rounds=12), 42, lambda t, _: kept(t))
    return leaves


@query("""WITH RECURSIVE d AS (SELECT source AS community_id, lpad(doc_id::VARCHAR, 12, '0') AS item_id, ((n_chars + 3) // 4)::BIGINT AS tokens FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY tokens DESC, item_id) AS r FROM d WHERE tokens <= 4000),
f AS (SELECT *, [4000 - tokens] AS rooms, 0::BIGINT AS pack FROM i WHERE r = 1
UNION ALL SELECT community_id, item_id, tokens, r, CASE WHEN p IS NULL THEN list_append(rooms, 4000 - tokens) ELSE list_concat(list_concat(rooms[1:p - 1], [rooms[p] - tokens]), rooms[p + 1:]) END, coalesce(p - 1, len(rooms))::BIGINT
FROM (SELECT i.*, f.rooms, nullif(list_position(list_transform(f.rooms, lambda x: x >= i.tokens), true), 0) AS p FROM f JOIN i ON i.community_id = f.community_id AND i.r = f.r + 1))
SELECT community_id, item_id, tokens, pack FROM f UNION ALL SELECT community_id, item_id, tokens, -1 FROM d WHERE tokens > 4000""")
def budget_pack(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("community_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("item_id"), F.floor((F.col("n_chars") + 3) / 4).cast("long").alias("tokens"))
    return budget.pack_communities(d, 4000)


#: The defaults of a build, with a budget that makes small tables split as well.
TREE = hierarchy.TreeConfig(token_budget=20_000)


def tree_layers(spark: SparkSession, sf: str) -> list[hierarchy.Layer]:
    """The hierarchy over hashed, deduplicated document vectors."""
    from ..operators import records

    docs = kept(records.first_distinct(table(spark, sf, "documents"), "doc_id"))  # read twice
    vec = V.dense(V.hashed_entries(docs, "doc_id", "text", 384), "doc_id", 384)
    items = docs.join(vec, "doc_id").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("item_id"), F.lit(0).alias("level"), F.col("vector").alias("vec"), F.lit(1.0).alias("support_mass"), (F.floor((F.col("n_chars") + 3) / 4) + 128).cast("long").alias("tokens"))
    keep = lambda t, _: kept(t)
    return hierarchy.build(spark, keep(items, "items"), TREE, keep)


@query()
def tree_build(spark, sf):
    layers = [x for x in tree_layers(spark, sf)]
    made = [x.communities.select("level", "community_id", "size", "support_mass", "token_cost") for x in layers if x.communities is not None]
    if not made:
        return spark.createDataFrame([(x.level, x.stop_reason, 0, 0.0, 0) for x in layers], "level int, community_id string, size long, support_mass double, token_cost long")
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


#: A small budget and few rounds: what is asked of it is that levels are used again, not how good they are.
RESUMED = hierarchy.TreeConfig(mixture=mixture.MixtureConfig(min_effective=5.0, restarts=1, rounds=8), token_budget=2_000, most_dims=8, most_levels=3)


@query("""SELECT unnest(['items of level 0', 'mass of level 0', 'levels made again by an equal run', 'levels made again after a stop', 'communities unlike those of an unbroken run', 'levels kept after a changed vector', 'faults of kept levels']) AS what,
unnest([count(*), count(*), 0, 0, 0, 0, 0])::DOUBLE AS value FROM embeddings""")
def build_resumed(spark, sf):
    """A build that stops after its first level and goes on, against one without a stop; then equal and changed input."""
    items = kept(vectors(spark, sf).select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("item_id"), F.lit(0).alias("level"), "vec", F.lit(1.0).alias("support_mass"), (20 + F.col("vec_id") % 30).cast("long").alias("tokens")))
    at, other = new_path(spark, "build"), new_path(spark, "build")
    first, _ = resuming.build(spark, items, dataclasses.replace(RESUMED, most_levels=1), at)
    layers, on = resuming.build(spark, items, RESUMED, at)
    _, again = resuming.build(spark, items.repartition(3), RESUMED, at)
    whole, _ = resuming.build(spark, items, RESUMED, other)
    named = lambda ls: [x.communities.select("level", "community_id", "size", F.round("support_mass", 6).alias("mass")) for x in ls if x.communities is not None]
    unlike = sum(a.exceptAll(b).count() + b.exceptAll(a).count() for a, b in zip(named(layers), named(whole))) + abs(len(layers) - len(whole))
    faults = sum(resuming.level_faults(below, x).count() for below, x in zip([items, *(x.cards for x in layers)], layers) if x.members is not None)
    changed = items.withColumn("vec", F.when(F.col("item_id") == items.agg(F.min("item_id")).first()[0], F.transform("vec", lambda x: -x)).otherwise(F.col("vec")))
    _, anew = resuming.build(spark, changed, dataclasses.replace(RESUMED, most_levels=1), at)
    counted = items.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("support_mass"), F.lit(0.0)).alias("mass")).first()
    told = [("items of level 0", counted.n), ("mass of level 0", counted.mass), ("levels made again by an equal run", sum(again)), ("levels made again after a stop", sum(on[: len(first)])), ("communities unlike those of an unbroken run", unlike), ("levels kept after a changed vector", len(anew) - sum(anew)), ("faults of kept levels", faults)]
    return spark.createDataFrame([(w, float(v)) for w, v in told], "what string, value double")


@query("""SELECT d.doc_id, sha256(lower(trim(b.text))) AS term_sha256, CASE WHEN regexp_matches(b.text, '[0-9]') THEN 'contains_digit' ELSE 'text' END AS term_class FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(lower(d.text), lower(trim(b.text)))
WHERE regexp_matches(lower(d.text), CASE WHEN regexp_matches(trim(b.text), '^[\\p{L}\\p{N}](?s:.*)[\\p{L}\\p{N}]$') THEN '(^|[^\\p{L}\\p{N}_])' || regexp_escape(lower(trim(b.text))) || '($|[^\\p{L}\\p{N}_])' ELSE regexp_escape(lower(trim(b.text))) END)""")
def leak_audit(spark, sf):
    return bank.audit(table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("text").alias("term")), "doc_id")


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\\p{L}\\p{N}_])all rights reserved($|[^\\p{L}\\p{N}_])', '\\1<train_diagnostic_value>\\2', 'gi'), '(^|[^\\p{L}\\p{N}_])version($|[^\\p{L}\\p{N}_])', '\\1<train_diagnostic_value>\\2', 'gi') AS text FROM documents""")
def leak_sanitise(spark, sf):
    terms = spark.createDataFrame([("version",), (" All rights reserved",), ("of",)], "term string")
    return bank.sanitised(table(spark, sf, "documents").select("doc_id", "text"), terms, "doc_id")


@query("""WITH p AS (SELECT conv_id, turn, role, role || ': item ' || turn || ' of ' || conv_id || '.' AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || ': <train_diagnostic_value> of ' || conv_id || '.' ELSE a END AS text FROM p""")
def leak_sanitise_table(spark, sf):
    """A table of terms, a few thousand of them; each text has few."""
    c = table(spark, sf, "conversations")
    text = F.concat("role", F.lit(": item "), F.col("turn").cast("string"), F.lit(" of "), F.col("conv_id").cast("string"), F.lit("."))
    terms = spark.range(3000).where("id % 3 = 0").select(F.concat(F.lit("ITEM "), F.col("id").cast("string")).alias("term"))
    rows = c.select("conv_id", "turn", F.struct("conv_id", "turn").cast("string").alias("key"), text.alias("text"))
    return bank.sanitised(rows, terms, "key").select("conv_id", "turn", "text")


@query()
def incremental_admit(spark, sf):
    """All vectors, in order of id, admitted to a saved level of four components, with a token budget."""
    v = vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), "vec", (20 + F.col("vec_id") % 30).alias("tokens"), F.col("vec_id").alias("pos"))
    return admission.admit_backlog(v, admission_start(), 600, new_path(spark, "admitted")).drop("batch", "rejected", "rejected_w", "rejected_cost")


def admission_start() -> admission.LevelState:
    return admission.LevelState([f"C{i}" for i in range(4)], np.full(4, 0.25), np.array(_MEANS), np.full((4, 64), 0.02), np.full(4, 50.0), np.zeros(4, int))
