"""The hierarchy as tables: lookups, checks, commits of levels, snapshots.

items: item_id, level, kind (trajectory or experience_card), text, vec, support_mass, confidence, source_community_id, version.
communities: community_id, level, support_mass, metadata (map of strings).
members: level, community_id, item_id, w (selected weight, null for an edge of the posterior alone), posterior.
layers: level, stop_reason, stale, stale_reason, metadata.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import mass, membership

ITEM = "item_id string, level int, kind string, text string, vec array<double>, support_mass double, confidence double, source_community_id string, version int"
COMMUNITY = "community_id string, level int, support_mass double, metadata map<string,string>"
MEMBER = "level int, community_id string, item_id string, w double, posterior double"
LAYER = "level int, stop_reason string, stale boolean, stale_reason string, metadata map<string,string>"
TABLES = {"items": ITEM, "communities": COMMUNITY, "members": MEMBER, "layers": LAYER}
TRAJECTORY, CARD = "trajectory", "experience_card"
# Metadata that lets a community do without a card, by who asks.
SKIPS = {
    "build": ("llm_summary_skipped", "oversize_singleton", "higher_level_abstraction_skipped"),
    "commit": ("llm_summary_skipped", "dynamic_llm_summary_skipped", "oversize_singleton", "higher_level_abstraction_skipped"),
    "diagnostic": ("llm_summary_skipped", "dynamic_llm_summary_skipped", "oversize_singleton"),
}


@dataclass(frozen=True)
class State:
    items: DataFrame
    communities: DataFrame
    members: DataFrame
    layers: DataFrame


def empty(spark: SparkSession) -> State:
    return State(**{k: spark.createDataFrame([], v) for k, v in TABLES.items()})


# ---- lookups -----------------------------------------------------------------------------------


def communities_of(members: DataFrame, item_ids: DataFrame, posterior: bool = False) -> DataFrame:
    """(item_id, community_id, w) of the items asked for (item_id): selected weights, or those of the posterior."""
    w = F.col("posterior") if posterior else F.col("w")
    return members.join(item_ids.select("item_id").distinct(), "item_id", "left_semi").where(w.isNotNull()).select("item_id", "community_id", w.alias("w"))


def items_of(members: DataFrame, community_ids: DataFrame) -> DataFrame:
    """(community_id, item_id, w) of the communities asked for (community_id)."""
    return members.where("w IS NOT NULL").join(community_ids.select("community_id").distinct(), "community_id", "left_semi").select("community_id", "item_id", "w")


def cards_of(items: DataFrame, community_ids: DataFrame) -> DataFrame:
    """(community_id, item_id): the cards that communities gave."""
    made = items.where(F.col("kind") == CARD).select(F.col("source_community_id").alias("community_id"), "item_id")
    return made.join(community_ids.select("community_id").distinct(), "community_id", "left_semi")


def ranked_index(members: DataFrame) -> DataFrame:
    """Selected edges with the rank of the community for its item and of the item in its community."""
    down = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), other))
    return members.where("w IS NOT NULL").select("item_id", "community_id", "w", down("item_id", "community_id").alias("community_rank"), down("community_id", "item_id").alias("item_rank"))


def layer_inputs(state: State, level: int) -> DataFrame:
    """Items of a level that some community of it holds, in the canonical order of ids."""
    held = state.members.where((F.col("level") == level) & F.col("w").isNotNull()).select("item_id").distinct()
    return state.items.where(F.col("level") == level).join(held, "item_id", "left_semi").orderBy("item_id")


def is_terminal(state: State, level: int) -> bool:
    """Whether nothing lies above a level: no items, no communities, no layer."""
    above = F.col("level") == level + 1
    return not any(t.where(above).take(1) for t in (state.items, state.communities, state.layers))


def node_references(changed: DataFrame, nodes: DataFrame, manifest: str) -> DataFrame:
    """(item_id, reference): where a bank's manifest has the changed items (item_id); others are left out."""
    return changed.select("item_id").distinct().join(nodes.select("item_id", "node_id"), "item_id").select("item_id", F.concat(F.lit(f"{manifest}#"), "node_id").alias("reference"))


def leaf_to_coarse(nodes: DataFrame, roots: DataFrame, most_depth: int = 64) -> DataFrame:
    """(leaf, coarse): the coarse community (coarse, node_id in ``roots``) above each leaf.

    nodes: node_id, kind, community_id, child_node_ids. A leaf that has a community ends its branch.
    """
    is_leaf = F.col("kind").isin("leaf", "active_leaf", "community_leaf") & (F.coalesce("community_id", F.lit("")) != "")
    front = scratch.kept(roots.select("coarse", "node_id").distinct())
    seen, found = front, None
    for _ in range(most_depth):
        at = front.join(nodes, "node_id")
        leaves = at.where(is_leaf).select(F.col("community_id").alias("leaf"), "coarse")
        found = leaves if found is None else found.unionByName(leaves)
        below = at.where(~is_leaf).select("coarse", F.explode("child_node_ids").alias("node_id")).distinct()
        front = scratch.kept(below.join(seen, ["coarse", "node_id"], "left_anti"))
        if not front.take(1):
            return found.distinct()
        seen = scratch.kept(seen.unionByName(front))
    raise ValueError("the tree of refinements is too deep")


def coarse_posterior(posterior: DataFrame, coarse: DataFrame, leaves: DataFrame) -> DataFrame:
    """(item_id, community_id, w): posterior edges (item_id, community_id, w) summed up to the coarse
    communities (community_id) of a model, by ``leaf_to_coarse``; other edges and tiny sums go."""
    known = coarse.select("community_id").distinct().withColumn("_own", F.lit(True))
    up = posterior.join(known, "community_id", "left").join(leaves.select(F.col("leaf").alias("community_id"), "coarse"), "community_id", "left")
    named = up.select("item_id", F.when(F.col("_own"), F.col("community_id")).otherwise(F.col("coarse")).alias("community_id"), "w")
    summed = named.join(known.drop("_own"), "community_id", "left_semi").groupBy("item_id", "community_id").agg(F.sum("w").alias("w"))
    return summed.where("w > 1e-12")


# ---- checks ------------------------------------------------------------------------------------


def arrival_faults(batch: DataFrame, items: DataFrame) -> DataFrame:
    """(fault, item_id) of arrivals that must not be taken in: repeated or known ids, wrong kind or level, no vector."""
    times = batch.groupBy("item_id").agg(F.count("*").alias("_times"))
    seen = batch.join(times, "item_id").join(items.select("item_id", F.lit(True).alias("_known")), "item_id", "left")
    fault = (
        F.when(F.coalesce("item_id", F.lit("")) == "", "no_id")
        .when(F.col("_times") > 1, "repeated")
        .when(F.col("_known"), "known")
        .when(~F.col("kind").eqNullSafe(TRAJECTORY), "kind")
        .when(~F.col("level").eqNullSafe(0), "level")
        .when(F.coalesce(F.size("vec"), F.lit(0)) == 0, "no_vector")
    )
    return seen.select(fault.alias("fault"), "item_id").where("fault IS NOT NULL").distinct()


def skips_synthesis(metadata: Column, who: str = "build") -> Column:
    """Whether a community's metadata excuse it from giving a card; see ``SKIPS``."""
    on = lambda k: ~F.coalesce(F.lower(F.try_element_at(metadata, F.lit(k))), F.lit("")).isin("", "false", "0", "null")
    out = F.lit(False)
    for k in SKIPS[who]:
        out = out | on(k)
    return F.coalesce(out, F.lit(False))


def card_faults(communities: DataFrame, cards: DataFrame, who: str = "build") -> DataFrame:
    """(fault, community_id, item_id) of what communities (community_id, level, metadata) gave as cards
    (item_id, kind, level, source_community_id, vec, confidence)."""
    known = communities.select("community_id", F.col("level").alias("_level"), skips_synthesis(F.col("metadata"), who).alias("_skip"))
    times = cards.groupBy("item_id").agg(F.count("*").alias("_times"))
    seen = cards.join(times, "item_id", "left").join(known, cards["source_community_id"] == known["community_id"], "left")
    c = F.col("confidence")
    fault = (
        F.when(F.col("_level").isNull(), "source")
        .when(F.col("_times") > 1, "repeated")
        .when(~F.col("kind").eqNullSafe(CARD), "kind")
        .when(~F.col("level").eqNullSafe(F.col("_level") + 1), "level")
        .when(F.coalesce(F.size("vec"), F.lit(0)) == 0, "no_vector")
        .when(~F.coalesce((c > 0) & (c < float("inf")), F.lit(False)) | F.coalesce(F.isnan(c), F.lit(True)), "confidence")
    )
    wrong = seen.select(fault.alias("fault"), F.col("source_community_id").alias("community_id"), "item_id").where("fault IS NOT NULL").distinct()
    none = known.where("NOT _skip").join(cards.select(F.col("source_community_id").alias("community_id")), "community_id", "left_anti")
    return wrong.unionByName(none.select(F.lit("no_card").alias("fault"), "community_id", F.lit(None).cast(cards.schema["item_id"].dataType).alias("item_id")))


def hierarchy_faults(state: State, no_stale: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """(kind, level, id) of all that breaks the rules of a hierarchy: ``membership.violations``, but for communities that are
    excused from giving a card, or that lost all members to others and so weigh nothing, as do their cards; besides masses that
    are not those of members or cards, and links between layers.

    ``no_stale``: a stale layer is a fault too.
    """
    chosen = state.members.where("w IS NOT NULL").select("item_id", "community_id", "w")
    excused = state.communities.where(skips_synthesis(F.col("metadata"), "commit")).select(F.lit("no_card").alias("kind"), F.col("community_id").alias("id"))
    left = state.communities.where("support_mass = 0")
    weightless = state.items.join(left.select(F.col("community_id").alias("source_community_id")), "source_community_id", "left_semi").select(F.lit("support_mass").alias("kind"), F.col("item_id").alias("id"))
    excused = excused.unionByName(left.select(F.lit("empty_community").alias("kind"), F.col("community_id").alias("id"))).unionByName(weightless)
    posterior = state.members.where("posterior IS NOT NULL")
    if not state.members.where("w IS NOT NULL AND posterior IS NULL").take(1):
        posterior = posterior.where("w IS NOT NULL")  # each chosen edge is one of them; the others, by far the most, need not be met
    found = membership.violations(state.items, state.communities, chosen, posterior.select("item_id", "community_id"))
    row = lambda df, kind, ident: df.select(F.lit(kind).alias("kind"), F.col("level").cast("int").alias("level"), F.col(ident).cast("string").alias("id"))
    off = lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) > tolerance * F.greatest(F.lit(1.0), F.abs(F.coalesce(a, F.lit(0.0))))
    summed = mass.support_mass(state.items, chosen).withColumnRenamed("support_mass", "_sum")
    of_cards = state.items.where(F.col("kind") == CARD).groupBy(F.col("source_community_id").alias("community_id")).agg(F.sum("support_mass").alias("_cards"))
    have = state.layers.select("level", F.lit(True).alias("_layer"))
    levels = state.communities.select("level").distinct()
    parts = [
        found.join(excused, ["kind", "id"], "left_anti").select("kind", "level", "id"),
        row(state.communities.join(summed, "community_id", "left").where(off(F.col("support_mass"), F.col("_sum"))), "mass_of_community", "community_id"),
        row(state.communities.join(of_cards, "community_id").where(off(F.col("support_mass"), F.col("_cards"))), "mass_of_cards", "community_id"),
        row(levels.join(have, "level", "left_anti"), "no_layer", "level"),
        row(levels.where("level > 0").join(levels.select((F.col("level") + 1).alias("level")), "level", "left_anti"), "gap_below", "level"),
    ]
    if no_stale:
        parts.append(row(state.layers.where("stale"), "stale_layer", "stale_reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _refuse(faults: DataFrame, what: str) -> None:
    if some := faults.limit(10).collect():
        raise ValueError(f"{what}: {sorted(tuple(map(str, r)) for r in some)}")


# ---- changes -----------------------------------------------------------------------------------


def initialised(items: DataFrame) -> State:
    """A state of level-0 items alone."""
    new = empty(items.sparkSession)
    _refuse(arrival_faults(items, new.items), "items that cannot begin a hierarchy")
    return replace(new, items=items)


def inserted(state: State, batch: DataFrame) -> State:
    """With arrivals at level 0, which makes the layer stale."""
    _refuse(arrival_faults(batch, state.items), "arrivals that cannot be taken in")
    return replace(state, items=state.items.unionByName(batch), layers=marked_stale(state.layers, 0, "new_trajectory_items"))


def marked_stale(layers: DataFrame, level: int, reason: str) -> DataFrame:
    at = F.col("level") == level
    return layers.withColumns({"stale": F.when(at, True).otherwise(F.col("stale")), "stale_reason": F.when(at, reason).otherwise(F.col("stale_reason"))})


def stale_cleared(layers: DataFrame, level: int) -> DataFrame:
    at = F.col("level") == level
    return layers.withColumns({"stale": F.when(at, False).otherwise(F.col("stale")), "stale_reason": F.when(at, "").otherwise(F.col("stale_reason"))})


def layer_described(layers: DataFrame, level: int, metadata: dict[str, str]) -> DataFrame:
    """A layer's metadata replaced."""
    new = F.create_map(*(F.lit(x) for kv in metadata.items() for x in kv)) if metadata else F.create_map().cast("map<string,string>")
    return layers.withColumn("metadata", F.when(F.col("level") == level, new).otherwise(F.col("metadata")))


def communities_described(communities: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata of communities merged with changes (community_id, metadata); a new value wins."""
    new = changes.select("community_id", F.col("metadata").alias("_new"))
    joined = communities.join(new, "community_id", "left")
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("_new", k)), F.col("_new"))
    return joined.withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(merged)).select(*communities.columns)


def committed(state: State, level: int, communities: DataFrame, members: DataFrame, cards: DataFrame, stop_reason: str = "", excluded: DataFrame | None = None) -> State:
    """A level replaced and everything above it dropped, once all checks hold.

    Every input item must have a community or be excluded (item_id); every community gives a card or
    is excused. Masses of communities and cards are computed anew.
    """
    below = lambda t, least: t.where(F.col("level") <= least)
    old = State(below(state.items, level), below(state.communities, level - 1), below(state.members, level - 1), below(state.layers, level - 1))
    inputs = old.items.where(F.col("level") == level)
    fault = lambda df, kind, key: df.select(F.lit(kind).alias("fault"), F.col(key).cast("string").alias("id"))
    chosen = members.where("w IS NOT NULL")
    out = inputs.limit(0).select("item_id") if excluded is None else excluded.select("item_id").distinct()
    faults = [
        fault(communities.where(F.col("level") != level), "level of a community", "community_id"),
        fault(communities.groupBy("community_id").count().where("count > 1"), "repeated community", "community_id"),
        fault(chosen.join(communities, "community_id", "left_anti"), "unknown community", "community_id"),
        fault(chosen.join(inputs, "item_id", "left_anti"), "unknown item", "item_id"),
        fault(chosen.join(out, "item_id", "left_semi"), "excluded item", "item_id"),
        fault(inputs.join(out, "item_id", "left_anti").join(chosen, "item_id", "left_anti"), "item without community", "item_id"),
        fault(cards.join(old.items, "item_id", "left_semi"), "known card", "item_id"),
        card_faults(communities, cards, "commit").select("fault", F.coalesce(F.col("item_id").cast("string"), "community_id").alias("id")),
    ]
    all_faults = faults[0]
    for f in faults[1:]:
        all_faults = all_faults.unionByName(f)
    _refuse(all_faults, f"level {level} cannot be committed")
    weighed = communities.drop("support_mass").join(mass.support_mass(inputs, chosen), "community_id", "left").select(*(F.col(c) for c in old.communities.columns))
    spread = mass.redistribute(weighed, cards.where("confidence > 0")).select("item_id", F.col("support_mass").alias("_mass"))
    dealt = cards.join(spread, "item_id").withColumn("support_mass", F.col("_mass")).select(*old.items.columns)
    layer = state.layers.sparkSession.createDataFrame([(level, stop_reason, False, "", {})], LAYER)
    return State(old.items.unionByName(dealt), old.communities.unionByName(weighed), old.members.unionByName(members.select(*old.members.columns)), old.layers.unionByName(layer))


# ---- snapshots ---------------------------------------------------------------------------------


def saved(state: State, path: str, batch: int) -> None:
    """A snapshot under ``path``/batch=N: four tables, then a mark that it is whole."""
    at = f"{path}/batch={batch}"
    for name in TABLES:
        getattr(state, name).write.mode("overwrite").parquet(f"{at}/{name}")
    state.items.sparkSession.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{at}/done")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole snapshots under ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/done/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getParent().getName().removeprefix("batch=")) for f in found or [])


def restored(spark: SparkSession, path: str, vectors: DataFrame | None = None) -> tuple[State, int] | None:
    """The last whole snapshot and its number, or None.

    Items without a vector take it from ``vectors`` (item_id, vec); if any is then missing, it fails.
    """
    whole = snapshots(spark, path)
    if not whole:
        return None
    t = {k: spark.read.schema(v).parquet(f"{path}/batch={whole[-1]}/{k}") for k, v in TABLES.items()}
    lacks = F.coalesce(F.size("vec"), F.lit(0)) == 0
    if vectors is not None:
        filled = t["items"].join(vectors.select("item_id", F.col("vec").alias("_vec")), "item_id", "left")
        t["items"] = filled.withColumn("vec", F.when(lacks, F.col("_vec")).otherwise(F.col("vec"))).select(*t["items"].columns)
    _refuse(t["items"].where(lacks).select("item_id"), "a snapshot's items have no vectors")
    return State(**t), whole[-1]


# ---- synthesis ---------------------------------------------------------------------------------


def synthesis_modes(communities: DataFrame, members: DataFrame, items: DataFrame, cutoff: int = 0) -> DataFrame:
    """(community_id, mode): raw_extractor up to level ``cutoff`` where any member is a raw run, else experience_abstractor."""
    raw = members.where("w IS NOT NULL").select("community_id", "item_id").join(items.where(F.col("kind") == TRAJECTORY).select("item_id"), "item_id").select("community_id", F.lit(True).alias("_raw")).distinct()
    mode = F.when((F.col("level") <= cutoff) & F.coalesce("_raw", F.lit(False)), "raw_extractor").otherwise("experience_abstractor")
    return communities.join(raw, "community_id", "left").select("community_id", mode.alias("mode"))


def synthesis_payloads(state: State, community_ids: DataFrame) -> DataFrame:
    """A row per community asked for: mode, allowed operations, its members and the cards it gave before.

    Vectors stay out. Members of one community meet in a row: the token budget bounds them.
    """
    coms = state.communities.join(community_ids.select("community_id").distinct(), "community_id", "left_semi")
    shown = ("item_id", "kind", "text", "support_mass", "confidence", "version")
    held = items_of(state.members, coms).join(state.items.select(*shown), "item_id")
    members = held.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct(*shown[:1], "w", *shown[1:]))).alias("member_items"))
    before = cards_of(state.items, coms).join(state.items.select(*shown), "item_id")
    cards = before.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("previous"))
    out = coms.join(synthesis_modes(coms, state.members, state.items), "community_id").join(members, "community_id", "left").join(cards, "community_id", "left")
    operations = F.when(F.col("mode") == "raw_extractor", F.array(F.lit("update"), F.lit("add"))).otherwise(F.array(F.lit("update")))
    return out.select("community_id", "level", "mode", operations.alias("operations"), "support_mass", "member_items", "previous")


def probes(members: DataFrame, items: DataFrame, parents: DataFrame) -> DataFrame:
    """Temporary communities (community_id, parent, item_id, w) described for costing: level and metadata of
    their parent, mass, outcomes, token cost."""
    known = members.select("community_id", "parent").distinct().join(parents.select(F.col("community_id").alias("parent"), "level", "metadata"), "parent")
    edges = members.select("community_id", "item_id", F.coalesce("w", F.lit(1.0)).alias("w"))
    return known.join(mass.support_mass(items, edges), "community_id").join(mass.outcomes(items, edges), "community_id").join(mass.token_costs(items, edges), "community_id")


def prompt_costs(members: DataFrame, items: DataFrame, budget: int, estimate=None) -> DataFrame:
    """(community_id, token_cost, over_budget): the sum of the members' tokens; where that is within the
    budget, what ``estimate`` (community_id, members with items -> community_id, tokens) says, at least one.

    Prompts of communities that are over anyway are never made.
    """
    cost = mass.token_costs(items, members)
    if estimate is not None:
        inside = members.join(cost.where(F.col("token_cost") <= budget).select("community_id"), "community_id", "left_semi")
        said = estimate(inside.join(items, "item_id")).select("community_id", F.greatest(F.lit(1), F.col("tokens")).cast("long").alias("_said"))
        cost = cost.join(said, "community_id", "left").select("community_id", F.coalesce("_said", "token_cost").alias("token_cost"))
    return cost.withColumn("over_budget", F.col("token_cost") > budget)


def preflight(costs: DataFrame) -> DataFrame:
    """``prompt_costs`` as they are, unless a community is over its budget, which fails."""
    over = F.raise_error(F.concat(F.lit("a prompt passes its budget: "), F.col("community_id").cast("string"))).cast("boolean")
    return costs.withColumn("over_budget", F.when(F.col("over_budget"), over).otherwise(F.lit(False)))
