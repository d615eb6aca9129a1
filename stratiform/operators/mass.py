"""Support mass, outcomes and token costs of communities.

items: item_id, support_mass, success, tokens. edges: item_id, community_id, w (selected weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def support_mass(items: DataFrame, edges: DataFrame) -> DataFrame:
    """community_id, support_mass: item mass times selected weight."""
    return edges.join(items.select("item_id", "support_mass"), "item_id").groupBy("community_id").agg(F.sum(F.col("support_mass") * F.col("w")).alias("support_mass"))


def outcomes(items: DataFrame, edges: DataFrame) -> DataFrame:
    """community_id, success_count, failure_count, outcome_mode (unknown outcomes alone count as mixed)."""
    joined = edges.join(items.select("item_id", "success"), "item_id")
    out = joined.groupBy("community_id").agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    mode = F.when((F.col("success_count") > 0) & (F.col("failure_count") == 0), "success").when((F.col("failure_count") > 0) & (F.col("success_count") == 0), "failure").otherwise("mixed")
    return out.withColumn("outcome_mode", mode)


def redistribute(communities: DataFrame, cards: DataFrame) -> DataFrame:
    """Mass of each card: its community's, in proportion to confidence.

    communities: community_id, support_mass. cards: item_id, source_community_id, confidence > 0.
    """
    total = cards.groupBy("source_community_id").agg(F.sum("confidence").alias("_total"))
    joined = cards.join(total, "source_community_id").join(communities.select(F.col("community_id").alias("source_community_id"), F.col("support_mass").alias("_mass")), "source_community_id")
    return joined.select("item_id", "source_community_id", (F.col("_mass") * F.col("confidence") / F.col("_total")).alias("support_mass"))


def sample_weights(items: DataFrame) -> DataFrame:
    """item_id, w: masses scaled to sum to the number of items; any invalid mass makes all one."""
    good = F.col("support_mass").isNotNull() & ~F.isnan("support_mass") & (F.abs("support_mass") < float("inf")) & (F.col("support_mass") > 0)
    sums = items.agg(F.count("*").alias("_n"), F.sum("support_mass").alias("_sum"), F.count_if(F.coalesce(good, F.lit(False))).alias("_good"))
    w = F.when(F.col("_good") == F.col("_n"), F.col("support_mass") * F.col("_n") / F.col("_sum")).otherwise(F.lit(1.0))
    return items.crossJoin(F.broadcast(sums)).select("item_id", w.alias("w"))  # one row is broadcast


def weight_stats(weights: DataFrame, mass: Column | None = None) -> DataFrame:
    return weights.agg(F.count("*").alias("n"), F.sum("w").alias("sum_w"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))


def token_costs(items: DataFrame, edges: DataFrame) -> DataFrame:
    """community_id, token_cost: tokens of its distinct items, weights apart."""
    once = edges.select("community_id", "item_id").distinct()
    return once.join(items.select("item_id", "tokens"), "item_id").groupBy("community_id").agg(F.sum("tokens").alias("token_cost"))


def conservation(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Largest and total difference of stored and recomputed masses."""
    pair = stored.select("community_id", F.col("support_mass").alias("_a")).join(recomputed.select("community_id", F.col("support_mass").alias("_b")), "community_id", "full")
    off = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return pair.agg(F.count("*").alias("communities"), F.max(off).alias("max_error"), F.sum(off).alias("sum_error"))


def community_sizes(edges: DataFrame) -> DataFrame:
    """How many communities have how many members."""
    return edges.groupBy("community_id").agg(F.countDistinct("item_id").alias("members")).groupBy("members").agg(F.count("*").alias("communities"))
