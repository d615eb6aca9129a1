"""Scores of runs: accuracies, pass rates over seeds, flips between runs, usage and prompt reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(results: DataFrame) -> DataFrame:
    """instruction_type (null: all), total, mean_soft over rows that have a score, hard_passes, mean_hard."""
    out = results.rollup("instruction_type").agg(
        F.grouping("instruction_type").alias("is_all"), F.count("*").alias("total"), F.avg("soft").alias("mean_soft"), F.count_if(F.col("hard") >= 1).alias("hard_passes"), F.avg(F.when(F.col("soft").isNotNull(), F.col("hard"))).alias("mean_hard")
    )
    return out


def pass_rates(results: DataFrame) -> DataFrame:
    """Over seeds: share of instances that pass in any and in every one."""
    each = results.groupBy("instance_id").agg(F.bool_or("passed").alias("any"), F.bool_and("passed").alias("all"))
    return each.agg(F.count("*").alias("instances"), F.avg(F.col("any").cast("int")).alias("pass_any"), F.avg(F.col("all").cast("int")).alias("pass_all"))


def qa_summary(scored: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scored.agg(F.count("*").alias("n"), zero("hard").alias("hard"), zero("em").alias("em"), zero("f1").alias("f1"))


def paired_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """outcome, n over instances of both runs: gained, lost, both_pass, both_fail, only_a, only_b."""
    pair = a.select("instance_id", F.col("passed").alias("_a")).join(b.select("instance_id", F.col("passed").alias("_b")), "instance_id", "full")
    kind = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").when(F.col("_a") & F.col("_b"), "both_pass").when(F.col("_b"), "gained").when(F.col("_a"), "lost").otherwise("both_fail")
    return pair.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


TOKEN_KEYS = ("prompt_tokens", "completion_tokens", "total_tokens", "input_tokens", "output_tokens")


def usage_rollup(log: DataFrame) -> DataFrame:
    """One row over a usage log (cache_hit, malformed, has_usage, tokens...): cached calls add no tokens."""
    fresh = ~F.col("malformed") & ~F.coalesce("cache_hit", F.lit(False))
    used = fresh & F.col("has_usage")
    sums = [F.coalesce(F.sum(F.when(used, F.col(k))), F.lit(0)).cast("long").alias(k) for k in TOKEN_KEYS]
    out = log.agg(F.count("*").alias("records"), F.count_if("malformed").alias("malformed_records"), F.count_if(~F.col("malformed") & F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"), F.count_if(fresh).alias("non_cache_records"), F.count_if(used).alias("records_with_usage"), F.count_if(fresh & ~F.col("has_usage")).alias("records_without_usage"), *sums)
    c = F.col
    status = F.when(c("records") == 0, "missing").when(c("non_cache_records") == 0, "all_cached").when(c("records_with_usage") == 0, "missing").when(c("records_with_usage") == c("non_cache_records"), "complete").otherwise("partial")
    mixed = F.when(c("cache_hits") == 0, "uncached_").otherwise("mixed_cached_")
    source = F.when(c("records") == 0, "empty_log").when(c("non_cache_records") == 0, "all_cached").when(c("records_with_usage") == 0, F.when(c("cache_hits") == 0, "uncached_without_usage").otherwise("mixed_cached_missing_usage")).otherwise(F.concat(mixed, status))
    return out.withColumns({"provider_usage_status": status, "call_source_status": source})


def usage_simple(log: DataFrame) -> DataFrame:
    """Token sums with cached calls counted in."""
    return log.agg(F.count("*").alias("records"), *(F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in TOKEN_KEYS))


def prompt_stats(prompts: DataFrame, limit: int, share: float = 0.95) -> DataFrame:
    """events, max_tokens, near_limit (from int(share * limit) on), over_limit."""
    return prompts.agg(F.count("*").alias("events"), F.max("tokens").alias("max_tokens"), F.count_if(F.col("tokens") >= int(share * limit)).alias("near_limit"), F.count_if(F.col("tokens") > limit).alias("over_limit"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Over texts (n_tokens, n_chunks): totals, maxima, mean count, how many needed several."""
    return chunks.agg(F.count("*").alias("texts"), F.sum("n_chunks").alias("chunks"), F.max("n_tokens").alias("max_tokens"), F.avg("n_chunks").alias("mean_chunks"), F.count_if(F.col("n_chunks") > 1).alias("over_limit"))
