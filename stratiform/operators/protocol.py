"""Settings of runs: what is risky in them, what keeps two runs apart, and reports of what runs did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a full static build must say of itself before its tree is exported anew.
BASELINE = {"scenario": "static_build", "max_levels": "8", "tree_policy": "projected_gmm_bic", "soft_recursive_assignment": "cumulative_mass", "analyst_max_cards_l0": None}


def config_findings(configs: DataFrame, key: str) -> DataFrame:
    """(key, severity, area, finding, evidence): a row per risk in a run's settings (one row per run)."""
    c = lambda n: F.col(n)
    says = lambda *kv: F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in kv))
    budget = (c("summary_max_model_tokens").cast("double") * c("summary_budget_ratio").cast("double")).cast("long")
    room = budget - c("summary_prompt_overhead_reserve_tokens")
    cumulative = c("soft_recursive_assignment") == "cumulative_mass"
    train = c("train_end") - c("train_start")
    initial = F.least(F.greatest(c("dynamic_initial_count"), F.lit(0)), train)
    left = train - initial
    arrivals = F.when(c("dynamic_arrival_count") <= 0, left).otherwise(F.least(left, c("dynamic_arrival_count")))
    rules: list[tuple[Column, str, str, str, Column]] = [
        (budget >= c("summary_max_model_tokens") * 0.9, "high", "summary_budget", "the budget of a prompt leaves the model little room", says(("analyst_budget", budget), ("max_model_tokens", c("summary_max_model_tokens")))),
        (room <= 0, "blocker", "summary_budget", "no tokens are left for the evidence of members", says(("analyst_budget", budget), ("overhead", c("summary_prompt_overhead_reserve_tokens")))),
        ((c("analyst_max_prompt_tokens") > 0) & (c("analyst_max_prompt_tokens") < room), "high", "analyst_budget_override", "prompts may pass the build and then be refused", says(("analyst_max_prompt_tokens", c("analyst_max_prompt_tokens")), ("evidence_budget", room))),
        (c("budget_refinement_apply_to_level") == 0, "watch", "budget_refinement", "only communities of level 0 are kept within the budget", says(("budget_refinement_apply_to_level", F.lit(0)))),
        (cumulative, "info", "soft_membership", "the largest rank has no effect under cumulative mass", says(("recursive_assignment", c("soft_recursive_assignment")), ("top_r", c("soft_top_r_memberships")))),
        (cumulative, "info", "soft_membership", "the largest gap decides how many communities an item joins", says(("coverage", c("soft_cumulative_mass_coverage")), ("max_gap", c("soft_max_membership_gap")))),
        ((c("workers") > 4) & c("thinking"), "watch", "concurrency_timeout", "long replies of many workers may queue until they time out", says(("workers", c("workers")), ("generation_timeout", c("generation_timeout_seconds")), ("rollout_timeout", c("rollout_client_timeout_seconds")))),
        (c("chunked_embedding_enabled") & (c("embedding_batch_size") * c("embedding_chunk_tokens") >= c("embedding_max_model_len") * 4), "watch", "embedding_batching", "a batch of long chunks may be too much for the service", says(("batch_size", c("embedding_batch_size")), ("chunk_tokens", c("embedding_chunk_tokens")), ("max_model_len", c("embedding_max_model_len")))),
        ((c("tree_scenario") == "dynamic_update") & (initial + arrivals != train), "high", "dynamic_coverage", "some of the training records never arrive", says(("train_count", train), ("initial_count", initial), ("arrival_count", arrivals))),
    ]
    rows = F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(area).alias("area"), F.lit(what).alias("finding"), ev.alias("evidence"))) for hit, sev, area, what, ev in rules))
    return configs.select(key, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(key, "r.*")


def differing_settings(source: DataFrame, target: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(name, source, target): settings (name, value) that differ, volatile ones aside; none means one protocol."""
    a, b = (t.where(~F.col("name").isin(*volatile)) if volatile else t for t in (source, target))
    pair = a.select("name", F.col("value").alias("source")).join(b.select("name", F.col("value").alias("target")), "name", "full")
    return pair.where(~F.col("source").eqNullSafe(F.col("target")))


def baseline_faults(settings: DataFrame, baseline: dict[str, str | None] = BASELINE) -> DataFrame:
    """(name, expected, value) of settings (name, value) that a baseline run must have and does not."""
    wanted = settings.sparkSession.createDataFrame(list(baseline.items()), "name string, expected string")
    return F.broadcast(wanted).join(settings, "name", "left").where(~F.col("expected").eqNullSafe(F.col("value"))).select("name", "expected", "value")


def assert_reexportable(source: DataFrame, target: DataFrame, volatile: tuple[str, ...] = ()) -> None:
    """Refuse to export a tree anew unless both runs are the baseline and agree in every setting."""
    for what, faults in (("source", baseline_faults(source)), ("target", baseline_faults(target)), ("both", differing_settings(source, target, volatile))):
        if some := faults.limit(10).collect():
            raise ValueError(f"the tree cannot be exported anew, {what}: {sorted(map(tuple, some), key=str)}")


def selection_records(tasks: DataFrame, hits: DataFrame, top_k: int, agent: str) -> DataFrame:
    """A row per task (instance_id, instruction, instruction_type, answer_position, query) with the ids and
    scores of the nodes it was given (instance_id, node_id, score, rank), best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "node_id", "score")))
    given = hits.where(F.col("rank") <= top_k).groupBy("instance_id").agg(ordered.alias("_h"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return tasks.join(given, "instance_id", "left").select(
        "instance_id", "instruction", "instruction_type", "answer_position", "query", F.lit(agent).alias("agent"), F.lit(top_k).alias("top_k"),
        F.coalesce(F.transform("_h", lambda h: h["node_id"].cast("string")), empty("string")).alias("selected_node_ids"), F.coalesce(F.transform("_h", lambda h: h["score"]), empty("double")).alias("selected_node_scores"),
    )


def truncation_report(prepared: DataFrame, key: str, most: int) -> DataFrame:
    """(key, original_chars, truncated_chars, token_count, max_input_tokens) of the inputs that were cut;
    prepared: key, original, prepared (struct of ``payload.prepared_for_embedding``)."""
    cut = prepared.where("prepared.truncated")
    return cut.select(key, F.length("original").cast("long").alias("original_chars"), F.length("prepared.text").cast("long").alias("truncated_chars"), F.col("prepared.token_count").alias("token_count"), F.lit(most).alias("max_input_tokens"))


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """A cache (namespace, key, vec) with rows put in or replaced; of several fresh rows of a key the last
    by ``seq`` counts."""
    last = fresh.groupBy("namespace", "key").agg(F.max_by("vec", "seq").alias("vec"))
    return cache.join(last, ["namespace", "key"], "left_anti").select("namespace", "key", "vec").unionByName(last)
