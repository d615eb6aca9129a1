"""Splits of task sets: slices, samples, exclusions by content, digests, comparison of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliced(rows: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows from the ``start``-th to before the ``end``-th by ``order``; a slice is the feature."""
    return rows.orderBy(order).offset(start).limit(max(0, end - start))


def sampled(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """``most`` rows of a shuffle that the seed alone decides: by the SHA-256 of seed:key."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(most)


def unfinished(tasks: DataFrame, outputs: DataFrame, cases: int) -> DataFrame:
    """Tasks that do not have all ``cases`` outputs yet."""
    done = outputs.groupBy("instance_id").agg(F.countDistinct("case").alias("_n")).where(F.col("_n") >= cases)
    return tasks.join(done.select("instance_id"), "instance_id", "left_anti")


def excluded_cases(full: DataFrame, held: DataFrame) -> DataFrame:
    """instance_id, prefix, method: the case of each held instance that is left out of the full set.

    full: instance_id, prefix, input_sha, answer_sha. held: instance_id, input_sha, answer_sha. The one
    case with both contents is it, else the one named 1_<id>; neither leaves a null prefix, which the
    caller must not accept.
    """
    same = full.join(held, ["instance_id", "input_sha", "answer_sha"]).groupBy("instance_id").agg(F.count("*").alias("_n"), F.min("prefix").alias("_by_hash"))
    named = full.where(F.col("prefix") == F.concat(F.lit("1_"), F.col("instance_id").cast("string"))).select("instance_id", F.col("prefix").alias("_by_name")).distinct()
    out = held.select("instance_id").distinct().join(same, "instance_id", "left").join(named, "instance_id", "left")
    by_hash = F.when(F.col("_n") == 1, F.col("_by_hash"))
    method = F.when(by_hash.isNotNull(), "hash_input_and_answer").when(F.col("_by_name").isNotNull(), "name")
    return out.select("instance_id", F.coalesce(by_hash, "_by_name").alias("prefix"), method.alias("method"))


def without_excluded(full: DataFrame, excluded: DataFrame) -> DataFrame:
    return full.join(excluded.select("instance_id", "prefix"), ["instance_id", "prefix"], "left_anti")


def set_digest(files: DataFrame) -> DataFrame:
    """files, digest of (path, size, sha): the same for the same rows in any order, and without one long
    list: hashes of rows are summed in 64 classes of their hash and the sums hashed in order."""
    each = F.sha2(F.concat_ws("\n", "path", F.col("size").cast("string"), "sha"), 256)
    number = lambda at: F.conv(F.substring(each, at, 15), 16, 10).cast("decimal(38,0)")
    parts = files.select((F.conv(F.substring(each, 1, 2), 16, 10).cast("int") % 64).alias("class"), number(3).alias("a"), number(18).alias("b")).groupBy("class").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("class", "n", "a", "b"))), lambda s: F.concat_ws(":", s["class"].cast("string"), s["n"].cast("string"), s["a"].cast("string"), s["b"].cast("string")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sha2(F.array_join(rows, ","), 256).alias("digest"))


def split_manifest(tasks: DataFrame, order: str, train: int) -> DataFrame:
    """tasks with their place in ``order`` and split: the first ``train`` are train, the rest heldout."""
    from ..streaming.admission import micro_batches

    placed = micro_batches(tasks, order, 1).withColumnRenamed("batch", "position")
    return placed.withColumn("split", F.when(F.col("position") < train, "train").otherwise("heldout"))


def compared_answers(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """instance_id, case, passed, message: expected cases drive; a missing answer is a failed row."""
    j = expected.select("instance_id", "case", F.col("value").alias("_want")).join(answers.select("instance_id", "case", F.col("value").alias("_got"), F.lit(True).alias("_there")), ["instance_id", "case"], "left")
    passed = F.col("_there").isNotNull() & F.col("_want").eqNullSafe(F.col("_got"))
    return j.select("instance_id", "case", passed.alias("passed"), F.when(F.col("_there").isNull(), "missing output").when(~passed, "value differs").alias("message"))


def instance_results(compared: DataFrame) -> DataFrame:
    """instance_id, soft (share of cases that pass), hard (all pass), first message."""
    first = F.min(F.when(~F.col("passed"), F.struct("case", "message")))
    return compared.groupBy("instance_id").agg(F.avg(F.col("passed").cast("int")).alias("soft"), F.bool_and("passed").cast("int").alias("hard"), first["message"].alias("message"))


def stage_report(stages: DataFrame, usage: DataFrame) -> DataFrame:
    """stage, seconds, runs, total_tokens: stages without usage have no tokens."""
    used = usage.groupBy("stage").agg(F.sum("total_tokens").alias("_t"))
    return stages.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("runs")).join(used, "stage", "left").select("stage", "seconds", "runs", F.coalesce("_t", F.lit(0)).cast("long").alias("total_tokens"))


def ordered_unique(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values in order of first sight, blanks left out."""
    first = rows.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "").groupBy(key, value).agg(F.min(order).alias("_at"))
    seen = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v"))))
    return first.groupBy(key).agg(F.transform(seen, lambda s: s["v"]).alias("values"))


def audit_rollup(cards: DataFrame, communities: DataFrame, most_k: int, tolerance: float = 1e-6) -> DataFrame:
    """level, communities, cards, most cards of one community, largest mass error, and whether all is well."""
    per = communities.select("community_id", "level", F.col("support_mass").alias("_mass")).join(cards.groupBy(F.col("source_community_id").alias("community_id")).agg(F.count("*").alias("_cards"), F.sum("support_mass").alias("_sum")), "community_id", "left")
    off = F.when(F.col("_cards").isNotNull(), F.abs(F.col("_mass") - F.col("_sum"))).otherwise(0.0)
    out = per.groupBy("level").agg(F.count("*").alias("communities"), F.coalesce(F.sum("_cards"), F.lit(0)).alias("cards"), F.coalesce(F.max("_cards"), F.lit(0)).alias("most_cards"), F.max(off).alias("max_error"))
    return out.withColumn("passed", (F.col("communities") <= most_k) & (F.col("max_error") <= tolerance))
