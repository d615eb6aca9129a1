"""Views of run records: what is compared, what is shown, and the items and records that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence

#: Fixed value: tokens of a member beside its text.
MEMBER_OVERHEAD = 128


def similarity_text(instruction: Column, kind: Column, steps: Column) -> Column:
    """Text by which runs are compared: task, type and steps; positions, paths and verdicts stay out."""
    line = lambda s: F.concat(F.lit("[step "), s["step_id"].cast("string"), F.lit("] raw_model_output:\n"), *(x for c, head in (("raw_model_output", ""), ("action", "\naction:\n"), ("observation", "\nobservation:\n")) for x in (F.lit(head), T.stripped(F.coalesce(s[c], F.lit(""))))))
    head = F.concat(F.lit("instruction: "), F.coalesce(instruction, F.lit("")), F.lit("\ninstruction_type: "), F.coalesce(kind, F.lit("")), F.lit("\ntrajectory_steps:"))
    return T.stripped(F.concat_ws("\n", head, F.nullif(F.array_join(F.transform(steps, line), "\n"), F.lit(""))))


def evidence_text(record: DataFrame) -> Column:
    """All that is known of a run as JSON: inputs, outcome, steps, metadata."""
    c = lambda *names: F.struct(*names)
    more = [F.col(n) for n in ("runtime_metadata", "service_metadata", "extra") if n in record.columns]
    bundle = F.struct(
        "trajectory_id", "task_id", "trial_index",
        c("instruction", "instruction_type", "answer_position", "spreadsheet_path", "output_path").alias("q_i"),
        c("success", "verifier_score", "verifier_feedback", "final_response").alias("y_i"),
        F.col("steps").alias("trajectory_steps"), *more,
    )
    return F.to_json(bundle, {"ignoreNullFields": "false"})


def items_of(records: DataFrame, most_chars: int | None = None) -> DataFrame:
    """Level-0 items of run records: id, text to compare, mass one, outcome, and token counts of both texts.

    ``most_chars``: clip the evidence to so many characters. A member's overhead is added to its count.
    """
    shown = evidence_text(records)
    shown = shown if most_chars is None else T.clip_total(shown, most_chars)
    held = records.withColumns({"_text": similarity_text(F.col("instruction"), F.col("instruction_type"), F.col("steps")), "_shown": shown})
    return held.select(
        F.col("trajectory_id").alias("item_id"), F.lit(0).alias("level"), F.lit("trajectory").alias("kind"), F.col("_text").alias("text"), F.lit(1.0).alias("support_mass"), "success", "verifier_score", "task_id",
        (T.token_estimate(F.col("_shown")) + MEMBER_OVERHEAD).alias("tokens"), T.token_estimate(F.col("_text")).alias("text_tokens"), F.col("_shown").alias("evidence"),
    )


# ---- records of question runs ------------------------------------------------------------------


def conversation_steps(events: DataFrame, key: str) -> DataFrame:
    """(key, step_id, raw_model_output, action, observation, tool_name, action_valid) of events (key, pos,
    type, content, cmd, obs, tool, has_calls).

    A tool call is a step with the model's last message; a message is a step by itself unless it calls
    tools, or the very next event is a call, which then takes the message over.
    """
    by = Window.partitionBy(key).orderBy("pos")
    used = events.where(F.col("type").isin("message", "tool_call"))
    said = F.last(F.when(F.col("type") == "message", F.coalesce("content", F.lit(""))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    seen = used.withColumns({"_said": F.coalesce(said, F.lit("")), "_next": F.lead("type").over(by)})
    message, calls = F.col("type") == "message", F.coalesce("has_calls", F.lit(False)) | F.coalesce(evidence.tool_call(F.col("content")).isNotNull(), F.lit(False))
    kept = seen.where(~message | (~calls & ~F.col("_next").eqNullSafe("tool_call")))
    text = lambda c: F.when(message, "").otherwise(F.coalesce(c, F.lit("")))
    return kept.select(
        key, (F.row_number().over(by) - 1).cast("long").alias("step_id"), F.col("_said").alias("raw_model_output"), text("cmd").alias("action"), text("obs").alias("observation"),
        F.when(~message, evidence.tool_name(F.col("tool"), F.col("cmd"))).alias("tool_name"), (message | ~F.startswith(F.coalesce("obs", F.lit("")), F.lit("[tool error"))).alias("action_valid"),
    )


def question_records(results: DataFrame, steps: DataFrame | None = None, benchmark: str = "qa") -> DataFrame:
    """Run records of question results (id, question, task_type, response, hard, soft, fail_reason), with
    the steps of ``conversation_steps`` (id, ...), if given; ``benchmark`` names ids and the default type."""
    hard = F.coalesce(F.col("hard").cast("int"), F.lit(0)) != 0
    out = results.select(
        F.concat(F.lit(f"{benchmark}:"), F.col("id").cast("string")).alias("trajectory_id"), F.col("id").cast("string").alias("task_id"), F.lit(0).cast("long").alias("trial_index"),
        F.coalesce("question", F.lit("")).alias("instruction"), F.coalesce(F.nullif("task_type", F.lit("")), F.lit(benchmark)).alias("instruction_type"), F.coalesce("response", F.lit("")).alias("final_response"),
        hard.alias("success"), F.coalesce(F.col("soft").cast("double"), F.lit(0.0)).alias("verifier_score"), F.when(hard, "correct").otherwise(evidence.failure_reason(F.col("fail_reason"))).alias("verifier_feedback"), F.col("id").alias("_id"),
    )
    if steps is None:
        return out.drop("_id")
    names = ("step_id", "raw_model_output", "action", "observation", "tool_name", "action_valid")
    held = steps.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("steps"))
    return out.join(held, "_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(held.schema["steps"].dataType))).drop("_id")
