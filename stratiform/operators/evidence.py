"""What is read out of run records: task fields, ids, outcomes, short views; and what is masked in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sections of a task message, parts of names that mark secrets, signs of a passing fault.
TASK_FIELDS = ("working_directory", "instruction", "spreadsheet_path", "spreadsheet_content", "instruction_type", "answer_position", "output_path")
SECRET_MARKS = ("api-key", "api_key", "apikey", "token", "secret", "password", "authorization", "bearer")
PASSING_FAULTS = (r"\b429\b", "mpe-429", "resource exhausted", "resource_exhausted", "rate limit", "too many requests", "请求服务异常", "模型提供方限流")
TOOLS = ("glob", "read", "grep")
# Aliases of placements, and the placements.
PLACEMENT_ALIASES = {"main": "skill_md", "skill": "skill_md", "skill.md": "skill_md", "references": "reference", "ref": "reference", "code": "script", "scripts": "script"}
PLACEMENTS = ("skill_md", "reference", "script")
# How names of agent logs begin, and the endings that name a trial or a seed.
LOG_PREFIXES = ("cli_skill_preloaded_agent_", "cli_only_agent_")
TRIAL_ENDING = r"(?:__|_)(?:trial|repeat|run)[-_]?\d+.*$"
SEED_ENDING = r"(?:__|_)seed[-_]?\d+.*$"
GOOD_WORDS, BAD_WORDS = ("success", "succeeded", "pass", "passed"), ("failure", "failed", "fail")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ---- task messages and ids ---------------------------------------------------------------------


def first_task(messages: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, task): the first user message that has an instruction section, else the first of all."""
    asked = messages.where(F.col(role) == "user")
    has = F.contains(text, F.lit("### instruction"))
    pick = asked.groupBy(key).agg(F.min(F.struct((~has).alias("other"), F.col(turn).alias("turn"), F.col(text).alias("text"))).alias("m"))
    body = F.when(~F.col("m.other") & F.startswith("m.text", F.lit("Task:")), T.stripped(F.substr("m.text", F.lit(6)))).otherwise(F.col("m.text"))
    return pick.select(key, body.alias("task"))


def task_fields(task: Column) -> list[Column]:
    """A column per section of a task; a section ends at the next heading or at a rule."""
    out = []
    for f in TASK_FIELDS:
        body = F.regexp_extract(task, rf"(?s)(?:\A|\n)### {f}[ \t]*(?:\n(.*?))?(?=\n### |\z)", 1)
        out.append(_blank_to_null(T.stripped(F.regexp_replace(T.stripped(body), r"(?s)\n---.*\z", ""))).alias(f))
    return out


def inferred_task_id(path: Column, spreadsheet_path: Column) -> Column:
    """The id in an agent log's file name, else the folder of the task's workbook, else the file name."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\z", 1), r"(?<=.)\.[^.]*\z", "")
    named = F.coalesce(*(F.when(F.startswith(stem, F.lit(p)), F.substr(stem, F.lit(len(p) + 1))) for p in LOG_PREFIXES))
    bare = F.regexp_replace(F.regexp_replace(named, TRIAL_ENDING, ""), SEED_ENDING, "")
    folder = F.regexp_extract(spreadsheet_path, r"([^/\\]+)[/\\]+[^/\\]+[/\\]*$", 1)
    return F.coalesce(_blank_to_null(bare), _blank_to_null(folder), stem)


def inferred_trial(path: Column, given: Column) -> Column:
    """The trial that the payload names, else the path's, else 0."""
    near = F.regexp_extract(path, r"((?:[^/]+/){0,3}[^/]+)\z", 1)
    of_path = [_blank_to_null(F.regexp_extract(near, rf"(?i){w}[-_]?([0-9]+)", 1)).cast("long") for w in ("trial", "repeat", "run")]
    return F.coalesce(given.cast("long"), *of_path, F.lit(0).cast("long"))


def trajectory_id(task_id: Column, trial: Column, seed: Column, version: Column) -> Column:
    return F.concat(task_id, F.lit("::trial"), trial.cast("string"), F.lit("::seed"), F.coalesce(seed, F.lit("none")), F.lit("::log"), version)


# ---- outcomes ----------------------------------------------------------------------------------


def inferred_success(flag: Column, score: Column, outcome: Column) -> Column:
    """A flag as it is, else whether a score is above zero, else what an outcome's word says, else unknown."""
    word = F.lower(outcome)
    return F.coalesce(flag, score > 0, F.when(word.isin(*GOOD_WORDS), True).when(word.isin(*BAD_WORDS), False))


def failure_reason(reason: Column) -> Column:
    """The reason, unless it is blank or gives an expected value away."""
    t = T.stripped(F.coalesce(reason, F.lit("")))
    return F.when((t == "") | F.contains(F.lower(t), F.lit("expected")), "answer_mismatch").otherwise(t)


def is_passing_fault(reply: Column) -> Column:
    """Whether a reply looks like a fault of the provider that a retry would pass."""
    return F.coalesce(F.lower(reply).rlike("|".join(PASSING_FAULTS)), F.lit(False))


def is_retryable(status: Column) -> Column:
    """Faults without a status are retried; of those with one, time-outs, conflicts, limits and server faults."""
    return F.when(status.isNull(), True).otherwise(status.isin(408, 409, 429) | (status >= 500))


def tool_name(given: Column, command: Column, default: str = "tool") -> Column:
    """The name given, else what stands before the command's first bracket."""
    return F.coalesce(_blank_to_null(T.stripped(given)), _blank_to_null(T.stripped(F.regexp_extract(command, r"(?s)\A(.*?)\(", 1))), F.lit(default))


def tool_call(reply: Column) -> Column:
    """Struct (name, arguments as JSON) of the tagged call of a reply, or null."""
    plain = T.without_thinking(reply)
    body = F.coalesce(*(_blank_to_null(F.regexp_extract(plain, rf"(?is)<{t}>\s*(.*?)\s*</{t}>", 1)) for t in ("tool_call", "tool")))
    get = lambda *keys: F.coalesce(*(_blank_to_null(F.get_json_object(body, f"$.{k}")) for k in keys))
    name, arguments = T.stripped(get("name", "tool", "tool_name")), get("arguments", "args")
    valid = F.try_parse_json(body).isNotNull() & name.isin(*TOOLS)
    return F.when(valid, F.struct(name.alias("name"), F.when(F.startswith(arguments, F.lit("{")), arguments).otherwise("{}").alias("arguments")))


def placement(target: Column) -> Column:
    """One of three targets by its aliases; any other name fails."""
    word = F.lower(F.trim(F.coalesce(target, F.lit(""))))
    full = F.coalesce(*(F.when(word == alias, F.lit(target)) for alias, target in PLACEMENT_ALIASES.items()), word)
    return F.coalesce(F.when(full.isin(*PLACEMENTS), full), F.raise_error(F.concat(F.lit("unknown placement: "), word)).cast("string"))


# ---- masking and short views -------------------------------------------------------------------


def redacted(arguments: Column) -> Column:
    """A command's arguments with secrets masked: after a sensitive flag, after the = of one, after bearer."""
    marked = lambda c: c.rlike("|".join(SECRET_MARKS))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))

    def step(acc: Column, part: Column) -> Column:
        low = F.lower(part)
        flag = F.startswith(part, F.lit("--")) & marked(low)
        pair = F.contains(part, F.lit("=")) & marked(F.substring_index(low, "=", 1))
        shown = F.when(acc["hide"], "<redacted>").when(flag, part).when(pair, F.concat(F.substring_index(part, "=", 1), F.lit("=<redacted>"))).when(F.startswith(low, F.lit("bearer ")), "Bearer <redacted>").otherwise(part)
        return F.struct(F.array_append(acc["out"], shown).alias("out"), (~acc["hide"] & flag).alias("hide"))

    return F.aggregate(arguments, start, step, lambda acc: acc["out"])


def head_tail(steps: Column, most: int, omitted: Column) -> Column:
    """The first half and the last half of ``most`` steps, with ``omitted`` between them if any are left out."""
    head = most // 2
    tail = most - head
    return F.when(F.size(steps) <= most, steps).otherwise(F.concat(F.slice(steps, 1, head), F.array(omitted), F.slice(steps, F.size(steps) - tail + 1, F.lit(tail))))


def compact_view(lines: Column, most_chars: int, most_steps: int, most_step_chars: int) -> Column:
    """Text of a run's steps within ``most_chars``: all steps clipped, else head and tail, else at most six
    at half the width, else the last of these clipped as a whole."""
    marker = F.lit("...")
    full = F.array_join(F.transform(lines, lambda s: T.clip_total(s, most_step_chars)), "\n")
    some = F.array_join(F.transform(head_tail(lines, most_steps, marker), lambda s: T.clip_total(s, most_step_chars)), "\n")
    few = F.array_join(F.transform(head_tail(lines, min(6, most_steps), marker), lambda s: T.clip_total(s, max(800, most_step_chars // 2))), "\n")
    fits = lambda c: F.length(c) <= most_chars
    return F.when(fits(full), full).when(fits(some), some).when(fits(few), few).otherwise(T.clip_total(few, most_chars))


def numbered_context(cards: DataFrame, query: str, most: int) -> DataFrame:
    """(query, context): retrieved cards in order of rank, as far as ``most`` characters reach."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("name"), F.lit("\n"), F.col("content"), F.lit("\n\n"))
    before = F.coalesce(F.sum(F.length("_b")).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cards.withColumn("_b", block).withColumn("_at", before).where(F.col("_at") < most)
    pieces = F.array_sort(F.collect_list(F.struct("rank", F.left("_b", (F.lit(most) - F.col("_at")).cast("int")).alias("b"))))
    return cut.groupBy(query).agg(F.array_join(F.transform(pieces, lambda p: p["b"]), "").alias("context"))
