"""Run records out of chat logs and result files.

A log is (path, turn, role, text) of its messages; a result row is JSON text with its file and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence

# Fields that hold an id, a trial, a seed; fields that say a case passed; words for yes.
ID_FIELDS = ("id", "task_id", "instance_id")
TRIAL_FIELDS = ("trial_index", "trial", "repeat", "run_index", "sample_index")
SEED_FIELDS = ("seed", "run_seed", "shuffle_seed")
CASE_FIELDS = ("passed", "success", "result", "hard_pass")
YES = ("true", "1", "yes", "pass", "passed", "success", "succeeded")
#: Lists that may hold the rows of a record file and of a data set, the first that does counts.
RECORD_LISTS, DATASET_LISTS = ("records", "data", "results", "items"), ("results", "data", "instances")
MOST_CASE_NOTES = 20


def _get(row: Column, *fields: str) -> Column:
    return F.coalesce(*(F.get_json_object(row, f"$.{f}") for f in fields))


def _filled(row: Column, *fields: str) -> Column:
    """The first field that is neither missing nor ''."""
    return F.coalesce(*(F.nullif(F.get_json_object(row, f"$.{f}"), F.lit("")) for f in fields))


# ---- rows of JSON files ------------------------------------------------------------------------


def _elements(text: Column) -> Column:
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>"))


def listed_rows(files: DataFrame, lists: tuple[str, ...] = RECORD_LISTS, filled: bool = False) -> DataFrame:
    """(path, pos, row): objects of JSON files (path, text): a list, or the first list under a known name.

    ``filled``: an empty list does not count. A list that holds anything but objects fails.
    """
    under = [_elements(F.get_json_object("text", f"$.{k}")) for k in lists]
    under = [F.when(F.size(u) > 0, u) for u in under] if filled else under
    rows = F.coalesce(_elements(F.col("text")), *under, F.array().cast("array<string>"))
    bad = F.exists(rows, lambda r: ~F.startswith(F.ltrim(r), F.lit("{")))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("a row is no object: "), "path")).cast("array<string>")).otherwise(rows)
    return files.select("path", F.posexplode(checked).alias("pos", "row"))


def result_rows(files: DataFrame) -> DataFrame:
    """(path, pos, row) of result files (path, text): a list, the list under results or records, or one
    result by itself. Text that is no JSON and elements that are no objects are left out."""
    parsed = files.where(F.try_parse_json("text").isNotNull())
    body = F.ltrim("text")
    under = F.coalesce(*(F.when(F.size(x) > 0, x) for x in (_elements(F.get_json_object("text", f"$.{k}")) for k in ("results", "records"))))
    one = F.when(F.startswith(body, F.lit("{")) & F.arrays_overlap(F.json_object_keys("text"), F.array(*map(F.lit, ID_FIELDS))), F.array("text"))
    rows = F.coalesce(_elements(F.col("text")), under, one, F.array().cast("array<string>"))
    return parsed.select("path", F.posexplode(rows).alias("pos", "row")).where(F.startswith(F.ltrim("row"), F.lit("{")))


def result_key(task: Column, trial: Column, seed: Column) -> Column:
    return F.concat(task, F.lit("::trial"), trial.cast("string"), F.lit("::seed"), F.coalesce(F.nullif(seed, F.lit("")), F.lit("none")))


def trial_of(row: Column, path: Column) -> Column:
    """The trial that a row names, else its path, else 0."""
    given = F.coalesce(*(F.get_json_object(row, f"$.{f}").try_cast("long") for f in TRIAL_FIELDS))
    named = F.coalesce(*(F.get_json_object(row, f"$.{f}") for f in TRIAL_FIELDS)).isNotNull()
    return F.coalesce(given, F.when(named, F.lit(0).cast("long")), evidence.inferred_trial(path, given))


def seed_of(row: Column, path: Column) -> Column:
    near = F.regexp_extract(path, r"((?:[^/]+/){0,3}[^/]+)\z", 1)
    return F.coalesce(_get(row, *SEED_FIELDS), F.nullif(F.regexp_extract(near, r"(?i)seed[-_]?([0-9]+)", 1), F.lit("")))


def results_index(rows: DataFrame) -> DataFrame:
    """(key, row): result rows under their bare id and their trial's; the last by path and place wins."""
    ident = _filled(F.col("row"), *ID_FIELDS)
    keyed = rows.withColumn("_id", ident).where("_id IS NOT NULL")
    keys = F.array_distinct(F.array("_id", result_key(F.col("_id"), trial_of(F.col("row"), F.col("path")), seed_of(F.col("row"), F.col("path")))))
    return keyed.select(F.explode(keys).alias("key"), "path", "pos", "row").groupBy("key").agg(F.max_by("row", F.struct("path", "pos")).alias("row"))


def _yes(value: Column) -> Column:
    """Whether a JSON value means yes: true, a number above 0, one of ``YES``."""
    return F.coalesce(F.lower(T.stripped(value)).isin(*YES) | (value.try_cast("double") > 0), F.lit(False))


def result_fields(row: Column) -> Column:
    """Struct (success, score, feedback) of a result row, with fallbacks between its fields.

    Counts come from the cases where the row gives none; the hard score from the counts, else from
    success or passed; the score is the soft one, else the share of cases, else whether it passed.
    """
    none = F.struct(F.lit(False).alias("success"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("feedback"))
    some = lambda x: F.when(F.size(x) > 0, x)

    def of_row(row: Column) -> Column:
        cases = F.coalesce(*(T.once(_elements(F.get_json_object(row, f"$.{f}")), some) for f in ("test_cases", "cases")))
        return T.once(F.struct(cases.alias("cases")), lambda c: of_cases(row, c["cases"]))

    def of_cases(row: Column, cases: Column) -> Column:
        passed_case = lambda c: T.once(_get(c, *CASE_FIELDS), _yes)
        said = {f"_{f}": F.get_json_object(row, f"$.{f}") for f in ("success", "passed")}
        counts = {
            "n": F.when(cases.isNotNull(), F.size(cases).cast("double")),
            "ok": F.when(cases.isNotNull(), F.size(F.filter(cases, passed_case)).cast("double")),
            **{f: F.get_json_object(row, f"$.{f}").try_cast("double") for f in ("total_count", "passed_count", "soft_score", "hard_score")},
        }
        return T.once(F.struct(*(v.alias(k) for k, v in (said | counts).items())), lambda g: scored(row, cases, g))

    def scored(row: Column, cases: Column, g: Column) -> Column:
        total, passed = F.coalesce(g["total_count"], g["n"]), F.coalesce(g["passed_count"], g["ok"])
        soft = F.coalesce(g["soft_score"], g["ok"] / g["n"], F.when(total != 0, passed / total))
        flag = F.when(g["_success"].isNotNull(), _yes(g["_success"])).otherwise(_yes(g["_passed"]))
        counted = F.when(passed.isNotNull() & total.isNotNull(), (passed.cast("long") == total.cast("long")) & (total.cast("long") > 0))
        hard = F.coalesce(g["hard_score"], counted.cast("double"), flag.cast("double"))
        success = (hard >= 1) | _yes(g["_success"]) | _yes(g["_passed"])
        notes = F.transform(F.coalesce(cases, F.array().cast("array<string>")), lambda c: _filled(c, "message", "error"))
        notes = F.slice(F.filter(notes, lambda x: x.isNotNull() & (T.stripped(x) != "")), 1, MOST_CASE_NOTES)
        feedback = F.array_join(F.filter(F.concat(F.array(_filled(row, "error"), _filled(row, "message")), notes), lambda x: x.isNotNull()), "; ")
        return T.once(success, lambda s: F.struct(s.alias("success"), F.coalesce(soft, s.cast("double")).alias("score"), F.nullif(feedback, F.lit("")).alias("feedback")))

    return F.when(row.isNull(), none).otherwise(T.once(row, of_row))


# ---- records of logs ---------------------------------------------------------------------------


def action(reply: Column) -> Column:
    """The action of a reply, as it is written: the end of the task, else from the braces after an Action
    mark to those that end the reply, else to the first that close, or ''."""
    trimmed = T.stripped(reply)
    last = F.regexp_extract(trimmed, r"Action:\s*(\{[\s\S]*?\})\s*\z", 1)
    return F.when(F.contains(reply, F.lit("ACTION: TASK_COMPLETE")), "ACTION: TASK_COMPLETE").when(last != "", last).otherwise(F.regexp_extract(reply, r"Action:\s*(\{[\s\S]*?\})", 1))


def log_records(messages: DataFrame, results: DataFrame, log_format: str, metadata: DataFrame | None = None) -> DataFrame:
    """A record per log of messages (path, turn, role, text), joined to ``results`` (key, row).

    Task, ids and trial come from ``metadata`` (path, row: JSON of what the log itself says), from the
    task message, the file name, and last the result, which is that of the trial, else of the task.
    Steps are the assistant's messages with what the next user message observed.
    """
    task = evidence.first_task(messages, "path")
    fields = dict(zip(evidence.TASK_FIELDS, evidence.task_fields(F.col("task"))))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    logs = messages.groupBy("path").agg(ordered.alias("_all")).join(task, "path", "left")
    logs = logs.withColumn("_said", F.lit(None).cast("string")) if metadata is None else logs.join(metadata.select("path", F.col("row").alias("_said")), "path", "left")
    logs = logs.withColumns({f"_{k}": v for k, v in fields.items()})
    said, path = F.coalesce("_said", F.lit("{}")), F.col("path")
    logs = logs.withColumn("task_id", F.coalesce(_filled(said, "task_id", "id", "instance_id"), evidence.inferred_task_id(path, F.col("_spreadsheet_path"))))
    logs = logs.withColumns({"_trial": trial_of(said, path), "_seed": seed_of(said, path)})
    by = results.select("key", F.col("row").alias("_r"))
    logs = logs.withColumn("_key", result_key(F.col("task_id"), F.col("_trial"), F.col("_seed")))
    logs = logs.join(by.withColumnsRenamed({"key": "_key", "_r": "_own"}), "_key", "left").join(by.withColumnsRenamed({"key": "task_id", "_r": "_bare"}), "task_id", "left")
    logs = logs.withColumn("_row", F.coalesce("_own", "_bare"))
    logs = logs.withColumns({
        "trial_index": F.coalesce(*(F.get_json_object("_row", f"$.{f}").try_cast("long") for f in TRIAL_FIELDS), "_trial"),
        "seed": F.coalesce(_get(F.col("_row"), *SEED_FIELDS), "_seed"),
        "_fields": result_fields(F.col("_row")),
        "version_id": F.coalesce(_filled(F.col("_row"), "version_id"), _filled(said, "version_id"), F.left(F.sha1("path"), F.lit(10))),
    })

    def step(i: Column) -> Column:
        raw, after = F.get(F.col("_all"), i)["text"], F.get(F.col("_all"), i + 1)
        heard = T.stripped(after["text"])
        seen = F.when((after["role"] == "user") & F.startswith(heard, F.lit("Observation:")), T.stripped(F.substr(heard, F.lit(13))))
        act = action(raw)
        return F.struct(raw.alias("raw_model_output"), act.alias("action"), F.coalesce(seen, F.lit("")).alias("observation"), F.when(F.contains(act, F.lit("bash")), "bash").alias("tool_name"), (act != "").alias("action_valid"))

    at = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: F.get(F.col("_all"), i)["role"] == "assistant")
    made = F.filter(F.transform(at, step), lambda s: (s["action"] != "") | (s["observation"] != "") | (s["raw_model_output"] != ""))
    steps = F.transform(made, lambda s, i: F.struct(i.cast("long").alias("step_id"), *(s[c].alias(c) for c in ("raw_model_output", "action", "observation", "tool_name", "action_valid"))))
    final = F.try_element_at(F.filter(F.col("_all"), lambda m: m["role"] == "assistant"), F.lit(-1))["text"]
    told = [F.coalesce(f"_{k}", _filled(F.col("_row"), k), F.lit("")).alias(k) for k in ("instruction", "instruction_type", "answer_position", "spreadsheet_path", "output_path")]
    ident = evidence.trajectory_id(F.col("task_id"), F.col("trial_index"), F.nullif("seed", F.lit("")), F.col("version_id"))
    return logs.select(
        ident.alias("trajectory_id"), "task_id", "trial_index", "seed", *told, final.alias("final_response"),
        F.col("_fields.success").alias("success"), F.col("_fields.score").alias("verifier_score"), F.col("_fields.feedback").alias("verifier_feedback"),
        steps.alias("steps"), "path", F.lit(log_format).alias("log_format"),
    )


def first_seen_metadata(lines: DataFrame) -> DataFrame:
    """(path, row): of JSON lines (path, line, value), the first value of each run field, as JSON."""
    names = ("trial_index", "seed", "run_seed", "repeat", "id", "task_id", "instance_id")
    first = [F.min_by(v, F.when(v.isNotNull(), F.col("line"))).alias(n) for n in names for v in [F.get_json_object("value", f"$.{n}")]]
    valid = lines.where(F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    return valid.groupBy("path").agg(*first).select("path", F.to_json(F.struct(*names)).alias("row"))


def one_per_run(*formats: DataFrame) -> DataFrame:
    """The first record of each trajectory: by format in the order given, then by path."""
    out = None
    for rank, records in enumerate(formats):
        tagged = records.withColumn("_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged)
    names = [c for c in out.columns if c not in ("trajectory_id", "_rank", "path")]
    best = out.groupBy("trajectory_id").agg(F.min_by(F.struct("path", *names), F.struct("_rank", "path")).alias("r"))
    return best.select("trajectory_id", "r.*")
