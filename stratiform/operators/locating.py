"""Which files of a listing a data set or a case means, and splits read as one stream.

A listing is (folder, name): the reader takes it from Spark's own file listing; only names are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of a data set's file, in the order in which they are tried by a runner and by a scorer.
RUNNER_NAMES = ("data.jsonl", "sample_data.jsonl", "dataset.json", "data.json")
SCORER_NAMES = ("dataset.json", "data.json", "data.jsonl", "sample_data.jsonl")
_OUTPUTS = "(?i)answer|output|golden"
# Patterns of a case's files, the first that any file of a folder fits counts; only the
# first file counts of a pattern marked single.
ANSWER_FILES = ((r"_answer\.xlsx$", "", False), (r"_golden\.xlsx$", "", False), (r"^golden\.xlsx$", "", True))
VERIFIED_INPUTS = ((r"_init\.xlsx$", "", False), (r"^initial\.xlsx$", "", True), (r"^input\.xlsx$", "", True))
RUNNER_INPUTS = ((r"_input\.xlsx$", "", False), *VERIFIED_INPUTS, (r"\.xlsx$", _OUTPUTS, False))
FULL_INPUTS = ((r"_input.*\.xlsx$|^(initial|input)\.xlsx$", _OUTPUTS, False),)


def dataset_files(listing: DataFrame, order: tuple[str, ...] = SCORER_NAMES) -> DataFrame:
    """(folder, name): the file of each folder's data set: the first known name, else the least name that
    ends in .json or .jsonl; folders without any give nothing."""
    known = F.array_position(F.array(*map(F.lit, order)), F.col("name"))
    rank = F.when(known > 0, known).when(F.col("name").rlike(r"\.jsonl?$"), F.lit(len(order) + 1))
    ranked = listing.select("folder", "name", rank.cast("int").alias("_rank")).where("_rank IS NOT NULL")
    return ranked.groupBy("folder").agg(F.min(F.struct("_rank", "name")).alias("m")).select("folder", F.col("m.name").alias("name"))


def case_files(listing: DataFrame, chain: tuple[tuple[str, str, bool], ...]) -> DataFrame:
    """(folder, name): the files of each folder that fit the first pattern of the chain that any fits."""
    rank: Column = F.lit(None).cast("int")
    for i, (pattern, unless, _) in reversed(list(enumerate(chain))):
        fits = F.col("name").rlike(pattern) & (~F.col("name").rlike(unless) if unless else F.lit(True))
        rank = F.when(fits, i).otherwise(rank)
    ranked = listing.select("folder", "name", rank.alias("_rank")).where("_rank IS NOT NULL")
    best = F.min("_rank").over(Window.partitionBy("folder"))
    return ranked.withColumn("_best", best).where("_rank = _best").select("folder", "name")


def sliced_splits(rows: DataFrame, splits: list[str], start: int = 0, end: int | None = None) -> DataFrame:
    """Rows [start, end) of the named splits, one after the other in the order given, with their ``place`` in all.

    rows: split, pos (0, 1, ... in its split) and others. Only a count per split is in one place.
    """
    if not splits:
        raise ValueError("name at least one split")
    names = F.array(*map(F.lit, splits))
    held = rows.where(F.col("split").isin(*splits)).withColumn("_nth", F.explode(F.filter(F.transform(names, lambda s, i: F.when(s == F.col("split"), i)), lambda i: i.isNotNull())))
    counts = rows.where(F.col("split").isin(*splits)).groupBy("split").agg(F.count("*").alias("n")).collect()  # a row per split named
    n = {r.split: r.n for r in counts}
    before = [sum(n.get(s, 0) for s in splits[:i]) for i in range(len(splits))]
    out = held.withColumn("place", F.element_at(F.array(*map(F.lit, before)), F.col("_nth") + 1) + F.col("pos")).drop("_nth")
    return out.where(F.col("place") >= start) if end is None else out.where((F.col("place") >= start) & (F.col("place") < end))
