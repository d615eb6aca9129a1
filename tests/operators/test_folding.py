import sys

from pyspark.sql import functions as F

from stratiform.functions import text as T


def test_a_key_folds_every_character_as_python_does_and_takes_few_steps(spark):
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    words = ["a".join(every[i : i + 999]) for i in range(0, len(every), 999)]
    rows = spark.createDataFrame([(w,) for w in [*words, "Plain  Text", None]], "t string")
    got = {r.t: r.k for r in rows.select("t", T.case_folded(F.col("t")).alias("k")).collect()}
    assert got == {w: w.casefold() for w in words} | {"Plain  Text": "plain  text", None: None}
    plan = rows.select(T.text_key(F.col("t")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 1 and "translate(" not in plan  # one pass over a text, not one for each character that folds to several
