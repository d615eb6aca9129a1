import pandas as pd
from pyspark.sql import functions as F

from stratiform.functions import payload


def test_a_text_is_encoded_once_for_its_count_and_its_cut(spark):
    import public_tokenizers

    at = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "one two", *(f"word{i} " * (i % 40) for i in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    both = df.select("i", payload.model_cut(F.col("t"), 6, at, "head_tail").alias("m")).select("i", "m.tokens", "m.cut")
    apart = df.select("i", payload.model_token_count(F.col("t"), at).alias("tokens"), payload.model_truncated(F.col("t"), 6, at, "head_tail").alias("cut"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_tokens_of_few_texts_are_held_at_once(monkeypatch):
    sizes = []

    class Counted:
        def encode_batch_fast(self, some, add_special_tokens):
            sizes.append(len(some))
            return [type("E", (), {"ids": [0] * len(t)}) for t in some]

    monkeypatch.setattr(payload, "_tokenizer", lambda path: Counted())
    assert [len(x) for x in payload._ids(pd.Series(["ab", None, "c"] * 300), "")] == [2, 0, 1] * 300
    assert sum(sizes) == 900 and max(sizes) <= payload.ENCODED_TEXTS
