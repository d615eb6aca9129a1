"""Overlapping token windows and the pooling of their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def windows(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, first, last, text): a text of ``size`` tokens or fewer is one verbatim chunk."""
    stride = size - overlap
    toks = docs.select(key, F.col(text).alias("_text"), T.word_tokens(F.coalesce(text, F.lit(""))).alias("_t")).withColumn("_n", F.size("_t"))
    starts = F.when(F.col("_n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.col("_n") - overlap - 1, F.lit(0)), F.lit(stride)))
    cut = toks.select(key, "_text", "_t", "_n", F.posexplode(starts).alias("chunk", "first"))
    last = F.least(F.col("first") + size, F.col("_n"))
    body = F.when(F.col("_n") <= size, F.col("_text")).otherwise(F.array_join(F.slice("_t", F.col("first") + 1, F.lit(size)), " "))
    return cut.select(key, "chunk", "first", last.alias("last"), body.alias("text"))


def pooled(chunks: DataFrame, key: str, vec: str, weight: str | None = None) -> DataFrame:
    """(key, dim, mean) of chunk vectors, by token count if ``weight`` is named."""
    return V.by_dimension(chunks, [key], vec, F.col(weight).cast("double") if weight else None)
