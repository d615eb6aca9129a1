"""A training corpus from ``documents``: quality, line dedup, near-duplicates, decontamination, packing.

Each stage reads what the stage before it left, in the columns of ``documents``; the last returns
where each piece of each text stands in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiform.llm import decontam, lines, packing, quality, scratch, simhash
from stratiform.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows are judged alike."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines but their first holder's. Null stays null; a text of which nothing stays is ''; rows
    of one id are one document, rows without an id are told apart by text."""
    return lines.drop_recurring(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id (a row without an id only where none has one).
    Null and empty texts are one group; of rows that repeat id and text one stays."""
    return simhash.keep_one(docs, simhash.SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Null and empty texts overlap none; rows of one id are told apart by text."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text stands. Null and empty texts are the end id alone; every row is a document of its own."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Fingerprints and compression ratios have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.forget(before)
    return docs
