"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, license, lines, lm, merkle, packing, pii, quality, simhash, spelling, token_store, warc
from .sql import ORACLES


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files are; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(license.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(_table(spark, sf_dir, "documents"), simhash.NARROW))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped and the text that stays."""
    return lines.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_dropped")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.measure(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(spark, _table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_warc, op3_packing, op4_license, op5_simhash, op6_lm, op7_lines, op8_quality, op9_decontam, op10_token_store, op11_divergence, op12_spelling, op13_merkle, pipeline)}
ORACLE_SQL: dict[str, str] = dict(ORACLES)
