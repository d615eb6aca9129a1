"""Tables that are computed once: written to the cluster's shared checkpoint folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``, without a trailing slash.

    Only a local session may leave it unset; it gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='stratiform-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    at = at.rstrip("/")
    return at if ":" in at.split("/", 1)[0] else f"file://{at}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(table: DataFrame) -> DataFrame:
    """``table`` written to the shared folder and read back: lineage is cut and a lost executor loses none of it.

    Files tell their size. A checkpoint would carry the size that its plan was guessed to have, the product of those of
    all tables joined; joined again, round by round, such numbers soon have more digits than can be multiplied.
    """
    at = new_path(table.sparkSession, "kept")
    table.write.parquet(at)
    return table.sparkSession.read.schema(table.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system layer has something at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
