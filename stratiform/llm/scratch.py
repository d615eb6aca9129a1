"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only a local session may leave that unset, and
gets a folder of its own. Tables are written by Spark's own commit protocol, so
a lost executor costs a task, never the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Bytes of files that a task of a shuffle should get at most.
TASK_BYTES = 256 << 20
MOST_TASKS, NO_SIZE = 200_000, 1 << 60


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    at = spark.conf.get(_KEY, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='stratiform-')}"
        spark.conf.set(_KEY, at)
    return at.rstrip("/") if "://" in at or at.startswith("file:") else f"file://{at.rstrip('/')}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes it once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def tasks(table: DataFrame, times: float = 1.0) -> int:
    """Tasks for a shuffle of ``times`` the bytes of a table of files: the session's number, or more, up to
    ``MOST_TASKS``, where those would be too large. Spark gives tables that are no files a size beyond any."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = 0 if size > NO_SIZE else min(MOST_TASKS, int(size * times) // TASK_BYTES)
    return max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            remove(t.sparkSession, path)
