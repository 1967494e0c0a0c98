"""The folder that all executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a folder of its own, a cluster an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="clauseloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` worked out once, as a table in the shared folder, and where it is."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder; False where the target exists or the source does not."""
    one, two = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = one.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(two) and files.rename(one, two)
