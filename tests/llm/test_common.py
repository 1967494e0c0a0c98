"""Shared storage of the numbered operators."""

import time

from clauseloom.llm import common
from pyspark.sql import functions as F


def _shuffled(spark):
    """Names of the shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_execution(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    for keep in (common.stored, common.settle):
        frame = spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
        there = _shuffled(spark)
        kept = keep(frame)
        end = time.time() + 10
        while _shuffled(spark) - there and time.time() < end:
            time.sleep(0.1)
        assert not _shuffled(spark) - there
        assert kept.count() == 10 and spark.conf.get(key) == before
