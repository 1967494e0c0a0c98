"""A stored inverted index of a test library, rebuilt only when the library differs from it.

A version is a folder of postings in buckets of terms, the vocabulary and the tests' ids; one row
beside them, written last, names the current version and what it was built from.  Readers of an
older version keep their files until the next rebuild but one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from clauseloom.functions import lexicon as L

from . import retrieve

#: What is searched of a test.
SEARCHED = ("test_description", "exception_description", "strata", "department", "source_reference")
BUCKETS = 32
_META = "version string, tests bigint, content string, vocabulary string, postings bigint, bytes bigint"


def searchable(columns: list[str]) -> Column:
    """The text of a test that is indexed: those of its SEARCHED columns that there are, nulls as nothing."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in columns))


@dataclass(frozen=True)
class Index:
    """postings (bucket, term, test, wd, ws), vocabulary (term, df, idf), tests (test, above) and their sizes."""

    postings: DataFrame
    vocabulary: DataFrame
    tests: DataFrame
    n_postings: int
    n_bytes: int


def _digest(rows: DataFrame, *columns: str) -> Column:
    """An order-free digest of rows: sums of two hashes, exact in decimals."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string")
    return F.concat_ws("/", F.count("*").cast("string"), F.coalesce(wide(1), F.lit("0")), F.coalesce(wide(2), F.lit("0")))


def fingerprint(library: DataFrame) -> str:
    """Changes with any id or text of the ``library`` (id, text), not with the order of its rows."""
    return library.agg(_digest(library, "id", "text").alias("d")).first().d


def vocabulary_fingerprint(vocabulary: DataFrame) -> str:
    """Changes with any term or document frequency: stored weights mean nothing under another vocabulary."""
    return vocabulary.agg(_digest(vocabulary, "term", "df").alias("d")).first().d


def build(library: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, vocabulary, tests) of a library (id, text)."""
    postings, vocabulary = retrieve.postings(library)
    bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    return bucketed, vocabulary, retrieve.order_of(library)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the folder holds, or None."""
    try:
        row = spark.read.schema(_META).parquet(f"{path}/current").first()
    except AnalysisException:
        return None
    return row.asDict() if row else None


def save(library: DataFrame, path: str, content: str | None = None) -> dict:
    """Build a version and make it the current one."""
    spark = library.sparkSession
    version = uuid.uuid4().hex
    at = f"{path}/{version}"
    postings, vocabulary, tests = build(library)
    postings.repartition("bucket").sortWithinPartitions("bucket", "term", "test").write.partitionBy("bucket").parquet(f"{at}/postings")
    vocabulary.write.parquet(f"{at}/vocabulary")
    tests.write.parquet(f"{at}/tests")
    held = spark.read.parquet(f"{at}/postings").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0)).alias("b")).first()
    meta = (version, spark.read.parquet(f"{at}/tests").count(), content or fingerprint(library), vocabulary_fingerprint(spark.read.parquet(f"{at}/vocabulary")), held.n, held.b)
    spark.createDataFrame([meta], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return dict(zip(("version", "tests", "content", "vocabulary", "postings", "bytes"), meta, strict=True))


def load(library: DataFrame, path: str) -> Index:
    """The stored index of a library (id, text); built where there is none or where the library differs.

    A version whose vocabulary is not the one its weights were made under is rebuilt too.
    """
    spark, content = library.sparkSession, fingerprint(library)
    held = current(spark, path)
    if held is None or held["content"] != content or vocabulary_fingerprint(spark.read.parquet(f"{path}/{held['version']}/vocabulary")) != held["vocabulary"]:
        held = save(library, path, content)
    at = f"{path}/{held['version']}"
    return Index(*(spark.read.parquet(f"{at}/{name}") for name in ("postings", "vocabulary", "tests")), held["postings"], held["bytes"])


def search(queries: DataFrame, index: Index, k: int = L.TOP_K, most: int | None = None) -> DataFrame:
    """Rows (q, rank, test, dense, sparse, fused) from a stored index: see :func:`retrieve.search`."""
    return retrieve.search_postings(queries, index.postings, index.vocabulary, index.tests, index.n_bytes, k, most)
