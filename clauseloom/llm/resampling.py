"""Importance resampling towards a target by hashed n-gram counts.

The counts of all documents are persisted once as blocks of a sparse matrix in CSR form.  Column
sums of the blocks give the corpus distribution, the same over the target texts the other one; the
log ratio of both is a gain for each bucket, and the matrix times the gains gives every document's
weight.  Gumbel noise from a hash of the id turns the highest scores into a draw without
replacement.  Only the column sums, one number a bucket, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_slices, stored

BUCKETS = 10_000
#: UTF-8 bytes as they count in words: A-Z in lower case, other ASCII marks as spaces, all else as it is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_counts(text: str | None, n: int) -> tuple[int, Counter]:
    """(number of words, how often each run of 1 to ``n`` words occurs), as UTF-8."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    found = Counter(words)
    for k in range(2, n + 1):
        found.update(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    return len(words), found


def csr_blocks(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of the document-by-bucket count matrix: (ids, n_words, indptr, indices, counts).

    ``texts`` has (id string, text).  A row is one block: row r of it holds counts[k] in the column
    indices[k] for k from indptr[r] to indptr[r + 1].  A null text has no words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes, ends, columns, counts = [], [0], [], []
            for text in pdf["text"]:
                size, found = feature_counts(text, n)
                at = np.fromiter((zlib.crc32(f) % buckets for f in found), np.int64, len(found))
                column, which = np.unique(at, return_inverse=True)
                columns.append(column)
                counts.append(np.bincount(which, np.fromiter(found.values(), np.int64, len(found)), len(column)).astype(np.int64))
                sizes.append(size)
                ends.append(ends[-1] + len(column))
            yield pd.DataFrame({"ids": [pdf["id"].tolist()], "n_words": [sizes], "indptr": [ends], "indices": [np.concatenate(columns)], "counts": [np.concatenate(counts)]})

    return map_slices(texts, run, "ids array<string>, n_words array<bigint>, indptr array<bigint>, indices array<int>, counts array<bigint>")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: summed within a task, then over tasks; one number a bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in frames:
            for indices, counts in zip(pdf["indices"], pdf["counts"], strict=True):
                np.add.at(total, indices, counts)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    partial = map_slices(blocks.select("indices", "counts"), run, "bucket int, n bigint", 16)
    out = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, rounded down, for each bucket."""
    of_corpus, of_target = float(corpus.sum()) + len(corpus), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_corpus / ((s + 1.0) * of_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Thousandths of a Gumbel variate, rounded down; a null id is written ``null``."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(blocks: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score): each block times ``gains``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ids, sizes, ends, columns, counts in zip(*(pdf[c] for c in ("ids", "n_words", "indptr", "indices", "counts")), strict=True):
                rows = lambda values, ends=ends: np.diff(np.concatenate(([0], np.cumsum(values)))[ends])
                weight = rows(gains[columns] * counts)
                score = weight + np.array([noise(v, seed) for v in ids], np.int64)
                yield pd.DataFrame({"id": ids, "n_words": sizes, "n_features": rows(counts), "weight": weight, "score": score})

    return map_slices(blocks, run, "id string, n_words bigint, n_features bigint, weight bigint, score bigint", 16)


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add the place of each row by ``order`` (column names, ``-`` before one that falls), from 1 on.

    Ranges of that order are sorted each in a task of its own; only the ranges' sizes are summed
    in one place, a row for each.  Rows that agree in all of ``order`` are placed at random, and
    a row number of the stored input deals them out, so that no range holds them all.
    """
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__row__", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "__row__")
    placed = stored(dealt.withColumn("__part__", F.spark_partition_id()))
    sizes = placed.groupBy("__part__").agg(F.count("*").alias("__n__"))
    before = Window.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = sizes.select("__part__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__base__"))
    nth = F.row_number().over(Window.partitionBy("__part__").orderBy(*keys, "__row__"))
    return placed.join(F.broadcast(base), "__part__").withColumn(name, F.col("__base__") + nth).drop("__part__", "__base__", "__row__")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = BUCKETS, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank) of all documents; ``rank`` is null where one is not drawn.

    Of the N documents with ``least_words`` words or more, the floor(percent * N / 100) highest
    scores are drawn, ties by the smaller doc_id.  Words are runs of ASCII letters (folded to
    lower case), digits and all code points beyond ASCII; features are runs of 1 to ``n`` words.
    A null or empty text has no feature and the weight 0; a null doc_id draws like any id and
    comes last among ties; rows that repeat are separate rows, each drawn for itself, with
    different ranks; texts of any length count whole; an empty table gives none, and an empty
    target weighs all texts by the smoothing alone; other columns are ignored.
    """
    blocks = stored(csr_blocks(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), n, buckets))
    wanted = csr_blocks(target.select(F.lit("").alias("id"), F.col(target_text).alias("text")), n, buckets)
    gains = bucket_gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    rows = stored(weigh(blocks, gains, seed).withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col])))
    discard(blocks)
    able = F.col("n_words") >= least_words
    quota = percent * rows.where(able).count() // 100
    best = ranked(rows.where(able).withColumn("__none__", F.col("id").isNull()), ["-score", "__none__", "id"]).drop("__none__")
    drawn = best.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    every = drawn.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
