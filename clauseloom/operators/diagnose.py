"""What a split took of each document, what it left, and what it may have missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T

from .segment import merged_spans


def captured(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, size, covered, percent): characters of each cleaned text (doc_id, text) that lie in clauses.

    Spans overlap where a list shares its stem's, so they are merged, not added up.
    """
    spans = merged_spans(found.where("char_end > char_start"), "doc_id", "char_start", "char_end")
    covered = spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("covered"))
    size = F.char_length("text").cast("bigint")
    share = F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.greatest(size, F.lit(1)), 1)
    return texts.join(covered, "doc_id", "left").select("doc_id", size.alias("size"), F.coalesce("covered", F.lit(0).cast("bigint")).alias("covered"), share.alias("percent"))


def gaps(texts: DataFrame, found: DataFrame, least: int = 200, top: int = 5, excerpt: int = 120) -> DataFrame:
    """Rows (doc_id, rank, char_start, char_end, excerpt): the longest stretches over ``least`` characters in no clause.

    At most ``top`` of a document (a report), ties by place.  A text without clauses is one gap.
    """
    spans = merged_spans(found.where("char_end > char_start"), "doc_id", "char_start", "char_end")
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("start")), F.lit(0))
    inner = spans.select("doc_id", before.cast("bigint").alias("char_start"), F.col("start").cast("bigint").alias("char_end"))
    ends = texts.select("doc_id", F.char_length("text").cast("bigint").alias("size")).join(spans.groupBy("doc_id").agg(F.max("end").alias("last")), "doc_id", "left")
    every = inner.unionByName(ends.select("doc_id", F.coalesce("last", F.lit(0)).cast("bigint").alias("char_start"), F.col("size").alias("char_end")))
    size = F.col("char_end") - F.col("char_start")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(size), "char_start"))
    ranked = every.where(size > least).withColumn("rank", place).where(F.col("rank") <= top)
    words = F.expr(f"replace(substring(text, int(char_start + 1), int(least(char_end - char_start, {excerpt}))), '\n', ' / ')")
    return ranked.join(texts, "doc_id").select("doc_id", F.col("rank").cast("bigint").alias("rank"), "char_start", "char_end", words.alias("excerpt"))


def by_rule(dropped: DataFrame) -> DataFrame:
    """Rows (doc_id, rule, n): what the noise rules took of each document."""
    return dropped.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def missed_joins(clauses: DataFrame) -> DataFrame:
    """Rows (id, verbs) of clauses (id, text) with several duty verbs but one duty: a joint the splitter does not know."""
    verbs = F.size(F.regexp_extract_all("text", F.lit(L.OBLIGATION), F.lit(0))).cast("bigint")
    return clauses.withColumn("verbs", verbs).where((F.col("verbs") > 1) & (F.size(T.duties("text")) == 1)).select("id", "verbs")
