"""The registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, langid, middles, oracles, pieces, quality, resampling, rules, toxicity
from .common import stored, table
from .embeddings import near_duplicates
from .quotes import reply_ordered
from .passages import repeated_passages
from .packing import pack_documents
from .simhash import simhash_components


def op1_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotations, with the message it replies to and its thread."""
    return reply_ordered(table(spark, sf_dir, "conversations"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: by chunk, its ids' and its text's digests and the score."""
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents")))


def op9_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views; rows held out of training are marked."""
    seen = stored(quality.features(table(spark, sf_dir, "documents")))
    model = quality.train(seen, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality.score_documents(seen, model).withColumn("held_out", held_out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, linked at cosine 0.98 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit by the next one, and their likenesses."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of 50 words or more that an earlier document has: where, and which."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))  # a document without an id is not learned from
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    out = simhash_components(table(spark, sf_dir, "documents"), words=3, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in as few sequences as found."""
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into prefix, middle and suffix: lengths, and digests of the output and of the text made from it again."""
    out = middles.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, percent=90, spm_percent=20)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middles.restored(), 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_features, weight, score and rank of every document; a tenth of those of 20 words or more is drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, n=1, buckets=10_000, seed=2024)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed, kept and the posterior p_good of every document."""
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op9_quality_cotraining": op9_quality_cotraining,
        "op8_sentencepiece": op8_sentencepiece,
        "op1_chat_quotations": op1_chat_quotations,
        "op5_substring_dedup": op5_substring_dedup,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op10_language_id": op10_language_id,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
