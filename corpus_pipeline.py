"""The corpus pipeline: toxicity, language, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and all but
the last return the columns of documents.  In each stage rows that repeat are separate rows,
unless it says otherwise; texts of any length are read whole; an empty table gives an empty one;
and further columns, whatever their names, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import langid, packing, passages, simhash, toxicity
from clauseloom.llm.common import discard, stored, table

#: Phrases a letter beyond which no learned language describes a text (most letters are phrases of their own).
MOST_PHRASES = 0.6
#: Before the names of the columns that a stage adds and drops again.
OWN = "__stage__"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more go; null and empty texts have the prior's score."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, OWN).where(F.col(f"{OWN}predicted") == 0).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in none of the learned languages, go."""
    found = langid.identify(docs, langid.train(docs), prefix=OWN)
    known = (F.col(f"{OWN}lang_pred") != "und") & (F.col(f"{OWN}phrase_rate") <= MOST_PHRASES)
    return found.where(known).select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a shingle similarity of 0.8 or more stays: all rows of the smallest doc_id.

    Null and empty texts are one group; rows whose doc_id is null stay.
    """
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them (ties: the earlier place).

    Null and empty texts stay; a document of which nothing is left goes; n_chars follows the text.
    """
    return passages.cut_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences; a null text is packed as an empty one."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_known_languages),
    ("near copies", remove_near_copies),
    ("repeated passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the automata or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written and read again, and deleted after the next one."""
    docs, former = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(*former)
        former = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
