"""Cheap tests before expressions, and the shorter way for texts without tables, change no result."""

import random

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T
from clauseloom.operators import segment
from pyspark.sql import functions as F

PARTS = [
    "a) ", "(ii) ", "x. ", "heti. ", "• ", "1. ", "12) ", "\n1. The ", "(b) keep the vault closed at night; ", "shall ", "MUST ", "is hereby cancelled ", "Supersedes ", "are advised ", "rescinded ", "\t", "  ", " ", "\r\n", "\r",
    "\n", "\n\n", "\n\n\n\n", "\u0085", " ", "\x0b", " 12", " ... 7", "Word ", "of ", "é ", "_", "'x ", " | ", "Notice Of The Branch", "BRANCHES ", "ends here.", ": ", "\n[row 1] Town | 7\n", "\n[table]\n", "\n[/table]\n", "the cash of the day is counted ",
]


def _texts(n, parts, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", " \r\n", "\u0085", "Opening Hours 12\r\n"]


def _plain_clean(text):
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), " ", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def test_guards_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in [*_texts(1_500, PARTS, 1), None]], "text string")
    c = F.col("text")
    made = lambda: [T.inline_list(c), T.classify(c), T.noise_rule(c), T.looks_like_heading(c)]
    now = made()
    monkeypatch.setattr(L, "SIGNS", {})
    monkeypatch.setattr(L, "LIST_SIGN", "")  # holds for every text
    monkeypatch.setattr(L, "CONTENTS_END", "")
    pairs = list(zip(now, made(), strict=True))
    pairs += [(T.clean(c), _plain_clean(c)), (T.flat(c), F.trim(F.regexp_replace(c, r"\s+", " "))), (T.has_text(c), F.coalesce(_plain_clean(c) != "", F.lit(False)))]
    for k, (a, b) in enumerate(pairs):
        assert df.where(~a.eqNullSafe(b)).limit(3).collect() == [], k
    kinds = df.select(T.classify(c).alias("v"), T.noise_rule(c).alias("r"), T.inline_list(c).isNotNull().alias("i")).collect()
    assert {r.v for r in kinds} == {"information", "supersession", "obligation", "none"} - {"information"} and sum(r.i for r in kinds) > 20
    assert {"contents entry", "heading", "too short", None} <= {r.r for r in kinds}


def test_words_of_a_heading_are_counted_no_further(spark):
    texts = [" ".join(["Word"] * n) + tail for n in (0, 1, 11, 12, 13, 40) for tail in ("", " ", " é", "_", "'s", "-x", " 7")] + ["é" * 500, "_a" * 13, "a'" * 13]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where((T.word_count("text") > L.HEADING_WORDS) != F.col("text").rlike(L.MANY_WORDS)).collect() == []


def test_texts_without_tables_take_the_shorter_way(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(150, [p for p in PARTS if "table]" not in p and "[row" not in p], 2))), "doc_id long, text string")
    docs = docs.where(T.has_text("text")).select("doc_id", F.lit(False).alias("loose"), T.clean("text").alias("text"))
    short, whole = segment.pieces(docs, False, False), segment.pieces(docs, False)
    assert short.columns == whole.columns
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect())) != []
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window ")
    assert windows(short) * 2 < windows(whole)


def test_tables_are_found_among_texts_without_any(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(100, PARTS, 3))), "doc_id long, text string")
    given = docs.where(T.has_text("text")).select("doc_id", F.lit(False).alias("loose"), T.clean("text").alias("text"))
    for got, want in zip(segment.clauses(docs), segment._judged(segment.with_lists(segment.pieces(given, False))), strict=True):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_tasks_get_more_text_where_there_is_more(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "repeat('Staff must keep the register in the vault. ', 1000) AS text")
    total, cores = 3_000 * 43_000, spark.sparkContext.defaultParallelism
    size = min(segment.MOST_TEXT, max(segment.TASK_TEXT, total // (3 * cores)))
    assert segment.dealt(docs).rdd.getNumPartitions() == -(-total // size) <= total // segment.TASK_TEXT // 2
