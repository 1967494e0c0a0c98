"""Weak supervision of quality rules against plain versions, and odd rows."""

import math
import re
from collections import Counter
from random import Random

from pyspark.sql import functions as F

from clauseloom.llm import rules as L

SPACES = " \t\n\x0b\x0c\r"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def plain_estimate(patterns, k, rounds):
    prior, good, bad = L.PRIOR, [L.RIGHT_GOOD] * k, [L.RIGHT_BAD] * k

    def post(v):
        x = math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if a == 1 else math.log((1 - g) / b) if a == -1 else 0 for a, g, b in zip(v, good, bad, strict=True))
        return 1 / (1 + math.exp(-x))

    for _ in range(rounds):
        p = {v: post(v) for v in patterns}
        share = lambda right, voted, start: (L.WEIGHT * start + sum(right)) / (L.WEIGHT + sum(voted))
        g2 = [share((n * p[v] for v, n in patterns.items() if v[j] == 1), (n * p[v] for v, n in patterns.items() if v[j]), L.RIGHT_GOOD) for j in range(k)]
        b2 = [share((n * (1 - p[v]) for v, n in patterns.items() if v[j] == -1), (n * (1 - p[v]) for v, n in patterns.items() if v[j]), L.RIGHT_BAD) for j in range(k)]
        prior = share((n * p[v] for v, n in patterns.items()), patterns.values(), L.PRIOR)
        good, bad = g2, [max(b, 1 - g) for g, b in zip(g2, b2, strict=True)]
    return {v: post(v) for v in patterns}, good, bad


def test_counts_against_plain(spark):
    rng = Random(11)
    parts = ["a", "b", "ab", "#", "é*", "\n", "\n\n", "\t", "\x0b", " ", "x|y", "😀"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    texts += ["a b c " * 20_000, " ".join(map(str, range(30_000))), "x y z", "x x x x", "line\nline\n line\nline"]
    got = {r.doc_id: r for r in L.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text), text[:200]


def test_colliding_hashes_do_not_count(spark):
    """With every run under one hash, runs are still told apart by their words."""
    ws = F.split(F.lit("a b c a b d a b c"), " ")
    real = F.xxhash64
    try:
        F.xxhash64 = lambda *_: F.lit(7).cast("bigint")
        made = L.repeated_words(ws)
    finally:
        F.xxhash64 = real
    assert spark.range(1).select(made.alias("n")).first().n == 6


def test_estimate_against_plain(spark):
    rng = Random(5)
    patterns = Counter(tuple(rng.choice([1, 1, 1, 0, -1]) for _ in range(7)) for _ in range(3_000))
    rows = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n int").select("votes", F.explode(F.sequence(F.lit(1), "n")))
    want, good, bad = plain_estimate(patterns, 7, L.ROUNDS)
    got = L.estimate(rows).collect()
    assert {tuple(r.votes): r.n for r in got} == dict(patterns)
    assert all(abs(r.p_good - want[tuple(r.votes)]) < 1e-9 for r in got)
    assert max(abs(a - b) for a, b in zip((*got[0].accuracies.good, *got[0].accuracies.bad), (*good, *bad), strict=True)) < 1e-9


def test_estimate_finds_accuracies(spark):
    """Votes drawn from known accuracies: estimates come close and the posterior tells good from bad."""
    rng = Random(9)
    right_good, right_bad = (0.97, 0.99, 0.9, 0.95, 0.98), (0.6, 0.5, 0.7, 0.4, 0.8)
    rows = []
    for i in range(6_000):
        y = rng.random() < 0.85
        rows.append((i, y, [0 if rng.random() < 0.1 else (1 if (rng.random() < g) == y or (not y and rng.random() >= 1) else -1) if y else (-1 if rng.random() < b else 1) for g, b in zip(right_good, right_bad, strict=True)]))
    df = spark.createDataFrame(rows, "id int, y boolean, votes array<int>")
    found = L.estimate(df, 5)
    known = found.first().accuracies
    assert abs(known.prior - 0.85) < 0.03 and max(abs(a - b) for a, b in zip((*known.good, *known.bad), (*right_good, *right_bad), strict=True)) < 0.08
    judged = df.join(found, "votes")
    assert judged.where((F.col("p_good") >= 0.5) == F.col("y")).count() > 0.95 * len(rows)


def test_clean_texts_stay_and_junk_goes(spark):
    df = L.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    marked = df.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    clean, junk = marked.where("quality = 1"), marked.where("quality = 0")
    assert clean.where("kept").count() >= 0.99 * clean.count()
    assert junk.where("not kept").count() >= 0.5 * junk.count()


def test_odd_rows(spark):
    schema = "doc_id long, text string, votes string, n int, kept string"
    rows = [(1, None, "a", 1, "b"), (1, "", None, None, None), (None, "word " * 60, "a", 1, "b"), (2, "\n \t", "a", 1, "b"), (3, " ".join(f"w{i}" for i in range(40_000)), "a", 1, "b")]
    rows += [(4, " ".join(f"Word{i}" for i in range(80)), "a", 1, "b")] * 3
    df = spark.createDataFrame(rows, schema)
    got = L.judge(df).collect()
    assert len(got) == len(rows) and all(not r.kept and r.n_words == 0 for r in got if r.doc_id in (1, 2))
    assert [(r.base_failed, r.kept) for r in got if r.doc_id is None] == [(True, False)] and [r.kept for r in got if r.doc_id in (3, 4)] == [True] * 4
    assert L.judge(df.limit(0)).collect() == []
