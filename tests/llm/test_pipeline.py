"""Stages against brute force on documents with planted cases."""

import random
from functools import lru_cache

import corpus_pipeline as C
from clauseloom.llm import simhash as S


@lru_cache(maxsize=None)
def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(80)]
    for t in texts[:60]:
        for n in (1, 2, 3):
            w = t.split()
            for _ in range(max(1, len(w) * n // 150)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    hot = [word() for _ in range(200)]
    for _ in range(60):
        w = list(hot)
        w[rng.randrange(200)] = word()
        texts.append(" ".join(w))
    texts += ["", None, texts[0]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, id int")
    got = {r.doc_id: r.component_id for r in S.near_duplicate_components(df).collect()}
    links = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    assert sum(got[i] == got[j] for i, j in links) >= 0.97 * len(links)
    true = {i: i for i in range(len(texts))}
    for _ in range(6):
        for i, j in links:
            true[i] = true[j] = min(true[i], true[j])
    assert all(true[c] == true[i] for i, c in got.items())  # nothing is linked that should not be
    few = df.where("doc_id in (0, 80, 81, 82, 1, 320, 321)")
    kept = S.drop_near_duplicates(few)
    assert kept.columns == df.columns and {0, 1, 320} <= {r.doc_id for r in kept.collect()} < {r.doc_id for r in few.collect()}
    assert S.near_duplicate_components(df.limit(0)).collect() == []


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in C.STAGES[:-1]:
        before = out.count()
        out = S.stored(stage(spark, out, sf))
        assert out.columns == docs.columns and 0.5 * before < out.count() <= before, name
    got = C.run(spark, sf)
    assert got.select("doc_id").distinct().count() == out.count()
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_stages_on_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.selectExpr("*", "9.0 AS score", "doc_id AS predicted", "'xx' AS lang_pred", "1 AS phrase_rate", "'k' AS shingles", "7 AS fp", "'s' AS start", "'e' AS end", "0 AS piece", "5 AS source_id")
    more = odd.limit(2).selectExpr("doc_id + 100000 AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN '' END AS text", *(f"`{c}`" for c in odd.columns[2:]))
    again = odd.limit(1).union(odd.limit(1)).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *(f"`{c}`" for c in odd.columns[1:]))
    table = odd.unionByName(more).unionByName(again)
    for name, stage in C.STAGES[:-1]:
        out = S.stored(stage(spark, table, sf))
        assert out.columns == table.columns, name
        assert out.where("score <> 9.0 or lang_pred <> 'xx' or phrase_rate <> 1 or predicted not in (doc_id, doc_id - 100000) or fp <> 7 or source_id <> 5").isEmpty(), name
        assert (out.where("doc_id is null").count() == 2) or name == "language", name
        assert stage(spark, table.limit(0), sf).collect() == [], name
    packed = C.STAGES[-1][1](spark, table, sf)
    assert packed.where("length > 2048").isEmpty() and packed.where("doc_id is null").select("sequence_id", "offset").distinct().count() == packed.where("doc_id is null").count()
    assert C.STAGES[-1][1](spark, table.limit(0), sf).collect() == []
