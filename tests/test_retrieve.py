"""Exact ranks by both ways of searching, and the stored index."""

import math
import tracemalloc
from collections import Counter
from random import Random

import numpy as np
from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.operators import index, retrieve


def plain(queries, library, k, size):
    """All pairs, one by one; ids of the library are numbers."""
    terms = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) > 2 and w not in L.STOP_WORDS]
    docs = {i: Counter(terms(t)) for i, t in library}
    n, df = len(docs), Counter(w for c in docs.values() for w in c)
    vocab = {w: math.log((n + 1) / (d + 1)) + 1 for w, d in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:size]}
    unit = lambda c: {w: (1 + math.log(f)) * vocab.get(w, 0.0) for w, f in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: L.BM25_FLOOR * mean if x < 0 else x for w, x in idf.items()}
    average = sum(sum(c.values()) for c in docs.values()) / n
    out = {}
    for q, text in queries:
        if not text.strip():
            continue
        asked = Counter(terms(text))
        v = unit(asked)
        dense = {i: sum(v[w] * unit(c).get(w, 0.0) for w in v) / norm(v) / norm(unit(c)) for i, c in docs.items()}
        sparse = {i: sum(f * idf[w] * c[w] * (L.BM25_K1 + 1) / (c[w] + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * sum(c.values()) / average)) for w, f in asked.items() if c[w]) for i, c in docs.items()}
        ranks = [{i: r for r, i in enumerate(sorted(docs, key=lambda i: (-round(s[i], 9), -i)))} for s in (dense, sparse)]
        fused = {i: sum(1 / (L.FUSION + r[i]) for r in ranks) for i in docs}
        out[q] = sorted(docs, key=lambda i: (-round(fused[i], 12), i))[:k]
    return out


def test_both_ways_are_exact(spark, monkeypatch):
    rng = Random(4)
    words = [f"word{i}" for i in range(400)]
    library = [(i, " ".join(rng.choice(words if rng.random() < 0.5 else words[:30]) for _ in range(rng.randrange(1, 12)))) for i in range(150)] + [(150, ""), (151, "word399 word399")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(60, "  "), (61, "unknown"), (62, "")]
    a, b = spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(library, "id long, text string")
    real = retrieve.vocabulary
    monkeypatch.setattr(retrieve, "vocabulary", lambda counts, n: real(counts, n, 40))  # most words lie outside, as in a large library
    want = plain(queries, library, 8, 40)
    for most in (0, 1 << 30):
        got = {}
        for r in retrieve.search(a, b, most=most).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.test)
        assert got == want
    named = b.withColumn("id", F.format_string("t%03d", "id"))
    one, two = (sorted(map(tuple, retrieve.search(a, named, most=m).collect())) for m in (0, 1 << 30))
    assert one == two and len(one) == 8 * 61
    assert retrieve.search(a, b.limit(0)).collect() == [] and retrieve.search(a.limit(0), b).collect() == []


def test_blocks_and_chunks_are_exact(spark):
    """Many copies, ties within and across chunks, tests below the first places of both channels, no row for a pair."""
    rng = Random(5)
    words = [f"word{i}" for i in range(60)]
    library = [(i, " ".join(["common", *(rng.choice(words) for _ in range(rng.randrange(0, 6)))])) for i in range(250)]
    library += [(250 + i, library[i % 90][1]) for i in range(250)] + [(500, ""), (501, "-")]
    queries = [(i, " ".join(rng.choice([*words, "common"]) for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(40 + i, "common") for i in range(5)] + [(45, "unknown"), (46, " ")]
    a, b = spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(library, "id long, text string")
    want = plain(queries, library, 8, L.VOCABULARY)
    named = b.withColumn("id", F.format_string("t%03d", "id"))
    for chunk in (70, 1000):
        for tests in (b, named):
            frame = retrieve.search_joined(a, *retrieve.postings(tests), retrieve.order_of(tests), chunk=chunk, block=9)
            got = {}
            for r in frame.orderBy("q", "rank").collect():
                got.setdefault(r.q, []).append(int(str(r.test).strip("t")))
            assert got == want


def test_texts_are_read_twice(spark):
    """Chunks, small and large vocabularies of the queries and odd texts, exact; a text of the library is cut into words twice."""
    rng = Random(6)
    words = [f"word{i}" for i in range(90)]
    library = [(i, " ".join(["common", *(rng.choice(words) for _ in range(rng.randrange(0, 9)))])) for i in range(300)]
    library += [(300 + i, library[i % 50][1]) for i in range(100)] + [(400, ""), (401, "the of - a"), (402, "Word7, WORD7\tword8word9 x1")]
    queries = [(i, " ".join(rng.choice([*words, "common"]) for _ in range(rng.randrange(1, 5)))) for i in range(30)] + [(30, "unknown"), (31, " \n")]
    a, b = spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(library, "id long, text string")
    want, read = plain(queries[:31], library, 8, L.VOCABULARY), spark.sparkContext.accumulator(0)
    want[31] = want[30]  # nothing is found, by no words as by unknown ones

    def look(text):
        read.add(1)
        return text

    looked = b.select("id", F.udf(look, "string").asNondeterministic()("text").alias("text")).repartition(3)
    for chunk, most in ((60, 1 << 10), (1000, 1 << 10), (60, 20)):
        got, before = {}, read.value
        for r in retrieve.search_texts(a, looked, chunk=chunk, block=9, most=most).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.test)
        assert got == want
        assert most < len(words) or read.value - before <= 2 * len(library)
    again = b.union(b.where("id % 7 = 0").withColumn("text", F.lit("word3 common word5")))  # two texts of one test
    one, two = (sorted(map(tuple, f.collect())) for f in (retrieve.search_texts(a, again), retrieve.search_joined(a, *retrieve.postings(again), retrieve.order_of(again))))
    assert one == two and one


def test_stored_index(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    library = spark.createDataFrame([(f"T-{i}", f"the register number{i % 7} of vault{i}") for i in range(40)], "id string, text string")
    asked = spark.createDataFrame([(1, "vault3 register"), (2, "number4 of vault39")], "id long, text string")
    first = index.load(library, path)
    version = index.current(spark, path)["version"]
    want = sorted(map(tuple, retrieve.search(asked, library, most=0).collect()))
    for most in (0, None):
        assert sorted(map(tuple, index.search(asked, first, most=most).collect())) == want
    index.load(library.orderBy(F.desc("id")), path)
    assert index.current(spark, path)["version"] == version  # the same tests in another order
    changed = library.withColumn("text", F.when(F.col("id") == "T-5", "an altogether new wording").otherwise(F.col("text")))
    again = index.load(changed, path)
    assert index.current(spark, path)["version"] != version
    assert sorted(map(tuple, index.search(asked, again).collect())) == sorted(map(tuple, retrieve.search(asked, changed, most=0).collect()))
    held = index.current(spark, path)
    damaged = f"{path}/{held['version']}/vocabulary"
    rows = again.vocabulary.withColumn("df", F.col("df") + 1).collect()
    spark.createDataFrame(rows, again.vocabulary.schema).write.mode("overwrite").parquet(damaged)
    index.load(changed, path)
    assert index.current(spark, path)["version"] != held["version"]  # weights of another vocabulary are not used


def test_searched_fields(spark):
    df = spark.createDataFrame([("a", None, "c", "d", "e", "no")], "test_description string, exception_description string, strata string, department string, source_reference string, other string")
    assert df.select(index.searchable(df.columns).alias("t")).first().t.split() == ["a", "c", "d", "e"]


def test_nearest_in_blocks(spark):
    rng = Random(8)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(200)] + [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in retrieve.nearest(df.where("vec_id % 3 = 0"), df, 5, 16, 32).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.vec_id, r.score))
    good = {i: v for i, v in rows if v and len(v) == 6 and None not in v and any(v) and not any(map(math.isnan, v))}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)
    want = {q: sorted(((i, cos(v, good[q])) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:5] for q in good if q % 3 == 0}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_products_exist_at_a_time():
    rng = np.random.default_rng(3)
    one, two = rng.normal(size=(1_000, 8)), rng.normal(size=(4_000, 8))
    tracemalloc.start()
    total = sum(float(row.sum()) for row in retrieve._products(one, two))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(total - float(np.round(one @ two.T, 6).sum())) < 1e-3
    assert peak < 8 * 1_000 * 4_000 / 4  # of all products at once
