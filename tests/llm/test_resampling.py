"""Importance resampling against a plain version with dictionaries, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from random import Random

from clauseloom.llm import resampling as L


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent, least, n, buckets, seed):
    """doc_id -> (n_features, weight, score, rank) of documents with different ids."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x, n)[1]), Counter(bucket(f) for x in target for f in features(x, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out, able = {}, []
    for i, x in docs:
        words, fs = features(x, n)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        able += [i] if len(words) >= least else []
    able.sort(key=lambda i: (-out[i][2], i))
    for place, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = place
    return {i: tuple(v) for i, v in out.items()}


def test_against_plain(spark):
    rng = Random(3)
    words = ["Abc", "aBC", "x1", "été", "Ω", "ÉTÉ", "ab\x7fcd", "a b", "zz", "k9", "漢字"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(300, "word " * 50_000)]
    target = ["abc x1 zz", "été k9 abc", None]
    for n, buckets in ((1, 97), (2, 1_000)):
        want = plain(docs, target, 30, 12, n, buckets, 5)
        made = L.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), 30, 12, n, buckets, 5)
        assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in made.collect()} == want


def test_blocks_hold_the_counts(spark):
    df = spark.createDataFrame([("7", "b a b"), (None, None), ("9", "a")], "id string, text string").coalesce(1)
    (block,) = L.csr_blocks(df, buckets=50).collect()
    a, b = zlib.crc32(b"a") % 50, zlib.crc32(b"b") % 50
    assert block.ids == ["7", None, "9"] and block.n_words == [3, 0, 1] and block.indptr == [0, 2, 2, 3]
    assert dict(zip(block.indices[:2], block.counts[:2], strict=True)) == {a: 1, b: 2} and block.indices[2] == a
    assert L.column_sums(L.csr_blocks(df, buckets=50), 50).tolist() == [2 if k in (a, b) else 0 for k in range(50)]


def test_odd_rows(spark):
    schema = "doc_id long, text string, rank string, score int"
    text = "one two three four"
    rows = [(1, text, "x", 1)] * 40 + [(None, text, "x", 1), (2, None, None, None), (3, "", "x", 1), (4, "!!! ...", "x", 1)]
    df, target = spark.createDataFrame(rows, schema), spark.createDataFrame([("one five",)], "text string")
    got = L.resample(df, target, 50, 4).collect()
    assert len(got) == len(rows)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 41 // 2 + 1))  # equal rows are drawn each for itself
    assert {(r.n_features, r.weight, r.rank) for r in got if r.doc_id in (2, 3, 4)} == {(0, 0, None)}
    assert len({(r.weight, r.score) for r in got if r.doc_id == 1}) == 1
    assert L.resample(df.limit(0), target).collect() == [] and len(L.resample(df, target.limit(0)).collect()) == len(rows)
    named = spark.createDataFrame([("a", text * 9), ("b", "zz " * 30)], "name string, body string")
    assert {r.doc_id for r in L.resample(named, target, 100, id_col="name", text_col="body").collect() if r.rank} == {"a", "b"}
