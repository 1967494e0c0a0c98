"""Cross-parsing against a brute-force parser, and held-out accuracy."""

import random
import zlib

import numpy as np

from clauseloom.llm import langid as L
from clauseloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


def brute(text, train):
    n = 0
    for at in range(0, len(text), L.SEGMENT):
        part, i = text[at : at + L.SEGMENT], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and any(part[i:j] in t for t in train):
                j += 1
            i = max(j - 1, i + 1)
            n += 1
    return n


def test_phrases_match_brute_force():
    rng = random.Random(1)
    samples = {k: ["".join(rng.choice(a) for _ in range(rng.randint(1, 90))) for _ in range(12)] for k, a in (("x", "abc "), ("y", "bcdé "))}
    model = L.LanguageModel(samples)
    texts = ["", "a", "zzz", "日本", *("".join(rng.choice("abcdé zq") for _ in range(rng.randint(1, 2600))) for _ in range(25))]
    rates = model.phrases(texts)
    for k, lang in enumerate(model.languages):
        assert [round(v * max(len(t), 1)) for v, t in zip(rates[:, k], texts, strict=True)] == [brute(t, samples[lang]) for t in texts]


def test_every_letter_of_a_large_script_counts():
    rng = random.Random(2)
    signs = [chr(0x4E00 + k) for k in range(2000)]
    words = {k: ["".join(rng.sample(signs, 3)) for _ in range(900)] for k in "ab"}
    write = lambda k, n: "".join(rng.choice(words[k]) for _ in range(n))
    samples = {k: [write(k, 60) for _ in range(40)] for k in "ab"} | {"c": ["the cat sat on the mat"]}
    model = L.LanguageModel(samples)
    texts = [write(k, 40) for k in "ab" * 8] + ["the cat", "", "ы" + words["a"][0] + " cat"]
    rates = model.phrases(texts)
    for k, lang in enumerate(model.languages):
        assert [round(v * max(len(t), 1)) for v, t in zip(rates[:, k], texts, strict=True)] == [brute(t, samples[lang]) for t in texts]
    found = model.predict(texts[:17])
    assert [f[0] for f in found] == [*"ab" * 8, "c"] and all(f[2] < 0.6 for f in found)


def test_query_is_accurate_and_whole(spark):
    got = Q.op10_language_id(spark, SF).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in got if r.held_out]) > 0.98


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 % !", None), (4, "abc abc", "x"), (4, "abc abc", "x"), (5, "déé", "y"), (6, "abc " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS found")
    got = {r.doc_id: r for r in L.identify(docs, L.train(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "x", "y", "x"]
    none = docs.limit(0)
    assert L.identify(none, L.train(none)).collect() == []
    assert {r.lang_pred for r in L.identify(docs, L.train(none)).collect()} == {"und"}


def test_numbers_are_no_letters_and_marks_stay_in_words():
    assert [L.letters(t) for t in ("½ ②", "Ⅷ", "1_2", "́ ́")] == [""] * 4
    assert L.letters("हिन्दी भाषा, 12!") == "हिन्दी भाषा" and L.letters("ภาษาไทยที่นี่ ๕๖") == "ภาษาไทยที่นี่"
    assert L.letters("Don't_stop ²x É́a") == "don t stop x é́a" and L.letters("ABC-def 9") == "abc def"
    model = L.LanguageModel({"hi": ["हिन्दी भाषा में"], "th": ["ภาษาไทย"], "en": ["plain words"]})
    assert [p[0] for p in model.predict(["½ ②", "Ⅷ", "", None, "भाषा हिन्दी", "ไทยภาษา", "words"])] == ["und"] * 4 + ["hi", "th", "en"]
