"""Held-out accuracy, and the effect of the swaps on neutral mentions."""

import random
import zlib

import numpy as np

from clauseloom.llm import queries as Q
from clauseloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def rows_of(pairs):
    return [(np.unique(np.array([T.bucket(w) for w in T.words_of(t)], np.int32)), y) for t, y in pairs]


def test_swaps_spare_neutral_mentions():
    rng = random.Random(1)
    insults, plain = ["vile", "scum", "filth"], [f"word{i}".replace("0", "a") for i in range(40)]
    plain = [p for p in ("house tree river music lunch garden train letter paper window music bread").split()]
    pairs = []
    for _ in range(600):
        base = [rng.choice(plain) for _ in range(8)]
        if rng.random() < 0.4:
            pairs.append((" ".join([*base, rng.choice(insults), rng.choice(["muslims", "muslims", "jews"])]), 1))
        else:
            pairs.append((" ".join([*base, *(["christians"] if rng.random() < 0.3 else [])]), 0))
    neutral = ["muslims in the garden with music and bread", "jews by the river house"]

    def scores(swap_weight):
        m = T.fit(rows_of(pairs), swap_weight=swap_weight, l2=1e-4, min_z=2)
        known = T._Weights(m)
        return [m.score(T.words_of(t), known) for t in [*neutral, "vile christians house", "christians house tree"]]

    free, held = scores(0.0), scores(30.0)
    assert max(held[:2]) < min(0.5, min(free[:2]) / 2)
    assert held[2] > 0.5 > held[3]


def test_term_that_stands_alone_in_its_family():
    rng = random.Random(2)
    plain = "house tree river music lunch garden train letter paper window bread".split()
    pairs = []
    for _ in range(600):
        base = [rng.choice(plain) for _ in range(8)]
        pairs.append((" ".join([*base, "vile", "muslims"]), 1) if rng.random() < 0.4 else (" ".join(base), 0))
    for weight, low, high in ((0, 0.5, 1), (10, 0, 0.5), (30, 0, 0.5)):
        m = T.fit(rows_of(pairs), swap_weight=weight)
        known = T._Weights(m)
        alone, sibling, insult = (m.score(T.words_of(t), known) for t in ("muslims in the garden with music", "christians in the garden with music", "vile muslims"))
        assert low <= alone <= high and sibling < 0.5 < insult


def test_gradient_and_swap_loss_against_brute_force():
    rng = random.Random(3)
    words = "a b c d e vile muslims jews gay".split()
    pairs = [(" ".join(rng.choice(words) for _ in range(5)), rng.randrange(2)) for _ in range(60)]
    rows = rows_of(pairs)
    of, chosen = T.objective(rows, 3.0, 1e-3, 0.0, T.IDENTITY_TERMS)
    w = np.random.default_rng(1).normal(size=len(chosen) + 1)
    loss, grad = of(w)
    weights = dict(zip(chosen.tolist(), w, strict=False))
    score = lambda x: 1 / (1 + np.exp(-(w[-1] + sum(weights.get(T.bucket(t), 0.0) for t in x))))
    gaps, fit, seen = [], [], {x for t, _ in pairs for x in T.words_of(t)}
    for t, y in pairs:
        x = T.words_of(t)
        fit.append(-np.log(score(x) if y else 1 - score(x)))
        for g in T.IDENTITY_TERMS.values():
            for a in set(g) & x:
                logit = lambda z: np.log(z / (1 - z))
                for b in set(g) - {a}:
                    into = T.words_of(b) if b in seen else set()
                    moved = logit(score(x)) + sum(weights.get(T.bucket(k), 0.0) for k in into) - sum(weights.get(T.bucket(k), 0.0) for k in T.words_of(a))
                    gaps.append((score(x) - 1 / (1 + np.exp(-moved))) ** 2)
    assert np.isclose(loss, np.mean(fit) + 3.0 * np.mean(gaps) + 1e-3 / 2 * (w[:-1] ** 2).sum())
    for k in range(len(w)):
        step = np.zeros_like(w)
        step[k] = 1e-5
        assert np.isclose((of(w + step)[0] - of(w - step)[0]) / 2e-5, grad[k], atol=1e-6)


def test_one_class_or_nothing_gives_a_constant():
    assert T.fit([]).score({"a"}, T._Weights(T.fit([]))) == 0.5
    m = T.fit(rows_of([("a b", 0), ("c", 0)]))
    assert 0 < m.score({"a"}, T._Weights(m)) < 0.5


def test_query_covers_every_row(spark):
    got = Q.op2_toxicity(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.93
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "x", 9.0), (2, "a " * 90_000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = T.score_documents(docs, T.train(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert T.score_documents(docs.limit(0), T.train(docs.limit(0), labels.limit(0))).collect() == []


def test_the_driver_gets_only_words_that_tell_and_the_same_model(spark):
    """Words that the fit drops stay where the texts are; the model is that of all words."""
    rng = random.Random(12)
    texts = [(i, " ".join(["women"] * (i % 3 == 0) + ["vile"] * (i % 4 == 0) + [f"w{rng.choice('abcdefgh')}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string")
    rows = T.training_rows(docs, spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, toxic int"))
    learned = [x for x in texts if zlib.crc32(str(x[0]).encode()) % 5]
    whole = [(np.unique([T.bucket(w) for w in T.words_of(text)]).astype(np.int32), toxic) for _, text, toxic in learned]
    assert len(rows) == len(whole) and sum(t for _, t in rows) == sum(t for _, t in whole)
    assert sum(len(b) for b, _ in rows) < sum(len(b) for b, _ in whole) / 10
    one, two = T.fit(rows, rounds=50), T.fit(whole, rounds=50)
    assert one.weights.keys() == two.weights.keys() and T.bucket("vile") in one.weights
    assert abs(one.bias - two.bias) < 1e-6 and all(abs(w - two.weights[b]) < 1e-6 for b, w in one.weights.items())
