"""Digests: entropy against its definition, edits, neighbours and odd rows."""

import hashlib
import random
from collections import Counter
from math import log2

import numpy as np

from clauseloom.llm import fingerprints as P
from clauseloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def entropy(data, at, window):
    c = Counter(data[at : at + window])
    return -1000 * sum(v / window * log2(v / window) for v in c.values()) / log2(window)


def test_entropy_levels():
    rng = random.Random(1)
    data = bytes([rng.choice(b"abc defg\xc3\xa9") for _ in range(5000)] + [0] * 100)
    for window in (64, 16):
        got = P.entropy_levels(np.frombuffer(data, np.uint8), window)
        assert len(got) == len(data) - window + 1
        assert all(abs(got[i] - entropy(data, i, window)) <= 1 for i in range(0, len(got), 37))


def ranks_of(texts):
    return tuple(P.rarity(P.level_counts(texts, w)) for w in (P.WIDE, P.NARROW))


def plain_bits(text, rank, window):
    """The set bits of each filter, and the number of features, one window at a time."""
    levels = P.entropy_levels(np.frombuffer(text, np.uint8), window)
    n, around = len(text), 64
    if window == 16:
        around = next((a for a in (64, 32, 16, 8) if n >= 16 * a), 4)
    votes = Counter(min(range(i, i + around), key=lambda k: (rank[levels[k]], k)) for i in range(max(0, n - window - around + 2)))
    hashes = [int(P._hash(np.frombuffer(text[i : i + window], np.uint8)[None, :])[0]) for i in sorted(votes) if votes[i] >= around / 4]
    if window == 16 and 0 < n < window + around - 1:
        hashes = [int(P._hash(np.frombuffer(text.ljust(-(-n // 8) * 8, b"\0"), np.uint8)[None, :])[0])]
    hashes = list(dict.fromkeys(hashes))
    return [{h >> 11 * k & 2047 for h in hashes[f : f + 160] for k in range(5)} for f in range(0, len(hashes), 160)], len(hashes)


def plain_likeness(a, b):
    total = weight = 0
    for (x, n), (y, m) in zip(a, b, strict=True):
        if m < n:
            x, n, y, m = y, m, x, n
        if not n:
            continue
        sizes = [160] * (len(x) - 1) + [n - 160 * (len(x) - 1)]
        for one, size in zip(x, sizes, strict=True):
            chance = lambda o: len(one) * len(o) / 2048  # noqa: E731, B023
            best = max((len(one & o) - chance(o)) / max(min(len(one), len(o)) - chance(o), 1e-6) for o in y)  # noqa: B023
            total, weight = total + n * size / n * min(1, max(0, best)), weight + size
    return total / weight if weight else float(not any(n for _, n in (*a, *b)))


def test_digests_and_likeness_against_brute_force():
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(n)).encode() for n in (0, 1, 3, 8, 20, 60, 85, 90, 200, 2500)]
    texts += [texts[6][:500], texts[7][:530], b"-" * 300 + texts[8], b"ab" * 200]
    ranks = ranks_of(texts)
    got = P.digests(texts, ranks)
    plain = [tuple(plain_bits(t, r, w) for r, w in zip(ranks, (64, 16), strict=True)) for t in texts]
    for g, p in zip(got, plain, strict=True):
        for (filters, n), (sets, m) in zip(g, p, strict=True):
            assert n == m and [set(np.flatnonzero(f).tolist()) for f in np.unpackbits(filters, axis=1)] == sets
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert abs(P.likeness(got[i], got[j]) - plain_likeness(plain[i], plain[j])) < 1e-5, (i, j)


def test_likeness_and_encoding():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)).encode() for n in (400, 400, 5000, 5000, 60, 60)]
    ranks = ranks_of(texts)
    after = [1, 2, 3, 2, 5, 4]
    halves = [t[: len(t) // 2] + texts[k][len(texts[k]) // 2 :] for t, k in zip(texts, after, strict=True)]
    own, cut = P.digests(texts, ranks), P.digests(halves, ranks)
    for a, b, c in zip(own, cut, [own[k] for k in after], strict=True):
        assert P.likeness(a, a) == 1 and P.likeness(a, c) < 0.15 < 0.25 < P.likeness(a, b)
        back = P.decode(P.encode(a))
        assert all(x[1] == y[1] and (x[0] == y[0]).all() for x, y in zip(back, a, strict=True))
    for n in (505, 1015):  # near copies on both sides of a class of sizes
        t = " ".join(word() for _ in range(300)).encode()
        a, b = P.digests([t[:n], t[: n + 15]], ranks)
        assert P.likeness(a, b) > 0.7
    assert P.digests(texts[:1], ranks)[0][1][1] == own[0][1][1]  # a digest does not depend on its batch
    assert P.encode(P.digests([b"x", texts[2]], ranks)[1]) == P.encode(own[2])


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = Counter()
    for i, r in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(order)]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want[r[0], len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_query(spark):
    got = Q.op3_document_fingerprints(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, got)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.median([r.near_edited for r in got]) > 0.4 > 0.1 > np.median([r.near_next for r in got])


def test_odd_rows(spark):
    rows = [(5, None), (9, ""), (2, "a"), (2, "b" * 40), (None, "né"), (10**12, "word " * 30_000), (-4, "é" * 700), (9, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, tail int")
    check(rows, P.compare_with_edits(df).collect())
    check(rows[:1], P.compare_with_edits(df.where("doc_id = 5")).collect())
    assert P.compare_with_edits(df.limit(0)).collect() == []
