"""Repeated passages against planted ones and against brute force."""

import random

import numpy as np

from clauseloom.llm import passages as P
from clauseloom.llm import queries as Q


def test_compact_windows_hold_every_stretch_once(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 1 << 60, 120), rng.integers(1, 6, 120), np.full(120, 7), rng.integers(1, 1 << 60, 3), rng.integers(1, 1 << 60, 40)]
    h = np.concatenate([np.append(t, 0) for t in texts]).astype(np.uint64)
    h[h < 100] <<= np.uint64(20)
    found = [tuple(map(int, x)) for x in zip(*P.compact_windows(h, 10), strict=True)]
    ends = np.flatnonzero(h == 0)
    for i in range(len(h)):
        for j in range(i + 10, len(h) + 1):
            over = [c for c, left, right in found if c - left <= i <= c < j <= c + right + 1]
            inside = not ((ends >= i) & (ends < j)).any()
            assert len(over) == inside and (not inside or h[over[0]] == h[i:j].min())
    long = rng.integers(1, 1 << 60, 5000).astype(np.uint64)
    whole = P.compact_windows(long, 46)
    monkeypatch.setattr(P, "BLOCK", 300)
    assert all((a == b).all() for a, b in zip(whole, P.compact_windows(long, 46), strict=True))
    assert len(P.compact_windows(np.full(2000, 5 << 20, np.uint64), 46)[0]) < 2000 / 8


def make(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [[word() for _ in range(rng.randint(60, 400))] for _ in range(60)]
    passage, near, hot = [word() for _ in range(70)], [word() for _ in range(80)], [word() for _ in range(51)]
    planted = {}
    for d in (3, 17, 40):
        at = rng.randint(0, len(texts[d]))
        texts[d][at:at] = passage
        planted[d] = (at, at + 70)
    for d in (5, 22):
        at = rng.randint(0, len(texts[d]))
        texts[d][at:at] = near if d == 5 else [*near[:40], "other", *near[41:]]
    for d in range(30, 60):
        texts[d] += hot
    texts[50][10:10] = texts[50][-60:]
    texts.append(list(texts[7]))
    return [" ".join(t) for t in texts], planted


def test_planted_passages(spark):
    texts, planted = make()
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(900, None, 1, 2), (901, "", 1, 2), (902, "a " * 20_000, 1, 2), (None, texts[0], 1, 2), (17, texts[17], 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, source_id int")
    got = P.repeated_passages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {17, 40, 22, *range(31, 60), 50, 60, 902}
    for d in (17, 40):
        a, b = planted[d]
        hit = [r for r in by[d] if r.source_id == 3]
        assert len(hit) == 1 and texts[d][hit[0].start : hit[0].end].split() == texts[d].split()[a:b]
    assert [(r.source_id, r.words) for r in by[22]] == [(5, 80)]
    for d in set(range(31, 60)) - {50}:
        assert any(r.source_id == 30 and texts[d][r.start : r.end].split()[-51:] == texts[d].split()[-51:] for r in by[d])
    assert [(r.source_id, r.start, r.end) for r in by[60]] == [(7, 0, len(texts[60]))]
    assert all(r.words >= 50 for r in got)
    kept = {r.doc_id: r for r in P.cut_passages(df.drop("key").withColumnRenamed("source_id", "n_chars")).where("doc_id <> 17").collect()}
    assert 60 not in kept and kept[0].text == texts[0] and kept[3].text == texts[3] and kept[900].text is None
    assert kept[40].text.split()[: planted[40][0]] == texts[40].split()[: planted[40][0]] and kept[40].n_chars == len(kept[40].text)
    assert " ".join(texts[3].split()[planted[3][0] : planted[3][1]]) not in kept[40].text
    assert P.repeated_passages(df.limit(0)).collect() == []


def test_passage_of_lines_that_stand_apart_in_earlier_texts(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    lines = [words(27) for _ in range(30)]
    texts = [[*words(60), *line, *words(60)] for line in lines]
    for k in range(0, 30, 3):
        passage = sum(lines[k : k + 3], [])
        texts += [[*words(70), *passage, *words(50)], [*words(30), *passage, *words(90)]]
    texts += [texts[30], [*texts[32][:110], "other", *texts[32][111:]]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.repeated_passages(df).collect()}
    assert set(got) == {*range(31, 50, 2), 50, 51}
    assert all((got[d].source_id, got[d].words) == (d - 1, 81) for d in range(31, 50, 2))
    assert [(got[d].source_id, got[d].words) for d in (50, 51)] == [(30, 201), (32, 201)]


def test_parts_that_stand_alone_in_many_earlier_texts(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    texts, later = [], []
    for parts, size, changed in ((2, 35, 0), (2, 49, 0), (3, 30, 0), (2, 40, 1), (3, 30, 1)):
        for _ in range(6):
            own = [words(size) for _ in range(parts)]
            texts += [[*words(40), *part, *words(40)] for part in own for _ in range(15)]
            whole = sum(own, [])
            for copy in range(3):
                some = list(whole)
                if changed and copy:
                    some[rng.randrange(8, len(some) - 8)] = "other"
                later.append((copy, [*words(60), *some, *words(60)], 60, len(some)))
    first = len(texts)
    texts += [t for _, t, _, _ in later]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in P.repeated_passages(df).collect():
        at = len(" ".join(texts[r.doc_id])[: r.start].split())
        found.setdefault(r.doc_id, set()).update(range(at, at + r.words))
    again = [(first + k, set(range(at, at + n))) for k, (copy, _, at, n) in enumerate(later) if copy]
    hit = [len(v & found.get(d, set())) / len(v) for d, v in again]
    assert sum(hit[:36]) >= 0.999 * 36 and sum(hit) >= 0.95 * len(hit)


def test_query_finds_all_exact_repeats(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first, must = {}, {}
    for d in sorted(texts):
        words = texts[d].lower().split()
        for i in range(len(words) - 49):
            k = " ".join(words[i : i + 50])
            if first.setdefault(k, (d, i))[0] < d:
                must.setdefault(d, set()).update(range(i, i + 50))
    found = {}
    for r in Q.op5_substring_dedup(spark, sf).collect():
        at = len(texts[r.doc_id][: r.start].split())
        found.setdefault(r.doc_id, set()).update(range(at, at + r.words))
        assert r.source_id <= r.doc_id
    total = sum(map(len, must.values()))
    assert total > 1000 and sum(len(v & found.get(d, set())) for d, v in must.items()) >= 0.999 * total
