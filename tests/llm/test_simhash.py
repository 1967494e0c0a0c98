"""SimHash against brute force over all pairs."""

import itertools
import random

import numpy as np
import pandas as pd
import xxhash

from clauseloom.llm import simhash as S


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids, links):
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_anchors_cover_every_pair_within_two():
    rng = random.Random(5)
    for bits, spare in ((63, True), (31, False)):
        for _ in range(300):
            x = rng.getrandbits(bits + spare)
            y = x
            for b in rng.sample(range(bits + spare), rng.randint(0, 2)):
                y ^= 1 << b
            row, a = S.anchors(np.array([x, y], np.uint64), bits, spare)
            assert set(a[row == 0].tolist()) & set(a[row == 1].tolist())
            assert all(bin(int(v) ^ (x, y)[r]).count("1") <= 2 for r, v in zip(row.tolist(), a.tolist(), strict=True))


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 400))) for _ in range(40)]
    texts = [None, "", " \t\n", "One", "one", "a b", "x" * 50_000, *base]
    for t in base:
        for _ in range(4):
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "One", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = S.simhash_components(df).collect()
    fps = {i: brute_fp(t) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = components(fps, links)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((i, fps[i], want[i]) for i, _, _ in rows)
    assert len(set(want.values())) < len(fps) - 50


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filler_does_not_make_copies_of_different_texts(spark):
    rng = random.Random(3)
    own = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    texts = [f"{'- ' * 120}{t}" for t in own] + [f"{'- ' * 90}{own[2]}", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicate_components(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2, 7: 7, 8: 7}


def test_copies_among_many_texts_of_one_template(spark):
    rng = random.Random(4)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    template, texts = words(300), []
    for _ in range(600):
        own = words(70)
        texts += [" ".join(template + own), " ".join(template + own[:20] + words(30) + own[50:])]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(order[k], t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicate_components(df).collect()}
    pairs, found = 0, 0
    for k in range(0, len(texts), 2):
        one, two = (np.unique(S.shingle_hashes(t, 5)) for t in texts[k : k + 2])
        both = len(np.intersect1d(one, two))
        assert 0.80 <= both / (len(one) + len(two) - both) < 0.85  # every pair counts, whatever it shares
        pairs += 1
        found += got[order[k]] == got[order[k + 1]] == min(order[k : k + 2])
    assert pairs == 600 and found >= 0.97 * pairs


def test_chance_groups_of_anchors_stay_linear(spark, monkeypatch):
    """With only a few anchors, groups are as crowded as in a huge corpus: pairs grow with members, and copies are found."""
    rng = random.Random(6)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    real = S.anchors
    monkeypatch.setattr(S, "anchors", lambda x, bits, spare=False: (lambda r, a: (r, a & np.uint64(7)))(*real(x, bits, spare)))
    rows, n = [], 0
    classes = [(i, [rng.getrandbits(63) for _ in range(4)], i) for i in range(1_500)]
    frame = next(iter(_local_pairs(S, classes)))
    assert len(frame) < 8 * 8 * 3 * len(classes)
    for _ in range(150):
        base = words(200)
        rows += [(n, " ".join(base)), (n + 1, " ".join(base[:190] + words(10)))]
        n += 2
    got = {r.doc_id: r.component_id for r in S.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == i - i % 2 for i in got) >= 0.99 * len(got)


def _local_pairs(S, classes):
    """The pairs that one task makes of all anchors' members."""

    class Frame:
        def __init__(self, pdf):
            self.pdf = pdf

        def select(self, *columns):
            return self

        def mapInPandas(self, f, schema):
            return Frame(pd.concat(list(f(iter([self.pdf])))))

        def repartition(self, *keys):
            return self

        def sortWithinPartitions(self, *keys):
            return Frame(self.pdf.sort_values(list(keys)))

        def distinct(self):
            return self

    yield S._candidates(Frame(pd.DataFrame(classes, columns=["id", "fp", "label"])), 4).pdf


def test_sketches_exclude_no_pair_of_the_similarity():
    rng = np.random.default_rng(5)
    kept = []
    for n in (1, 3, 9, 40, 200, 1_000, 20_000):
        for part in (0.8, 0.3):
            both = max(1, round(n * part)) if part == 0.8 and n > 4 else n if part == 0.8 else int(n * part)
            one, two = [], []
            for _ in range(100):
                h = rng.integers(0, 2**63, 2 * n - both, dtype=np.int64).view(np.uint64)
                one.append(np.frombuffer(S.sketch(h[:n], 10), np.uint16))
                two.append(np.frombuffer(S.sketch(np.concatenate([h[:both], h[n:]]), 10), np.uint16))
            similarity = both / (2 * n - both)
            found = S.alike(np.array(one), np.array(two), similarity if part == 0.8 else 0.8)
            if part == 0.8:
                kept += found.tolist()
            elif n >= 9:
                assert not found.any()
    assert np.mean(kept) >= 0.995
    assert not S.alike(np.zeros((1, S.BINS), np.uint16), np.ones((1, S.BINS), np.uint16), 0.8).any()


def test_no_pair_of_the_similarity_is_left_out(spark):
    """Pairs of similarity 0.8, of which estimates and min-hashes miss some in the hundred, are all found."""
    rng = random.Random(8)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(3_000):
        own = words(8)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join([*own, *words(1)]))]  # 4 and 5 shingles, 4 shared
    template = words(150)
    for k in range(200):
        own = words(30)
        rows += [(len(rows), " ".join(template + own)), (len(rows) + 1, " ".join(template + own[:-1] + words(1)))]
    got = {r.doc_id: r.component_id for r in S.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [np.unique(S.shingle_hashes(t, 5)) for _, t in rows]
    links, first = {i: i for i, _ in rows}, len(rows) - 400

    def root(i):
        while links[i] != i:
            i = links[i]
        return i

    for i, j in [(k, k + 1) for k in range(0, first, 2)] + [(i, j) for i in range(first, len(rows)) for j in range(i + 1, len(rows))]:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = sorted((root(i), root(j)))
            links[b] = a
    assert all(links[k + 1] == k for k in range(0, first, 2))
    assert [i for i in got if got[i] != root(i)] == []


def test_parities_leave_out_long_texts_of_their_own_and_no_pair_of_the_similarity(spark):
    """Texts of 3,000 words that share some rare shingles and nothing else are no pairs, whose sets would be sent to each other."""
    rng = random.Random(9)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(60)
    texts = [" ".join(words(3_000) + shared) for _ in range(12)]
    base = words(3_000)
    texts += [" ".join(base), " ".join(base[:2_900] + words(20))]
    rows = S.simhash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 4, sets=True)
    classes = S.stored(rows.selectExpr("doc_id AS id", "n", "rare", "parity", "doc_id AS label"))
    assert {(r.a, r.b) for r in S._across(classes, 0.8).collect()} == {(12, 13)}


def test_odd_bins_are_no_more_than_the_shingles_of_one_set():
    rng = np.random.default_rng(7)
    for n, m, both in ((0, 0, 0), (0, 3, 0), (5, 4, 4), (513, 512, 500), (1_100, 1_000, 950), (5_000, 4_000, 3_990)):
        h = np.unique(rng.integers(0, 2**63, n + m, dtype=np.int64)).view(np.uint64)[: n + m - both]
        one, two = h[:n], np.concatenate([h[:both], h[n:]])
        odd = S.odd_bins(pd.Series([S.parity(one)]), pd.Series([S.parity(two)]))[0]
        assert odd <= n + m - 2 * both and (odd - n - m) % 2 == 0
        assert len(S.parity(one)) * 8 >= max(n, S.PARITY)
