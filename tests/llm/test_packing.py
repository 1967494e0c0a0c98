"""Packing against the tokenizer itself and against brute-force optima."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np

from clauseloom.llm import packing as K


def best(lengths, capacity):
    """Fewest bins, by trying every assignment of few pieces."""
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms, limit):
        if i == len(lengths):
            return len(rooms)
        out = limit
        for r in {*rooms}:
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                out = min(out, go(i + 1, [*rest, r - lengths[i]], out))
        if len(rooms) + 1 < out:
            out = min(out, go(i + 1, [*rooms, capacity - lengths[i]], out))
        return out

    return go(0, [], len(lengths) + 1)


def test_plan_is_complete_and_near_the_optimum():
    rng = random.Random(2)
    worse = 0
    for _ in range(120):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        p = K.plan(Counter(lengths), 20)
        bins = {}
        for length, start, count, per, first, offset in p.runs:
            for r in range(count):
                bins.setdefault(first + r // per, []).append((offset + r % per * length, length))
        assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 20
        worse += len(bins) - best(lengths, 20)
    assert worse <= 3


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    fixed = 0
    for _ in range(150):
        lengths = [rng.randint(3, 20) for _ in range(rng.randint(2, 8))]
        p = K.Plan(20, Counter(lengths))
        p.reduce()
        fixed += p.bins
        rest = [k for k, n in p.left.items() for _ in range(n)]
        assert p.bins + best(rest, 20) == best(lengths, 20)
    assert fixed > 200


def test_words_give_the_tokenizers_ids():
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "don't stop, o'clock's", "é.ü?! ,x", "日本 語。 x", "x" * 900, "a  b", "12 3.4 %%% ###", "<|endoftext|> a<|endoftext|>", "w.!? W.", "'s 's"]
    rng = random.Random(4)
    texts += ["".join(rng.choice(" \n\tab1.é'’!") for _ in range(60)) for _ in range(300)]
    e = K.encoder(K.public_tokenizer())
    for t in texts:
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want, repr(t)


def test_pack_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "word", "same text", "same text", *(" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(1, 700))) for _ in range(40))]
    texts.append("long " * 9_000)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = K.pack_documents(df, 256).collect()
    e = K.encoder(K.public_tokenizer())
    for i, t in enumerate(texts):
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.length for r in own[1:]] == [256] * (len(own) - 1)
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 256) + 2
    assert K.pack_documents(df.limit(0), 256).collect() == []
