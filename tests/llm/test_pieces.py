"""The scan against the library on the same pieces and scores, and exact round trips."""

import random
from array import array

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from clauseloom.llm import pieces as S
from clauseloom.llm import queries as Q


def reference():
    """The library with the file's pieces and scores, searching for the greatest sum."""
    m = pb.ModelProto()
    with open(S.public_vocabulary(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, S.FLOOR)
        if S.SPACE in p.piece[1:]:
            p.type = 5  # unused
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_words_match_the_library():
    v, p, rng = S.vocabulary(S.public_vocabulary()), reference(), random.Random(1)
    words = ["the", "of", "Éonpa", "thing", "日本", "\n", "x1", "tion", "😀", "", "ßü"]
    for _ in range(300):
        t = " ".join("".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 12)))
        got = array("I", v.encode(" " + t)[0]).tolist() if t else []
        score = lambda ids: sum(v.pieces[v.texts[i]][0] for i in ids if i not in v.byte_of)
        want = p.encode(t)
        assert got == want or (score(got), len(got)) == (score(want), len(want)), t
        assert not t or v.decode(array("I", got).tobytes())[1:] == t


def test_scan_matches_one_pass():
    v, rng = S.vocabulary(S.public_vocabulary()), random.Random(2)
    for spaces in ("", " "):
        s = " " + "".join(rng.choice("thereonandéñ日" + spaces * 3) for _ in range(900))
        for size in (40, 97):
            parts = [s[k : k + size + v.longest - 1] for k in range(0, len(s), size)]
            ms = [v.transfer(p, min(size, len(p))) for p in parts]
            path = S.states(ms, 0, 0)
            own = [v.encode(p[a : min(size, len(p)) + b]) for p, a, b in zip(parts, path, path[1:], strict=False)]
            assert sum(x for _, x in own) == v.encode(s)[1]
            assert "".join(v.decode(i) for i, _ in own) == s
            whole = ms[0]
            for m in ms[1:]:
                whole = S.product(whole, m)
            assert whole[0, 0] == v.encode(s)[1]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 4)
    rng = random.Random(3)
    texts = [None, "", " ", "▁ literal ▁", "a", "x" * 700, *("".join(rng.choice("the of and,é日 \n") for _ in range(rng.randint(1, 1500))) for _ in range(30))]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)] + [(8, texts[8], 0, "")], "doc_id long, text string, chunk int, ids string")
    v = S.vocabulary(S.public_vocabulary())
    enc = S.encode(df, chunk=60)
    scores, rows = {}, S.decode(enc).collect()
    back = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk)):
        assert len(r.text) == r.n_chars
        back.setdefault(r.doc_id, []).append((r.start, r.text))
        scores[r.doc_id] = scores.get(r.doc_id, 0) + r.score
    for i, t in enumerate(texts):
        parts = back[i] if i != 8 else back[i][::2]
        assert "".join(x for _, x in parts) == (t or "")
        assert scores[i] == (v.encode(" " + t)[1] if t else 0) * (2 if i == 8 else 1)
        assert [a for a, _ in parts] == np.cumsum([0, *(len(x) for _, x in parts)])[:-1].tolist()
    assert S.encode(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = Q.op8_sentencepiece(spark, sf).collect()
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n_chars
    assert n == {r.doc_id: len(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
