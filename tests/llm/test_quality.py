"""Held-out accuracy, agreement with co-training written out in plain Python, and odd rows."""

import zlib

import numpy as np

from clauseloom.llm import quality as C
from clauseloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


def made(rng, n):
    y = (rng.random(n) < 0.5).astype(float)
    shape = rng.standard_normal((n, C.SHAPE))
    shape[:, 0] += 3 * y
    meta = np.zeros((n, C.META))
    meta[:, 0], meta[:, 1] = y * 2.5 + rng.standard_normal(n), rng.standard_normal(n)
    word = np.where(rng.random(n) < 0.9, y, 1 - y).astype(int)
    return C.Rows(shape, meta, np.arange(n), word), y


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    (known, y), (free, _), (test, truth) = made(rng, 60), made(rng, 3000), made(rng, 4000)
    aside = np.arange(60) % 2 == 0

    def ask(views):
        out = []
        for v in views:
            z = v.logit(free)
            at = np.concatenate([np.argsort(-z)[:100], np.argsort(z)[:100]])
            out.append((free.take(at), (z[at] > 0).astype(float)))
        return out

    right = [((C.co_train(known, y, aside, ask, rounds).score(test)[:, 0] >= 0.5) == truth).mean() for rounds in (0, 3)]
    assert right[1] >= right[0] and right[1] > 0.93
    assert np.allclose(C.co_train(known, np.ones(60), aside, ask).score(known)[:, 0], 60.5 / 61)


def test_agrees_with_plain_co_training(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = C.stored(C.features(docs))
    model = C.train(seen, spark.read.parquet(f"{SF}/labels.parquet"), rounds=2, picks=30)
    got = {r.doc_id: r.score for r in C.score_documents(seen, model).collect()}
    all_rows = {r.doc_id: r for r in seen.collect()}
    of = lambda ids: C.Rows.of(*([all_rows[i][c] for i in ids] for c in ("shape", "words", "meta")))
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in all_rows}
    known = [i for i in all_rows if i in label and fold[i] > 0]
    y = np.array([label[i] for i in known], float)
    aside = np.array([fold[i] == 1 for i in known])
    free, taken = [i for i in all_rows if i not in label], set()
    good = int(np.ceil(30 * y.mean()))

    def ask(views):
        out = []
        sides = [{i: 1 / (1 + np.exp(-v.logit(of([i]))[0])) for i in free if i not in taken} for v in views]
        for p in sides:
            mine = [(i, 1) for i in sorted(p, key=lambda i: (-p[i], i)) if p[i] >= 0.9][:good]
            mine += [(i, 0) for i in sorted(p, key=lambda i: (p[i], i)) if 1 - p[i] >= 0.9][: 30 - good + 1]
            mine = [(i, t) for i, t in mine if i not in taken]
            taken.update(i for i, _ in mine)
            out.append((of([i for i, _ in mine]), np.array([t for _, t in mine], float)))
        return out

    plain = C.co_train(of(known), y, aside, ask, 2)
    want = plain.score(of(list(all_rows)))[:, 0]
    assert taken and np.allclose([got[i] for i in all_rows], want, atol=0.02)
    assert np.mean(np.abs([got[i] - w for i, w in zip(all_rows, want, strict=True)]) < 1e-6) > 0.98


def test_query_accuracy(spark):
    got = Q.op9_quality_cotraining(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9
    assert all(0 <= v <= 1 for r in got for v in (r.score, r.text_score, r.metadata_score))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (2, "", "a", None), (None, "x", "a", 1), (3, "w " * 50_000, "b", 100_000), (3, "w", "b", 1)], "doc_id long, text string, source string, n_chars long").selectExpr("*", "1.0 AS score")
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    seen = C.features(docs)
    assert len(C.score_documents(seen, C.train(seen, labels)).collect()) == 5
    none = C.features(docs.limit(0))
    assert C.score_documents(none, C.train(none, labels.limit(0))).collect() == []


def test_a_fit_holds_few_rows_of_its_matrix():
    """The design matrix is made by blocks: the peak stays far below its size, and the weights are those of the whole."""
    import tracemalloc

    rng = np.random.default_rng(3)
    n, kinds = 20_000, 400
    y = rng.integers(0, 2, n).astype(float)
    words = [np.unique(np.append(rng.integers(1_000, 1_000 + 2 * kinds, 20), rng.integers(1_000, 1_000 + kinds, 8) * 2 - 1_000 + int(y[i]))).astype(np.uint16) for i in range(n)]
    rows = C.Rows.of([rng.random(C.SHAPE).astype(np.float32).tobytes() for _ in range(n)], [w.tobytes() for w in words], [C.metadata("a", "b", 10.0).tobytes()] * n)
    tracemalloc.start()
    view = C.View.fit(rows, y, np.ones(n), words=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    chosen = np.flatnonzero(view.of_word)
    assert len(chosen) > 300 and peak < 8 * n * (C.SHAPE + len(chosen)) / 1.2
    x = np.hstack([(rows.shape - view.mean) / view.scale, np.stack([np.isin(chosen, w) for w in words]).astype(float)])
    whole = C.logistic(x, y)
    assert np.abs(whole[C.SHAPE : -1] - view.of_word[chosen]).max() < 1e-5
