"""Embedding links against all pairs."""

import numpy as np

from clauseloom.llm import embeddings as E
from clauseloom.llm import queries as Q

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, v int"


def brute(rows):
    rows = list({r[0]: r for r in rows}.values())
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    low, links = {r[0]: r[0] for r in rows}, {r[0]: set() for r in rows}
    x = [np.array(r[1], np.float64) for r in ok]
    for i in range(len(ok)):
        for j in range(i):
            if ok[i][2] == ok[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98:
                links[ok[i][0]].add(ok[j][0])
                links[ok[j][0]].add(ok[i][0])
    for _ in rows:
        for a, bs in links.items():
            for b in bs:
                low[a] = low[b] = min(low[a], low[b])
    return {k: (len(v), low[k]) for k, v in links.items()}


def test_links_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(1 + g % 7):
            rows.append((len(rows), [float(np.float32(v)) for v in base + rng.standard_normal(16) * 0.03], g % 3, 0, 0))
    hot = rng.standard_normal(16)
    rows += [(1000 + k, [float(np.float32(v)) for v in hot + rng.standard_normal(16) * 0.02], 1, 0, 0) for k in range(150)]
    same = rows[5][1]
    rows += [(2000 + k, same, rows[5][2], 0, 0) for k in range(5)] + [(2000, same, rows[5][2], 0, 0)]
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8]
    rows += [(3000 + k, v, 1, 0, 0) for k, v in enumerate(bad)] + [(4000, same, None, 0, 0), (4001, same, None, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = E.near_duplicates(df, block=32).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert E.near_duplicates(df.limit(0)).collect() == []


def test_query_and_recall(spark):
    got = Q.op7_embedding_near_dedup(spark, SF).collect()
    want = brute([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((400, 64))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.9801, 0.99, 400)[:, None]
    pairs = np.stack([x, c * x + np.sqrt(1 - c * c) * away], 1).reshape(800, 64)
    df = spark.createDataFrame([(k, v.tolist(), 1, 0, 0) for k, v in enumerate(pairs)], SCHEMA)
    assert sum(r.n_links for r in E.near_duplicates(df).collect()) >= 0.98 * 800
