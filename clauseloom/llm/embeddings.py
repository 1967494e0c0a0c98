"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors get ``tables`` signatures of ``width``-quantised Gaussian projections.
Vectors of one label that share a signature meet in its bucket and are compared by exact
cosine in double precision.  Equal vectors are one class throughout.  A bucket beyond
``block`` classes is dealt out as pairs of blocks, so it is compared in full by many tasks.
A pair counts only in the first table where both vectors meet, so the tasks can sum links
themselves and return a spanning set of links: no list of pairs leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, group_bounds, settle, stored, whole_groups


def signatures(x: np.ndarray, tables: int, hashes: int, width: float, seed: int = 7) -> np.ndarray:
    """Row by vector, column by table: 32-bit signatures of unit vectors."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], tables * hashes)), rng.uniform(0, width, tables * hashes)
    odd = rng.integers(1, 1 << 62, hashes).astype(np.int64) * 2 + 1
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, hashes)
    with np.errstate(over="ignore"):
        return ((cells * odd).sum(axis=2) >> 31).astype(np.int32)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # squares of large or tiny components stay finite
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vector: str, label: str):
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(label).isNotNull() & F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _compare(t: np.ndarray, side: np.ndarray, ids: np.ndarray, n: np.ndarray, x: np.ndarray, keys: np.ndarray, cosine: float) -> tuple[list, list]:
    """Links and link counts among one group; ``side`` 0: within the block, else between 1 and 2."""
    if side[0]:
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        a, b = np.nonzero(x[one] @ x[two].T >= cosine)
        a, b = one[a], two[b]
    else:
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    first = (keys[a] == keys[b]).argmax(axis=1) == t[0]
    a, b = a[first], b[first]
    counts = np.bincount(a, weights=n[b], minlength=len(ids)) + np.bincount(b, weights=n[a], minlength=len(ids))
    low = np.arange(len(ids))
    while len(a):  # smallest index reachable here
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            break
        low = new
    return [(ids[k], ids[v]) for k, v in enumerate(low.tolist()) if k != v], [(ids[k], int(c)) for k, c in enumerate(counts.tolist()) if c]


def near_duplicates(
    rows: DataFrame, cosine: float = 0.98, tables: int = 40, hashes: int = 10, width: float = 0.8, block: int = 512,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each input row.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``cosine``.  Vectors that are null, empty, zero, or hold null or non-finite components, and
    vectors of other lengths, link with nothing.  Rows that repeat a vector's id and content
    count as one vector; all are returned.
    """
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fine = base.withColumn("fine", _usable("v", "label"))
    equal = fine.where("fine").select("vec_id", "v", "label").distinct()
    classes = equal.groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["v"].map(len)
            for _, part in pdf.groupby(sizes):
                for k in range(0, len(part), 2000):
                    some = part.iloc[k : k + 2000]
                    yield some.assign(keys=list(signatures(_unit(some["v"].tolist()), tables, hashes, width)))

    kinds = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("label", "v", "cid", "n")) + ", keys array<int>"
    classes = stored(classes.mapInPandas(sign, schema))
    spread = classes.select("cid", F.posexplode("keys").alias("t", "key"), "label", F.size("v").alias("dim"))
    spread = spread.select("cid", "t", F.xxhash64("label", "dim", "t", "key").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    meeting = (
        spread.join(shared, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("cid", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
        .withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
        .drop("own")
    )
    key = ["bucket", "i", "j"]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, key):
            ids, n, side, t = (pdf[c].to_numpy() for c in ("cid", "n", "side", "t"))
            edges, counts = [], []
            starts, sizes = group_bounds(pdf, key)
            dims = pdf["v"].map(len).to_numpy()
            two = starts[(sizes == 2)]
            two = two[(dims[two] == dims[two + 1]) & (side[two] + side[two + 1] != 2) & (side[two] + side[two + 1] != 4)]
            for dim in np.unique(dims[two]):
                a = two[dims[two] == dim]
                b = a + 1
                x, y = _unit(pdf["v"].iloc[a].tolist()), _unit(pdf["v"].iloc[b].tolist())
                ka, kb = np.stack(pdf["keys"].iloc[a]), np.stack(pdf["keys"].iloc[b])
                yes = ((x * y).sum(axis=1) >= cosine) & ((ka == kb).argmax(axis=1) == t[a])
                a, b = a[yes], b[yes]
                edges += zip(ids[a], ids[b], strict=True)
                counts += [*zip(ids[a], n[b].tolist(), strict=True), *zip(ids[b], n[a].tolist(), strict=True)]
            for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                part = slice(s, s + m)
                if len(set(dims[part])) > 1:
                    continue  # only a clash of bucket hashes joins vectors of other lengths
                x, k = _unit(pdf["v"].iloc[part].tolist()), np.stack(pdf["keys"].iloc[part])
                e, c = _compare(t[part], side[part], ids[part], n[part], x, k, cosine)
                edges += e
                counts += c
            yield pd.DataFrame({"a": [e[0] for e in edges] + [c[0] for c in counts], "b": [e[1] for e in edges] + [None] * len(counts), "links": [0] * len(edges) + [c[1] for c in counts]}).astype({"a": object, "b": object})

    id_kind = kinds["cid"]
    vectors = classes.select("cid", "v", "n", "keys")
    found = meeting.join(vectors, "cid").repartition(*key).sortWithinPartitions(*key).mapInPandas(links, f"a {id_kind}, b {id_kind}, links bigint")
    found = settle(found)
    sums = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b").distinct())
    told = (
        classes.select("label", "v", "cid", "n").join(sums, "cid", "left").join(groups, F.col("cid") == F.col("node"), "left")
        .select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "cid").alias("component"))
    )
    joined = fine.join(told, F.col("fine") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
