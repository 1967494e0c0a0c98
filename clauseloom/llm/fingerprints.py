"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

Every 64-byte and every 16-byte window of a text has an entropy; the rarity of an entropy is its
rank among all windows of that size in all documents.  A window that is the rarest of its
neighbourhood often enough is a feature.  Neighbourhoods of 16-byte windows are smaller in
shorter texts, by powers of two, so that these have features too; what is rarest of a large
neighbourhood is mostly so of a smaller one, so texts of two classes still share features.  The
features of each kind go, in order, into a chain of Bloom filters of 256 bytes and at most 160
features.  Two digests are alike by the overlap of their filters' bits beyond what chance gives,
kind by kind.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import as_strided, sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts_of

#: The sizes of windows, and the sizes of neighbourhoods; a window must be the rarest of a quarter of its neighbourhoods.
WIDE, NARROW, AROUND = 64, 16, (4, 8, 16, 32, 64)
FILTER_BITS, FILTER_FEATURES, PROBES = 2048, 160, 5
LEVELS = 1001
_CHUNK = 3_000_000
_SCALE = 1 << 12
_TERM = np.array([0, *(c * np.log2(c) for c in range(1, WIDE + 1))]) * _SCALE
_GAIN = np.append(np.diff(np.rint(_TERM)), 0).astype(np.int32)
_ODD = (np.random.default_rng(11).integers(1, 1 << 62, 8, dtype=np.int64) * 2 + 1).view(np.uint64)


def entropy_levels(data: np.ndarray, window: int) -> np.ndarray:
    """Entropy, from 0 to 1000, of the ``window`` bytes that start at each byte (``window`` - 1 fewer than bytes).

    Many stretches of the data slide their windows together; a step updates one count that
    leaves and one that enters in each stretch.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.empty(0, np.int16)
    stretch = max(128, -(-n // 4096))
    lanes = -(-n // stretch)
    padded = np.zeros(lanes * stretch + window - 1, np.uint8)
    padded[: len(data)] = data
    view = as_strided(padded, (lanes, stretch + window - 1), (stretch, 1))
    at = view.T.astype(np.intp) + np.arange(lanes) * 256
    counts, total = np.zeros(lanes * 256, np.int32), np.zeros(lanes, np.int32)
    out = np.empty((stretch, lanes), np.int32)
    for step in range(stretch + window - 1):
        come = at[step]
        c = counts[come]
        total += _GAIN[c]
        counts[come] = c + 1
        first = step - window + 1
        if first >= 0:
            out[first] = total
            go = at[first]
            c = counts[go] - 1
            total -= _GAIN[c]
            counts[go] = c
    level = 1000 - np.rint(out * (1000 / (window * np.log2(window) * _SCALE)))
    return level.T.ravel()[:n].astype(np.int16)


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > _CHUNK:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def _inside(sizes: np.ndarray, span: int) -> np.ndarray:
    """For joined texts: whether ``span`` bytes from each byte on lie in one text."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))
    return left >= span


def level_counts(texts: list[bytes], window: int) -> np.ndarray:
    out = np.zeros(LEVELS, np.int64)
    for batch in _batches(texts):
        sizes = np.array([len(t) for t in batch])
        levels = entropy_levels(np.frombuffer(b"".join(batch), np.uint8), window)
        out += np.bincount(levels[_inside(sizes, window)[: len(levels)]], minlength=LEVELS)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy level, rarest first; ties by level."""
    order = np.lexsort((np.arange(LEVELS), counts))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def _hash(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of 16 or 64 bytes."""
    words = np.ascontiguousarray(windows).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (words ^ (words >> np.uint64(29))) * _ODD[: words.shape[1]]
        h = (h ^ (h >> np.uint64(32))).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def around_of(sizes: np.ndarray) -> np.ndarray:
    """The neighbourhood of 16-byte windows: the largest power of two up to a sixteenth of the text, within AROUND."""
    return np.clip(1 << np.floor(np.log2(np.maximum(sizes, 16) / 16)).astype(int), AROUND[0], AROUND[-1])


def _features(batch: list[bytes], rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) in text order, each feature of a text once.

    A text too short for a neighbourhood of 16-byte windows is one feature, padded.
    """
    sizes = np.array([len(t) for t in batch])
    data = np.frombuffer(b"".join(batch), np.uint8)
    start = np.cumsum(sizes) - sizes
    owner, place, hashes = [], [], []
    around = around_of(sizes) if window == NARROW else np.full(len(sizes), AROUND[-1])
    least = window + around - 1
    if len(data) >= window:
        levels = entropy_levels(data, window)
        low = rank[levels] << 32 | np.arange(len(levels))
        left = np.repeat(np.cumsum(sizes), sizes)[: len(levels)] - np.arange(len(levels))  # bytes to the text's end
        whose = np.repeat(around, sizes)[: len(levels)]
        shift = 1
        while shift < AROUND[-1]:  # the smallest key of the next 2, 4, 8 ...
            np.minimum(low[:-shift], low[shift:], out=low[:-shift])
            shift *= 2
            if shift not in AROUND:
                continue
            whole = (whose == shift) & (left >= window + shift - 1)
            if whole.any():
                votes = np.bincount(low[whole] & 0xFFFFFFFF, minlength=len(levels))
                chosen = np.flatnonzero(votes * 4 >= shift)
                owner.append(np.searchsorted(start, chosen, side="right") - 1)
                place.append(chosen)
                hashes.append(_hash(sliding_window_view(data, window)[chosen]))
    if window == NARROW:
        for i in np.flatnonzero((sizes > 0) & (sizes < least)):
            padded = batch[i].ljust(int(-(-sizes[i] // 8) * 8), b"\0")
            owner.append([i])
            place.append([start[i]])
            hashes.append(_hash(np.frombuffer(padded, np.uint8)[None, :]))
    if not owner:
        return np.empty(0, int), np.empty(0, np.uint64)
    o, p, h = np.concatenate(owner).astype(np.int64), np.concatenate(place), np.concatenate(hashes)
    order = np.argsort(p, kind="stable")
    o, h = o[order], h[order]
    with np.errstate(over="ignore"):
        _, first = np.unique(h + o.view(np.uint64) * _ODD[0], return_index=True)
    first.sort()
    return o[first], h[first]


#: A chain of filters, as rows of 256 bytes, and its number of features.
Chain = tuple[np.ndarray, int]


def chains(batch: list[bytes], rank: np.ndarray, window: int) -> list[Chain]:
    owner, h = _features(batch, rank, window)
    n = np.bincount(owner, minlength=len(batch))
    filters = -(-n // FILTER_FEATURES)
    first, before = np.cumsum(filters) - filters, np.cumsum(n) - n
    row = first[owner] + (np.arange(len(owner)) - before[owner]) // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), np.uint8)
    for k in range(PROBES):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [(packed[f : f + m], int(c)) for f, m, c in zip(first.tolist(), filters.tolist(), n.tolist(), strict=True)]


def digests(texts: list[bytes], ranks: tuple[np.ndarray, np.ndarray]) -> list[tuple[Chain, Chain]]:
    """The chains of 64-byte and of 16-byte windows of each text; an empty text has no filter."""
    out = []
    for batch in _batches(texts):
        out += zip(chains(batch, ranks[0], WIDE), chains(batch, ranks[1], NARROW), strict=True)
    return out


def encode(digest: tuple[Chain, Chain]) -> str:
    """``features:filters`` of both kinds, the filters in base64."""
    return "|".join(f"{n}:{base64.b64encode(filters.tobytes()).decode()}" for filters, n in digest)


def decode(text: str) -> tuple[Chain, Chain]:
    parts = (x.partition(":") for x in text.split("|"))
    wide, narrow = ((np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, FILTER_BITS // 8), int(n)) for n, _, body in parts)
    return wide, narrow


def overlap(a: Chain, b: Chain) -> float:
    """From 0 to 1: each filter of the chain with fewer features takes its best partner's bits beyond chance.

    Filters count by their features; the partners are compared a block at a time.
    """
    if b[1] < a[1]:
        a, b = b, a
    x = np.unpackbits(a[0], axis=1).astype(np.float32)
    nx, share = x.sum(axis=1)[:, None], np.zeros(len(x))
    for k in range(0, len(b[0]), 256):
        y = np.unpackbits(b[0][k : k + 256], axis=1).astype(np.float32)
        ny = y.sum(axis=1)[None, :]
        most, chance = np.minimum(nx, ny), nx * ny / FILTER_BITS
        share = np.maximum(share, np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0, 1).max(axis=1))
    weight = np.full(len(x), FILTER_FEATURES, float)
    weight[-1] = a[1] - FILTER_FEATURES * (len(x) - 1)
    return float((share * weight).sum() / weight.sum())


def likeness(a: tuple[Chain, Chain], b: tuple[Chain, Chain]) -> float:
    """The mean overlap of the kinds that both digests have, by the fewer features of each.

    Two empty digests are alike, an empty one and another not.
    """
    both = [(overlap(x, y), min(x[1], y[1])) for x, y in zip(a, b, strict=True) if x[1] and y[1]]
    if not both:
        return float(not any(n for _, n in (*a, *b)))
    return sum(v * n for v, n in both) / sum(n for _, n in both)


def rarity_of(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Ranks of entropy levels, from the 64-byte and the 16-byte windows of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, LEVELS), np.int64)
        for pdf in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in pdf["t"]]
            total += [level_counts(texts, WIDE), level_counts(texts, NARROW)]
        kind, level = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "level": level, "n": total[kind, level]})

    texts = docs.select(F.col(text_col).alias("t")).where("t is not null")
    counts = np.zeros((2, LEVELS), np.int64)
    found = map_slices(texts, count, "kind int, level int, n bigint").groupBy("kind", "level").agg(F.sum("n").alias("n"))
    for r in found.collect():  # 2,002 rows at most
        counts[r["kind"], r["level"]] = r["n"]
    return rarity(counts[0]), rarity(counts[1])


def fingerprint(docs: DataFrame, ranks: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """Add ``fingerprint`` to ``docs``; a null text counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(d) for d in digests([(t or "").encode("utf-8", "surrogatepass") for t in texts], ranks)])

    return docs.withColumn("fingerprint", of(text_col))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, tail, doc_id, text) such that, sorted, each row of tail 0 precedes its next document.

    Buckets are ranges of ids of about equal size.  The first document of each bucket is also
    sent, as tail 1, to the bucket before it, and the very first one to the last bucket.  So a
    text is shuffled once and no task sees more than its buckets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(np.array(rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) or [0.0])).astype(np.float64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.float64), side="right").astype(np.int32))

    firsts = sorted((r["b"], r["k"]) for r in rows.select(bucket("k").alias("b"), "k").groupBy("b").agg(F.min("k").alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # one for each bucket
    keys, to = np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int32)

    @F.pandas_udf("int")
    def tail_of(k: pd.Series) -> pd.Series:
        v = k.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
        return pd.Series(np.where(keys[at] == v, to[at], -1).astype(np.int32))

    if not firsts:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text")
    placed = rows.withColumn("own", bucket("k")).withColumn("before", tail_of("k"))
    goes = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail")))
    spread = placed.select("k", "doc_id", "text", F.explode(F.filter(goes, lambda x: x["bucket"] >= 0)).alias("to"))
    dealt = spread.select("to.bucket", "to.tail", "k", "doc_id", "text").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "tail", "k", "text").drop("k")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edits by the next document, with their likenesses.

    A null text counts as empty, rows of one id follow each other by text, rows with a null id
    come first, a single row is its own next document and an empty table gives none.
    """
    ranks = rarity_of(docs, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the row that waits for its next one, with its digest
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part = pdf.iloc[k : k + 1000]
                texts = [t or "" for t in part["text"]]
                own = digests([t.encode("utf-8", "surrogatepass") for t in texts], ranks)
                rows = [*held, *zip(part["bucket"], part["tail"], part["doc_id"], texts, own, strict=True)]
                held = rows[-1:]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
                edits = [(a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2]).encode("utf-8", "surrogatepass") for a, b in pairs]
                found = digests(edits, ranks)
                yield pd.DataFrame(
                    [(a[2], len(a[3]), hashlib.sha256(e).hexdigest(), encode(a[4]), encode(d), likeness(a[4], d), likeness(a[4], b[4])) for (a, b), e, d in zip(pairs, edits, found, strict=True)],
                    columns=names,
                )

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInPandas(run, schema)
