"""SimHash near-duplicate grouping by anchor-point covering.

Fingerprints are majority votes over shingle hashes.  Anchors are the codewords of a perfect
Hamming code (covering radius 1), extended by one free bit where the block has 64 bits.  Two
words at distance 2 or less have a midpoint at distance 1 of both; the midpoint lies within
the covering radius of an anchor, so both words lie within 2 of that anchor.  A fingerprint
is therefore copied to every anchor within radius + threshold / 2 = 2 (33 copies of a 64-bit
word, instead of 683 for radius + threshold), and words are compared only per anchor.  At most
1 + 64 + 2016 different 64-bit words fit around an anchor, whatever the input, so no anchor
grows with the data; equal fingerprints are one class before any of this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, group_bounds, map_slices, settle, stored, whole_groups

SEED = 42
#: Odd multipliers that derive further 64-bit families from one shingle hash.
_STEP = 0x9E3779B97F4A7C15
#: Keys of two min-hashes: texts of similarity 0.8 share one of them with a probability of 1 - (1 - 0.8 ** 2) ** MINS, 0.994.
MINS = 5
#: Bins of a set's sketch, two bytes each, whatever the length of the text, and bits of its parity at least.
BINS, PARITY = 256, 512


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``words``-word shingle, repeats kept; the whole sequence if shorter."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_intdigest
    cut = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((hash_of(line[s:e], SEED) for s, e in cut), np.uint64, len(parts) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is 1 where over half of ``hashes`` have it set."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts = counts + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _mixed(hashes: np.ndarray, family: int) -> np.ndarray:
    if not family:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(_STEP * family % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, family: int) -> bytes:
    """16 bits of the smallest of ``hashes`` in each of BINS bins; 0 where a bin has none."""
    m = np.sort(_mixed(hashes, family))
    bins, first = np.unique(m >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out = np.zeros(BINS, np.uint16)
    out[bins.astype(np.int64)] = np.maximum(m[first] & np.uint64(0xFFFF), np.uint64(1))
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of sketches ``a`` and ``b`` (rows of BINS) may have that Jaccard similarity.

    The share of equal bins, one shingle of the union drawn from each, estimates it; three
    standard deviations less will do.
    """
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 4_096):
        x, y = a[k : k + 4_096], b[k : k + 4_096]
        either = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
        share = ((x == y) & (x > 0)).sum(axis=1) / either
        union = -BINS * np.log1p(-np.minimum(either, BINS - 0.5) / BINS)  # shingles that fill so many bins
        out[k : k + 4_096] = share >= similarity - 3 * np.sqrt(similarity * (1 - similarity) * np.maximum(1 / either - 1 / union, 0))
    return out


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, BINS)


def common_shingles(docs: DataFrame, words: int, texts: int = 10_000, most: int = 1 << 18, share: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, how many texts have each) of the ``most`` widespread shingles of about ``texts`` texts or that ``share`` of all.

    They only say in which order :func:`prefix` takes shingles; no result depends on them.  From a fixed
    number of texts, shingles of ever more texts would pass for rare ones, and pairs grow with the square.
    """
    share = int(min(1.0, max(share, texts / max(1, docs.count()))) * (1 << 20))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.concatenate([np.unique(shingle_hashes(t, words)) for t in pdf["text"]]).view(np.int64)})

    found = stored(map_slices(some, run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(most))
    counted = found.toArrow()
    discard(found)
    h, n = counted["h"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest of different ``hashes``, so many that sets of the Jaccard ``similarity`` share one of theirs.

    All sets take their shingles in one order, by (texts of the sample that have it, hash).
    """
    values, counts = common
    spread = np.zeros(len(hashes), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        spread = np.where(values[at] == hashes, counts[at], 0)
    most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, spread))[:most]]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each bin of the different hashes, whether it holds an odd number of them; no fewer bins than hashes.

    Bins go by the low bits, so the two halves of a parity, put together by XOR, are that of half as many bins.
    """
    bins = 1 << max(PARITY - 1, len(hashes) - 1).bit_length()
    return np.packbits(np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1).tobytes()


def odd_bins(a: pd.Series, b: pd.Series) -> np.ndarray:
    """In how many bins the parities differ, each pair over the bins of the smaller one."""
    one, two = list(a), list(b)
    size = np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(one), np.int64)
    for pair in np.unique(size, axis=0):
        rows = np.flatnonzero((size == pair).all(axis=1))
        for k in range(0, len(rows), 1_000):
            part = rows[k : k + 1_000].tolist()
            x, y = (np.frombuffer(b"".join(v[i] for i in part), np.uint64).reshape(len(part), -1) for v in (one, two))
            least = min(x.shape[1], y.shape[1])
            x, y = (np.bitwise_xor.reduce(v.reshape(len(part), -1, least), axis=1) for v in (x, y))
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def simhash(
    docs: DataFrame, words: int = 3, families: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False, similarity: float = 0.8, common: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """Rows (doc_id, fp array<long>): one 64-bit fingerprint for each family.

    A null or empty text has the zero fingerprint; other columns are ignored.  With ``sets``
    each different shingle votes once, and there are columns ``shingles``, a 128-bit digest of
    their set, ``mins``, keys of two min-hashes each, which near copies share, ``sketch``, the set's
    size ``n``, its ``rare`` shingles (:func:`prefix` for ``similarity``) and its ``parity``.
    """
    extra = ", shingles binary, mins array<bigint>, sketch binary, n int, rare array<bigint>, parity binary" if sets else ""
    sent = docs.sparkSession.sparkContext.broadcast(common or (np.empty(0, np.uint64), np.empty(0, np.int64))) if sets else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, digests, mins, sketches, sizes, rare, odd = [], [], [], [], [], [], []
            for text in pdf["t"]:
                h = shingle_hashes(text, words)
                if sets:
                    h = np.unique(h)
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sketches.append(sketch(h, families + 2 * MINS))
                    sizes.append(len(h))
                    rare.append(prefix(h, similarity, sent.value).view(np.int64))
                    odd.append(parity(h))
                    low = [_mixed(h, k).min() if len(h) else np.uint64(0) for k in range(families, families + 2 * MINS)]
                    mins.append(np.array([(int(a) * 3 + int(b)) % 2**64 for a, b in zip(low[::2], low[1::2], strict=True)], np.uint64).view(np.int64))
                fps.append(np.array([majority(_mixed(h, k)) for k in range(families)], np.uint64).view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["i"], "fp": fps} | ({"shingles": digests, "mins": mins, "sketch": sketches, "n": sizes, "rare": rare, "parity": odd} if sets else {}))

    kind = dict(docs.dtypes)[id_col]
    return map_slices(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, f"doc_id {kind}, fp array<bigint>{extra}")


def _pair_masks(bits: int) -> np.ndarray:
    """Row s: flips that lead from a word with syndrome s to every codeword within distance 2."""
    rows = np.zeros((bits + 1, (bits - 1) // 2 + 1), np.uint64)
    for s in range(1, bits + 1):
        flips = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, bits + 1) if i < (i ^ s)]
        rows[s] = flips
    return rows


def _syndromes(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(bits.bit_length()):
        mask = sum(1 << (i - 1) for i in range(1, bits + 1) if i >> k & 1)
        out |= (np.bitwise_count(x & np.uint64(mask)).astype(np.int64) & 1) << k
    return out


def anchors(x: np.ndarray, bits: int, spare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all codewords within distance 2 of each word of ``bits`` = 2**r - 1 bits.

    With ``spare`` bit number ``bits`` belongs to the word too and is matched within the same 2.
    """
    syndrome, masks = _syndromes(x, bits), _pair_masks(bits)
    off = np.flatnonzero(syndrome)
    at = np.flatnonzero(syndrome == 0)
    rows = [np.repeat(off, masks.shape[1]), at]
    out = [(x[off, None] ^ masks[syndrome[off]]).ravel(), x[at]]
    if spare:
        nearest = x ^ np.where(syndrome > 0, masks[syndrome, 0], np.uint64(0))
        rows.append(np.arange(len(x)))
        out.append(nearest ^ np.uint64(1 << bits))
    return np.concatenate(rows), np.concatenate(out)


def _local_links(words: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (id, smallest id of its group) among the words around one anchor."""
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= distance
    low = ids.copy()
    while True:
        new = np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == low).all():
            return [(a, b) for a, b in zip(ids.tolist(), low.tolist(), strict=True) if a != b]
        low = new


def hamming_links(classes: DataFrame, distance: int = 2) -> DataFrame:
    """Rows (a, b) of ids that connect all ``classes`` (id, fp: 64 bits) at most 2 bits apart.

    Per anchor, a spanning set of links is returned instead of all pairs, so the reachable
    sets are exactly those of all pairs.
    """
    if not 0 <= distance <= 2:
        raise ValueError("anchors within 2 cover distances 0 to 2")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 20_000):
                part = pdf.iloc[k : k + 20_000]
                fp = part["fp"].to_numpy(np.int64)
                row, anchor = anchors(fp.view(np.uint64), 63, spare=True)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "fp": fp[row], "id": part["id"].to_numpy(np.int64)[row]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = np.empty((3, 0), np.int64)
        for pdf in batches:
            block = np.concatenate([left, pdf[["anchor", "fp", "id"]].to_numpy(np.int64).T], axis=1)
            if not block.shape[1]:
                continue
            cut = int(np.searchsorted(block[0], block[0, -1]))
            left = block[:, cut:]
            yield _links_of(block[:, :cut], distance)
        yield _links_of(left, distance)

    rows = classes.mapInPandas(spread, "anchor bigint, fp bigint, id bigint")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(compare, "a bigint, b bigint").distinct()


def _links_of(block: np.ndarray, distance: int) -> pd.DataFrame:
    """Links of whole anchor groups; ``block`` has rows anchor, fp, id sorted by anchor."""
    key, fp, ids = block[0], block[1].view(np.uint64) if block.shape[1] else block[1].astype(np.uint64), block[2]
    if not len(key):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
    more = [x for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True) for x in _local_links(fp[s : s + n], ids[s : s + n], distance)]
    extra = np.array(more, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": np.concatenate([ids[two], extra[:, 0]]), "b": np.concatenate([ids[two + 1], extra[:, 1]])}).drop_duplicates()


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """Rows (doc_id, fp long, component_id): documents linked at ``distance`` bits or fewer.

    ``component_id`` is the smallest doc_id reachable.  Null and empty texts share the zero
    fingerprint and link like any other; repeated rows stay rows; an empty table gives none.
    """
    fps = settle(simhash(docs, words).select("doc_id", F.col("fp")[0].alias("fp")))
    classes = settle(fps.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("id")).where("id is not null"))
    found = connected_components(hamming_links(classes, distance))
    whole = classes.join(found, classes.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(whole, "fp", "left")


#: Blocks of 31 bits, two in each family's word; an anchor's group up to SMALL is compared in full, a group of a rare shingle by cells of about 2 * _SIDE members.
_BLOCK, SMALL, _SIDE = 31, 8, 512
#: Parts of the shingles, taken one after another, that :func:`_across` looks for in other texts.
PASSES = 4


def _candidates(classes: DataFrame, families: int) -> DataFrame:
    """Rows (a, b): pairs of classes (id, fp array, label) that share an anchor in some block and look alike.

    Only classes of different labels are paired.  Alike: at most 22 of 64 bits of another family
    differ.  In a group beyond SMALL each member is paired with the first and with its neighbours
    in the order of that word, so the pairs of an anchor are in proportion to its members, however
    many meet there by chance in a large corpus.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 5_000):
                part = pdf.iloc[k : k + 5_000]
                fp, ids, label = np.stack(part["fp"]).astype(np.int64).view(np.uint64), part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
                for block in range(2 * families):
                    word = fp[:, block // 2] >> np.uint64(32 * (block % 2)) & np.uint64((1 << _BLOCK) - 1)
                    row, anchor = anchors(word, _BLOCK)
                    key = (np.uint64(block) << np.uint64(40) | anchor).view(np.int64)
                    yield pd.DataFrame({"key": key, "other": fp[row, (block // 2 + 1) % families].view(np.int64), "id": ids[row], "label": label[row]})

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key"]):
            start, size = group_bounds(pdf, ["key"])
            ids, label, other = pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), pdf["other"].to_numpy(np.int64).view(np.uint64)
            a, b = [], []
            for n in range(2, SMALL + 1):
                at = start[size == n]
                if len(at):
                    x, y = np.triu_indices(n, 1)
                    a.append((at[:, None] + x).ravel())
                    b.append((at[:, None] + y).ravel())
            for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                if (label[s : s + n] == label[s]).all():
                    continue
                order = s + np.argsort(other[s : s + n], kind="stable")
                a += [np.full(n - 1, s), order[:-1], order[:-2]]
                b += [np.arange(s + 1, s + n), order[1:], order[2:]]
            if a:
                i, j = np.concatenate(a), np.concatenate(b)
                near = (np.bitwise_count(other[i] ^ other[j]) <= 22) & (label[i] != label[j])
                one, two = ids[i[near]], ids[j[near]]
                yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)}).drop_duplicates()

    rows = classes.select("id", "fp", "label").mapInPandas(spread, "key bigint, other bigint, id bigint, label bigint")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInPandas(pair, "a bigint, b bigint").distinct()


def _across(classes: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b): all pairs of classes (id, n, rare, parity, label; stored) of different labels that may have the ``similarity``.

    Sets of that similarity share a rare shingle, have sizes in that proportion, enough shingles from
    the first shared one on, and parities that differ in no more bits than they have shingles of their
    own.  These bounds hold for every pair, so none of the similarity is left out.  The group of a
    shingle is cut into parts by a hash, and every two parts meet in a group of their own; shingles of one
    label only are left out.
    """
    members = classes.select("id", "n", "label", F.posexplode("rare").alias("pos", "key"))
    shared = []
    for k in range(PASSES):  # the members of all shingles are many times those of shared ones, and on disk only for a part of them at a time
        some = members.where(F.pmod("key", F.lit(PASSES)) == k)
        sizes = some.groupBy("key").agg(F.count("*").alias("many"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        held = some.join(sizes.select("key", F.ceil(F.col("many") / _SIDE).cast("int").alias("parts")), "key")
        shared.append(stored(held.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))))
    dealt = reduce(DataFrame.unionByName, shared)
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("key", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"), "part", "id", "n", "pos", "label")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key", "x", "y"]):
            ids, label, part, n, pos, x, y = (pdf[k].to_numpy(np.int64) for k in ("id", "label", "part", "n", "pos", "x", "y"))

            def able(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                least = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
                held = (label[i] != label[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                one, two = ids[i[held]], ids[j[held]]
                return np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0)

            start, size = group_bounds(pdf, ["key", "x", "y"])
            found, same = [], x[start] == y[start]
            for k in range(2, SMALL + 1):
                at = start[same & (size == k)]
                one, two = np.triu_indices(k, 1)
                found += [able((at[g : g + 10_000, None] + one).ravel(), (at[g : g + 10_000, None] + two).ravel()) for g in range(0, len(at), 10_000)]
            for s, k, alone in zip(*(v[~same | (size > SMALL)].tolist() for v in (start, size, same)), strict=True):
                rows = np.arange(s, s + k)
                if alone:
                    one, two = np.triu_indices(k, 1)
                    found.append(able(s + one, s + two))
                else:
                    one, two = rows[part[rows] == x[s]], rows[part[rows] == y[s]]
                    found.append(able(np.repeat(one, len(two)), np.tile(two, len(one))))
            if found:
                yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        both = (n + m).to_numpy(np.int64)
        return pd.Series(odd_bins(a, b) <= both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9))

    pairs = stored(spread.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(compare, "a bigint, b bigint").distinct())
    one, two = (classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in ("a", "b"))
    left = stored(pairs.join(one, "a").join(two, "b").where(near("pa", "pb", "na", "nb")).select("a", "b"))
    discard(*shared, pairs)
    return left


def near_duplicate_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, families: int = 4) -> DataFrame:
    """Rows (doc_id, component_id): documents linked by a Jaccard similarity of their shingles.

    Texts that share a key of two min-hashes are compared with the first of them, which joins large
    families of near copies with as many comparisons as members.  Then anchors of the blocks of
    ``families`` SimHash words propose pairs, of which whole words and sketches of the sets drop those
    that are clearly apart.  Last, all texts that are still apart and share one of their rarest shingles are
    compared, which leaves out no pair of the ``similarity`` (:func:`_across`).  Exact Jaccard
    similarity on sets of ``words``-word shingles decides.  Texts with equal sets of shingles are one class.  Null
    and empty texts are one group; texts of any length are read whole; repeated rows stay rows;
    other columns are ignored; an empty table gives none.
    """
    fps = stored(simhash(docs, words, families, sets=True, similarity=similarity, common=common_shingles(docs, words)))
    of_class = [F.first(c).alias(c) for c in ("fp", "mins", "sketch", "n", "rare", "parity")]
    own = stored(fps.select("doc_id", "shingles"))
    classes = stored(fps.groupBy("shingles").agg(F.min(F.col("doc_id").cast("long")).alias("id"), *of_class).where("id is not null"))
    discard(fps)
    keyed = classes.select("id", F.explode("mins").alias("key"))
    leaders = stored(keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"))
    early = keyed.join(leaders, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = settle(_similar(docs, early, words, similarity))
    discard(leaders)

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(alike(_sketches(a), _sketches(b), similarity), dtype=bool)

    one = classes.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("sketch").alias("sb"))
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    expected = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = int(64 * families * (expected + 4 * math.sqrt(expected * (1 - expected) / (64 * families))))
    labels = connected_components(links)
    labelled = classes.join(labels, F.col("id") == labels.node, "left").select("id", "fp", F.coalesce("component", "id").alias("label"))
    proposed = _candidates(labelled, families)
    near = proposed.join(one, "a").join(two, "b").where(apart <= most).where(likely("sa", "sb")).select("a", "b")
    links = settle(links.union(_similar(docs, near, words, similarity)))
    labels = connected_components(links)
    apart = classes.join(labels, F.col("id") == labels.node, "left").select("id", "n", "rare", "parity", F.coalesce("component", "id").alias("label"))
    apart = stored(apart)
    left = _across(apart, similarity)
    discard(apart)
    if not left.isEmpty():
        links = settle(links.union(_similar(docs, left, words, similarity)))
        labels = connected_components(links)
    whole = classes.join(labels, F.col("id") == labels.node, "left").select("shingles", F.coalesce("component", "id").alias("component_id"))
    out = stored(own.join(whole, "shingles", "left").select("doc_id", "component_id"))
    discard(own, classes, left)
    return out


def _similar(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of documents whose sets of shingles, as 40 bits of each hash, have the Jaccard ``similarity``."""
    pairs = stored(pairs)
    involved = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())  # Spark broadcasts few ids, and knows their size

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "held": [np.unique(shingle_hashes(t, words) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in pdf["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(involved, "id", "left_semi")
    held = stored(map_slices(texts, sets, "id bigint, held binary").groupBy("id").agg(F.min("held").alias("held")))

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.pad(np.frombuffer(v, np.uint8).reshape(-1, 5), ((0, 0), (0, 3))).view(np.uint64).ravel() for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    first, second = held.select(F.col("id").alias("a"), F.col("held").alias("ha")), held.select(F.col("id").alias("b"), F.col("held").alias("hb"))
    found = stored(pairs.join(first, "a").join(second, "b").where(jaccard("ha", "hb") >= similarity).select("a", "b"))
    discard(pairs, involved, held)
    return found


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group, and all rows of that doc_id.

    Rows with a null doc_id are kept.
    """
    groups = near_duplicate_components(docs, **settings)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
