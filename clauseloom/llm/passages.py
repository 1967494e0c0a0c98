"""Near-duplicate passages by compact windows of min-hashes.

A text is a sequence of five-word shingles.  For one hash function, the top of the Cartesian
tree over the shingles' hashes splits the text into compact windows: every stretch that lies in
a window and covers its centre has the centre's hash as its min-hash.  Two texts that share a
passage share the windows' min-hashes whatever surrounds the passage.

First, windows of one min-hash are linked to the first of them (by doc_id, then place), so a
passage in many documents makes as many links as it has copies; documents linked to the same
first document by enough hash functions are verified on their shingles.

The first window of a min-hash need not hold the passage, only one shingle of it.  So the
windows that lie in no verified passage, and all others of their min-hashes, go on: intervals of
the functions' windows are joined within each text to stretches of a passage's length that have
the same min-hashes in all functions, or all but one.  These are linked by all these min-hashes
together and verified, and those whose four min-hashes all occur elsewhere are also compared by
a hash of the whole stretch: exact repeats do not depend on any first window.

``REACH`` is no cap: windows are split as long as they hold a passage, so each shingle of a
shared passage lies within one passage length of a shared centre.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, group_bounds, map_slices, stored, whole_groups

SHINGLE, PASSAGE, HASHES, MIN_HASHES, SIMILARITY = 5, 50, 4, 2, 0.8
REACH = 127
#: Sets of ranges that a source's text serves at a time.
SETS = 64
#: Places whose windows are found at a time.
BLOCK = 1 << 18
_ODD = (np.random.default_rng(23).integers(1, 1 << 62, 2 * 8, dtype=np.int64) * 2 + 1).view(np.uint64)
_WORD = re.compile(r"\S+")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, words: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the five-word shingles of a lower-cased text, by place."""
    parts = text.lower().split()
    n = len(parts) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            out = (out ^ h[k : k + n]) * _ODD[0]
            out ^= out >> np.uint64(29)
    return out


def rehash(s: np.ndarray, function: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (s ^ _ODD[2 * function]) * _ODD[2 * function + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


#: Places are told apart by the low bits of a packed hash; any number of places above REACH will do.
_LOW = 12
_TURN = 2_654_435_761 % (1 << _LOW) | 1


def compact_windows(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, left, right) of all windows of at least ``least`` places, within reach.

    ``h`` holds texts one after the other; a zero ends a text and lies in no window.  The
    centres are the nodes of the Cartesian tree whose windows hold a stretch of ``least`` places;
    ``left`` and ``right`` say how far a window goes to either side, REACH at most.  Minima
    over 1, 2, 4 ... places give every stretch's minimum, and, from the largest down, each
    centre's reach.  Equal minima count as unequal, in an order that spreads them.
    """
    n, around = len(h), REACH + least + 1
    if n > 4 * BLOCK:  # by blocks, each with what its windows can reach
        found = []
        for at in range(0, n, BLOCK):
            begin = max(0, at - around)
            c, left, right = compact_windows(h[begin : at + BLOCK + around], least)
            own = (c >= at - begin) & (c < at - begin + BLOCK)
            found.append((c[own] + begin, left[own], right[own]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))
    low = (np.arange(n, dtype=np.uint64) * np.uint64(_TURN)) & np.uint64((1 << _LOW) - 1)
    x = np.zeros(n + 2 * (REACH + 1), np.uint64)
    x[REACH + 1 : REACH + 1 + n] = np.where(h == 0, np.uint64(0), (h | np.uint64(1 << _LOW)) >> np.uint64(_LOW) << np.uint64(_LOW) | low)
    least_of = [x]  # the minimum of 2**k places from each place on
    while 1 << len(least_of) <= REACH + 1:
        step, last = 1 << (len(least_of) - 1), least_of[-1]
        longer = last.copy()
        np.minimum(last[:-step], last[step:], out=longer[:-step])
        least_of.append(longer)
    k = least.bit_length() - 1
    stretch, later = len(x) - least + 1, least - (1 << k)
    m = np.minimum(least_of[k][:stretch], least_of[k][later : later + stretch])
    start = np.flatnonzero((m != 0) & np.concatenate(([True], m[1:] != m[:-1])))
    back = np.uint64(pow(_TURN, -1, 1 << _LOW))
    place = (m[start] * back & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    c = start + (place - (start - REACH - 1)) % (1 << _LOW)
    c = np.unique(c)
    left, right = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(REACH.bit_length() - 1, -1, -1):
        right += (least_of[k][c + 1 + right] > x[c]).astype(np.int64) << k
        left += (least_of[k][c - left - (1 << k)] > x[c]).astype(np.int64) << k
    return c - REACH - 1, left, right


def joined(texts: list[str | None], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts, one text after the other, with zeros between; and where each text begins."""
    cut = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    h = np.fromiter(map(words.__getitem__, itertools.chain.from_iterable(cut)), np.uint64, total)
    out = np.zeros(total, np.uint64)
    n = total - SHINGLE + 1
    if n > 0:
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                out[:n] = (out[:n] ^ h[k : k + n]) * _ODD[0]
                out[:n] ^= out[:n] >> np.uint64(29)
        for k in range(1, SHINGLE):  # shingles that would go beyond their text's end
            out[(begin + sizes - k)[sizes >= k]] = 0
    return out, begin


def packed(f, c, left, right):
    """One number for a window's function and place."""
    return f << 56 | c << 16 | left << 8 | right


#: The parts of :func:`packed`, in SQL; ``c`` is the place of the centre.
PARTS = {"f": "shiftright({0}, 56)", "c": "shiftright({0}, 16) & 1099511627775", "l": "shiftright({0}, 8) & 255", "r": "{0} & 255"}


def part(name: str, of: str = "at") -> Column:
    kind = "tinyint" if name == "f" else "bigint"
    return F.expr(f"cast({PARTS[name].format(of)} as {kind})")


def windows(docs: DataFrame, passage: int = PASSAGE, hashes: int = HASHES) -> DataFrame:
    """Rows (key, doc_id, at): min-hash, and its function and window as :func:`packed`."""
    least = passage - SHINGLE + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            s, begin = joined(pdf["text"].tolist(), words)
            ids = pdf["doc_id"].to_numpy(np.int64)
            for f in range(hashes):
                h = np.where(s == 0, np.uint64(0), rehash(s, f))
                c, left, right = compact_windows(h, least)
                with np.errstate(over="ignore"):
                    key = (h[c] + np.uint64(f)) * _ODD[3]
                text = np.searchsorted(begin, c, side="right") - 1
                yield pd.DataFrame({"key": key.view(np.int64), "doc_id": ids[text], "at": packed(f, c - begin[text], left, right)})

    return map_slices(docs.select("doc_id", "text"), run, "key bigint, doc_id bigint, at bigint")


def _spread(ranges, size: int) -> np.ndarray:
    """Places, as flags, that lie in any of the ranges, from a to b."""
    edge = np.zeros(size + 1, np.int64)
    for x in ranges:
        edge[min(x["a"], size)] += 1
        edge[min(x["b"] + 1, size)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _slice(s: np.ndarray, ranges) -> np.ndarray:
    """The different shingles within any of the ranges."""
    return np.unique(s[_spread(ranges, len(s))])


def repeated(shared: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """(first, end) of stretches of at least ``least`` places, shared but for what ``similarity`` allows.

    For two passages of n shingles with x in common the Jaccard similarity is x / (2n - x).
    """
    need = 2 * similarity / (1 + similarity)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], shared.view(np.int8), [0]))))
    out: list[list[int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and out[-1][2] + b - a >= need * (b - out[-1][0]):
            out[-1][1:] = [b, out[-1][2] + b - a]
        else:
            out.append([a, b, b - a])
    return [(a, b) for a, b, _ in out if b - a >= least]


def stretches(shared: DataFrame, least: int, hashes: int, min_hashes: int) -> DataFrame:
    """Rows (key, n, doc_id, a, b): runs of stretches that have the same min-hashes in ``n`` functions.

    ``shared`` holds the windows (key, doc_id, at) whose min-hash occurs elsewhere; a run's
    stretches of ``least`` places begin at a to b.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["doc_id"]):
            start, size = group_bounds(pdf, ["doc_id"])
            base = np.repeat(np.arange(len(start)), size) << 32
            c, left, right = (pdf[k].to_numpy(np.int64) for k in "clr")
            lo, hi = base + np.maximum(c - left, c - least + 1), base + np.minimum(c, c + right - least + 1)
            f, key = pdf["f"].to_numpy(), pdf["key"].to_numpy(np.int64).view(np.uint64)
            cuts = np.unique(np.concatenate([lo, hi + 1]))
            at, end = cuts[:-1], cuts[1:]
            held, keys = np.zeros((hashes, len(at)), bool), np.zeros((hashes, len(at)), np.uint64)
            for k in range(hashes):
                mine = np.flatnonzero(f == k)
                if len(mine):
                    mine = mine[np.argsort(lo[mine])]
                    over = mine[np.maximum(np.searchsorted(lo[mine], at, side="right") - 1, 0)]
                    held[k], keys[k] = (lo[over] <= at) & (at <= hi[over]), key[over]
            for n in range(min_hashes, hashes + 1):
                for chosen in itertools.combinations(range(hashes), n):
                    i = np.flatnonzero(held[list(chosen)].all(axis=0))
                    if not len(i):
                        continue
                    mixed = np.full(len(i), n, np.uint64)
                    with np.errstate(over="ignore"):
                        for k in chosen:
                            mixed = (mixed ^ keys[k, i]) * _ODD[4]
                            mixed ^= mixed >> np.uint64(29)
                    new = np.concatenate(([True], (mixed[1:] != mixed[:-1]) | (at[i[1:]] != end[i[:-1]])))
                    first, last = i[new], i[np.append(np.flatnonzero(new)[1:], len(i)) - 1]
                    yield pd.DataFrame({"key": mixed[new].view(np.int64), "n": n, "doc_id": pdf["doc_id"].to_numpy(np.int64)[start[at[first] >> 32]], "a": at[first] & 0xFFFFFFFF, "b": (end[last] - 1) & 0xFFFFFFFF})

    rows = shared.select("key", "doc_id", "at").repartition("doc_id").sortWithinPartitions("doc_id")
    rows = rows.select("key", "doc_id", *(part(k).alias(k) for k in "fclr"))
    return rows.mapInPandas(run, "key bigint, n int, doc_id bigint, a bigint, b bigint")


def exact_repeats(runs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Rows (doc_id, source_id, a): stretches of ``least`` shingles that stand, word by word, in an earlier place.

    ``runs`` (doc_id, a, b) says where stretches begin that may do so; repeats in one text do not overlap.
    """
    factor, inverse = int(_ODD[5]), pow(int(_ODD[5]), -1, 1 << 64)

    def powers(x: int, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64))))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            ids, at, keys = [], [], []
            for i, text, ranges in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                s = shingles(text, words)
                begin = np.flatnonzero(_spread(ranges, len(s) - least + 1))
                if not len(begin):
                    continue
                with np.errstate(over="ignore"):
                    total = np.concatenate(([np.uint64(0)], np.cumsum(rehash(s, 3) * powers(factor, len(s) - 1))))
                    h = (total[begin + least] - total[begin]) * powers(inverse, len(s))[begin]
                keys.append(h)
                at.append(begin)
                ids.append(np.full(len(begin), i))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "doc_id": np.concatenate(ids), "a": np.concatenate(at)})

    places = runs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    texts = rows.join(stored(runs.select("doc_id").distinct()), "doc_id", "left_semi")
    found = stored(map_slices(places.join(texts, "doc_id"), hashed, "key bigint, doc_id bigint, a bigint"))
    again = _linked(found, "a").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("a") >= F.col("first.a") + least + SHINGLE - 1))
    return again.select("doc_id", F.col("first.doc_id").alias("source_id"), "a")


def _linked(members: DataFrame, *place: str) -> DataFrame:
    """``members`` (key, doc_id, ...) whose key occurs more than once, with ``first``: the smallest (doc_id, *place)."""
    first = members.groupBy("key").agg(F.min(F.struct("doc_id", *place)).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("key", "first"))  # a plain side, so that a hot key can be split in the join
    out = stored(members.join(first, "key"))
    discard(first, members)
    return out


def _range(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("a"), last.cast("int").alias("b"))


def _by_windows(shared: DataFrame, min_hashes: int) -> DataFrame:
    """Rows (doc_id, source_id, mine, theirs): documents whose windows lead to one first document in enough functions."""
    apart = shared.where("doc_id <> first.doc_id or at <> first.at").select("doc_id", "first", *(part(k).alias(k) for k in "fclr"), *(part(k, "first.at").alias(k * 2) for k in "clr"))
    own = F.col("doc_id") == F.col("first.doc_id")
    middle = ((F.col("c") + F.col("cc")) / 2).cast("int")  # repeats in one text must not meet themselves
    left, right = F.col("c") - F.col("l"), F.col("cc") + F.col("rr")
    mine = _range(F.when(own, F.greatest(left, middle + 1)).otherwise(left), F.col("c") + F.col("r"))
    theirs = _range(F.col("cc") - F.col("ll"), F.when(own, F.least(right, middle)).otherwise(right))
    pairs = apart.select("doc_id", F.col("first.doc_id").alias("source_id"), "f", mine.alias("mine"), theirs.alias("theirs")).groupBy("doc_id", "source_id")
    return pairs.agg(F.collect_set("f").alias("fs"), F.collect_list("mine").alias("mine"), F.array_sort(F.collect_set("theirs")).alias("theirs")).where(F.size("fs") >= min_hashes).drop("fs")


def _by_stretches(linked: DataFrame, least: int) -> DataFrame:
    """Rows (doc_id, source_id, mine, theirs): documents linked by the min-hashes of whole stretches."""
    own = F.col("doc_id") == F.col("first.doc_id")
    later = linked.where(~own | (F.col("a") != F.col("first.a")))
    halfway = ((F.col("a") + F.col("b") + F.col("first.a") + F.col("first.b")) / 4 + (least - 1) / 2).cast("int")
    ends = F.col("first.b") + least - 1
    mine = _range(F.when(own, F.greatest(F.col("a"), halfway + 1)).otherwise(F.col("a")), F.col("b") + least - 1)
    theirs = _range(F.col("first.a"), F.when(own, F.least(ends, halfway)).otherwise(ends))
    pairs = later.select("doc_id", F.col("first.doc_id").alias("source_id"), mine.alias("mine"), theirs.alias("theirs")).groupBy("doc_id", "source_id")
    return pairs.agg(F.collect_list("mine").alias("mine"), F.array_sort(F.collect_set("theirs")).alias("theirs"))


def verified(rows: DataFrame, pairs: DataFrame, repeats: DataFrame | None, passage: int, similarity: float) -> DataFrame:
    """Rows (doc_id, a, b, start, end, source_id): passages that ``pairs`` really share, in words and code points.

    ``pairs`` (doc_id, source_id, mine, theirs) name ranges of shingles, ``repeats`` (doc_id,
    source_id, exact) places known to repeat exactly.  A source's text goes with at most
    ``SETS`` of the sets of ranges asked of it, so a popular source is dealt to many tasks.
    """
    least = passage - SHINGLE + 1
    involved = pairs.select("doc_id").union(pairs.select("source_id"))
    if repeats is not None:
        involved = involved.union(repeats.select("doc_id"))
    texts = rows.join(stored(involved.distinct()), "doc_id", "left_semi")  # Spark knows the stored size, and broadcasts few ids
    keyed = pairs.withColumn("theirs_key", F.xxhash64("theirs"))
    wanted = keyed.select("source_id", "theirs_key", "theirs").dropDuplicates(["source_id", "theirs_key"])
    counts = wanted.groupBy("source_id").agg(F.count("*").alias("n"))
    dealt = wanted.join(counts, "source_id").withColumn("part", F.pmod("theirs_key", F.ceil(F.col("n") / SETS)))
    dealt = dealt.groupBy("source_id", "part").agg(F.collect_list(F.struct("theirs_key", "theirs")).alias("asked"))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            ids, keys, held = [], [], []
            for i, text, asked in zip(pdf["source_id"], pdf["text"], pdf["asked"], strict=True):
                s = shingles(text, words).astype(np.uint32)
                for x in asked:
                    ids.append(i)
                    keys.append(x["theirs_key"])
                    held.append(_slice(s, x["theirs"]).tobytes())
            yield pd.DataFrame({"source_id": ids, "theirs_key": keys, "held": held})

    held = map_slices(dealt.join(texts.withColumnRenamed("doc_id", "source_id"), "source_id"), slices, "source_id bigint, theirs_key bigint, held binary")
    evidence = keyed.join(held, ["source_id", "theirs_key"]).select("doc_id", F.struct("source_id", "mine", "held").alias("near"), F.lit(None).cast("struct<source_id: bigint, exact: array<bigint>>").alias("same"))
    if repeats is not None:
        evidence = evidence.unionByName(repeats.select("doc_id", F.lit(None).cast(evidence.schema["near"].dataType).alias("near"), F.struct("source_id", "exact").alias("same")))
    evidence = evidence.groupBy("doc_id").agg(F.collect_list("near").alias("near"), F.collect_list("same").alias("same"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            out = []
            for i, text, near, same in zip(pdf["doc_id"], pdf["text"], pdf["near"], pdf["same"], strict=True):
                short = shingles(text, words).astype(np.uint32)
                spans = []
                for e in same:
                    at = np.asarray(e["exact"], np.int64)
                    cut = np.flatnonzero(np.diff(at) > 1)
                    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
                    spans += [(a, b + passage, e["source_id"]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                for e in near:
                    shared = np.isin(short, np.frombuffer(e["held"], np.uint32)) & _spread(e["mine"], len(short))
                    spans += [(a, b + SHINGLE - 1, e["source_id"]) for a, b in repeated(shared, least, similarity)]
                if spans:
                    out += _placed(i, text, spans)
            yield pd.DataFrame(out, columns=["doc_id", "a", "b", "start", "end", "source_id"])

    return map_slices(evidence.join(texts, "doc_id"), verify, "doc_id bigint, a bigint, b bigint, start bigint, end bigint, source_id bigint")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, hashes: int = HASHES, min_hashes: int = MIN_HASHES, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, start, end, words, source_id): passages that an earlier document or place has too.

    ``start`` and ``end`` are code points; ``source_id`` is the smallest document found to hold
    the passage.  A text equal to an earlier one is one span.  Null, empty and short texts, and
    rows whose doc_id is null, have no spans; rows that repeat a doc_id count once (the one
    with the smallest text).  Long texts are read whole, ties go to the smaller doc_id, other
    columns are ignored.  An empty table gives none.
    """
    least = passage - SHINGLE + 1
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if _repeats(rows):
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    shared = _linked(stored(windows(rows, passage, hashes)), "at")
    pairs = stored(_by_windows(shared, min_hashes))
    found = stored(verified(rows, pairs, None, passage, similarity))
    discard(pairs)

    known = found.groupBy("doc_id").agg(F.collect_list(_range(F.col("a"), F.col("b"))).alias("known"))
    covered = F.exists("known", lambda x: (F.col("c") >= x["a"]) & (F.col("c") < x["b"]))
    left = shared.where("doc_id <> first.doc_id or at <> first.at").select("key", "doc_id", part("c").alias("c"))
    left = left.join(known, "doc_id", "left").where(F.col("known").isNull() | ~covered).select("key").distinct()
    runs = stored(stretches(shared.join(left, "key", "left_semi"), least, hashes, min(hashes, max(min_hashes, hashes - 1))))
    discard(shared)
    linked = _linked(runs, "a", "b")
    repeats = exact_repeats(linked.where(F.col("n") == hashes).select("doc_id", "a", "b"), rows, least)
    repeats = stored(repeats.groupBy("doc_id", "source_id").agg(F.array_sort(F.collect_set("a")).alias("exact")))
    more = verified(rows, stored(_by_stretches(linked, least)), repeats, passage, similarity)
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    spans = found.unionByName(more).withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.count_if(F.coalesce(F.col("reach") < F.col("a"), F.lit(True))).over(order))
    whole = spans.groupBy("doc_id", "island").agg(*(F.min(k).alias(k) for k in ("a", "start", "source_id")), *(F.max(k).alias(k) for k in ("b", "end")))
    return whole.select("doc_id", "start", "end", (F.col("b") - F.col("a")).alias("words"), "source_id")


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id stands in more than one row (ids only are read)."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _placed(doc_id: int, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Overlapping spans of words as one, in words and in code points."""
    at = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for a, b, source in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1:] = [max(b, merged[-1][1]), min(source, merged[-1][2])]
        else:
            merged.append([a, b, source])
    return [(doc_id, a, b, at[a][0], at[b - 1][1], source) for a, b, source in merged]


def cut_passages(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the passages that an earlier document has; ``n_chars`` follows the text.

    The first occurrence stays.  A document of which nothing but white space is left goes; null
    and empty texts stay as they are.
    """
    spans = repeated_passages(docs, **settings)
    by_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans__")).withColumnRenamed("doc_id", "__id__")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            parts, at = [], 0
            for x in found if text is not None and found is not None else ():
                parts.append(text[at : x["start"]].rstrip())
                at = x["end"]
            out.append(text if not parts else "".join([*parts, text[at:]]).strip())
        return pd.Series(out, dtype=object)

    joined = docs.join(by_doc, docs["doc_id"] == by_doc["__id__"], "left").withColumn("__whole__", F.col("__spans__").isNull())
    kept = joined.where("__whole__").select(*docs.columns)
    changed = joined.where("not __whole__").withColumn("text", cut("text", "__spans__")).where("text <> ''")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.unionByName(changed.select(*docs.columns))
