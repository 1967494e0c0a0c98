"""Hybrid retrieval: TF-IDF cosine and BM25 over a library, fused by reciprocal ranks.

Blocks of queries meet chunks of the library's postings in groups or, where the postings are stored
and small, all of them inside the tasks that read the queries.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions.text import tokens
from clauseloom.sources import storage


def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, term, tf)."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, size: int = L.VOCABULARY) -> DataFrame:
    """Rows (term, df, idf) of the ``size`` most widespread terms; ties by term.

    ``counts`` has a row for each document of a term, or a column df; ``n_docs`` has one row (n): the
    number of documents, without words or not.
    """
    df = counts.select("term", "df") if "df" in counts.columns else counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.orderBy(F.desc("df"), "term").limit(size).crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (id, term, weight), of length 1 for each id; words outside the vocabulary count for nothing."""
    raw = counts.join(vocab, "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def bm25_terms(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Rows (id, term, weight): what one query token adds to a document's Okapi score."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    idf = df.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, L.BM25_FLOOR * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    sizes = counts.groupBy("id").agg(F.sum("tf").alias("dl"))
    average = sizes.agg(F.sum("dl").alias("total")).crossJoin(F.broadcast(n_docs)).select((F.col("total") / F.col("n")).alias("avgdl"))
    spread = 1 - L.BM25_B + L.BM25_B * F.col("dl") / F.col("avgdl")
    own = counts.join(sizes, "id").join(idf, "term").crossJoin(F.broadcast(average))
    return own.select("id", "term", (F.col("idf") * F.col("tf") * (L.BM25_K1 + 1) / (F.col("tf") + L.BM25_K1 * spread)).alias("weight"))


def postings(library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (term, test, wd, ws), vocabulary (term, df, idf)) of a library (id, text).

    ``wd`` is a term's weight in the test's TF-IDF vector, 0 outside the vocabulary, and ``ws``
    what each occurrence of it in a query adds to the test's BM25 score.
    """
    n = library.agg(F.count("*").alias("n"))
    tests = term_counts(library, "id", "text")
    vocab = vocabulary(tests, n)
    dense = tfidf(tests, vocab).withColumnRenamed("weight", "wd")
    both = bm25_terms(tests, n).withColumnRenamed("weight", "ws").join(dense, ["id", "term"], "left")
    return both.select("term", F.col("id").alias("test"), F.coalesce("wd", F.lit(0.0)).alias("wd"), "ws"), vocab


def order_of(library: DataFrame) -> DataFrame:
    """Rows (test, above): how many tests have a higher id.  Only ids, of the library alone, are sorted."""
    return library.select(F.col("id").alias("test"), (F.row_number().over(Window.orderBy(F.desc("id"))) - 1).alias("above"))


#: Bytes of postings up to which they are sent to every executor, and what one takes at most; a term takes four bytes of text at least.
HELD, POSTING = 64 << 20, 48


def search(queries: DataFrame, library: DataFrame, k: int = L.TOP_K, most: int | None = None) -> DataFrame:
    """Rows (q, rank, test, dense, sparse, fused): the ``k`` best tests of each query that is not blank.

    Each channel ranks all tests of the library (id, text) by (score, test) downwards, and the sum
    of 1 / (FUSION + rank) over both decides; equal sums go by test.  ``most`` bytes of postings
    are held by each task, none by default.
    """
    if not most:  # by blocks and chunks; to hold postings that are not stored, they would be worked out first
        return search_texts(queries, library, k)
    found, vocab = postings(library)
    size = library.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return search_postings(queries, found, vocab, order_of(library), POSTING * size // 4, k, most)


def search_postings(queries: DataFrame, found: DataFrame, vocab: DataFrame, order: DataFrame, size: int, k: int = L.TOP_K, most: int | None = None) -> DataFrame:
    """:func:`search` over the postings of an index of ``size`` bytes: held by each task up to ``most``, else joined."""
    return (search_held if size <= (HELD if most is None else most) else search_joined)(queries, found, vocab, order, k)


#: Tests of a chunk and different queries of a block, which meet in one group.
CHUNK, BLOCK = 16_384, 1_024


def search_joined(queries: DataFrame, found: DataFrame, vocab: DataFrame, order: DataFrame, k: int = L.TOP_K, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """:func:`search` over postings, which are gathered by test: see :func:`_by_chunks`."""
    asked, n_chunks = _asked(queries), max(1, -(-order.count() // chunk))
    if n_chunks > 1:  # words that no query has are of no use
        found = found.join(asked.select(F.explode("bag").alias("term")).distinct(), "term", "left_semi")
    own = found.groupBy("test").agg(F.sort_array(F.collect_list(F.struct("term", "wd", "ws"))).alias("own"))
    tests = order.select("test").join(own, "test", "left").withColumn("chunk", _part("test", n_chunks))
    alike = tests.groupBy("chunk", "own").agg(F.collect_list("test").alias("tests"))
    right = alike.select("chunk", "tests", *(F.coalesce(f"own.{c}", F.array().cast(f"array<{t}>")).alias(c) for c, t in (("term", "string"), ("wd", "double"), ("ws", "double"))))
    idf = {r.term: r.idf for r in vocab.select("term", "idf").collect()}  # at most VOCABULARY rows
    return _by_chunks(asked, right, idf, n_chunks, k, block)


#: Words of the queries that the library has too, up to which every task holds them all; words of a library that need no look at the queries.
WORDS, FEW = 1 << 18, 1 << 16
#: Texts whose weights a task holds at once.
TEXTS = 256


def search_texts(queries: DataFrame, library: DataFrame, k: int = L.TOP_K, chunk: int = CHUNK, block: int = BLOCK, most: int = WORDS) -> DataFrame:
    """:func:`search` of texts that have no postings yet.  They are read twice: to count the texts of
    each term, and to weigh the terms that the queries have, text by text, so no term of a text is a row.

    Queries of more than ``most`` different words of the library go by :func:`postings` and joins, and
    so does a library in which an id has several texts, which are one there.
    """
    if not library.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty():
        return search_joined(queries, *postings(library), order_of(library), k, chunk, block)
    asked, bags = _asked(queries), library.select(F.col("id").alias("test"), tokens("text").alias("bag"))
    each = bags.select(F.explode(F.concat(F.array_distinct("bag"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("bag").alias("dl"))
    every, path = storage.stored(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
    whole, terms = every.where("term is null").select(F.col("df").alias("n"), "dl"), every.where("term is not null")  # no term: all texts
    n, total = whole.first() or (0, 0)
    vocab = vocabulary(terms, whole.select("n")).select("term", "idf")
    bm25 = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = terms.agg(F.avg(bm25)).first()[0] or 0.0
    if n > chunk or terms.count() > FEW:  # the words of a small library are all held, which saves a pass over the queries
        terms = terms.join(asked.select(F.explode("bag").alias("term")).distinct(), "term", "left_semi")
    common = terms.select("term", F.when(bm25 < 0, L.BM25_FLOOR * mean).otherwise(bm25).alias("idf"))
    idf, shared = ({r.term: r.idf for r in df.collect()} for df in (vocab, common.limit(most + 1)))
    storage.remove(library.sparkSession, path)
    if len(shared) > most:
        return search_joined(queries, *postings(library), order_of(library), k, chunk, block)
    sent, average, name = library.sparkSession.sparkContext.broadcast((idf, shared)), total / n if n else 0, bags.schema["test"].dataType
    weighed = f"test {name.simpleString()}, same binary, term array<string>, wd array<double>, ws array<double>"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            rows = [_weights(Counter(bag.split()), *sent.value, average) for bag in batch["bag"].to_pylist()]
            ends = pa.array([0, *accumulate(len(r[0]) for r in rows)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array([x for r in rows for x in r[i]], kind)) for i, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
            same = [hashlib.blake2b(repr(r[3]).encode(), digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch["test"], pa.array(same, pa.binary()), *lists], names=["test", "same", "term", "wd", "ws"])

    n_chunks = max(1, -(-n // chunk))
    tests = bags.select("test", F.array_join("bag", " ").alias("bag")).mapInArrow(weigh, weighed).withColumn("chunk", _part("test", n_chunks))
    right = tests.groupBy("chunk", "same").agg(F.collect_list("test").alias("tests"), *(F.first(c).alias(c) for c in ("term", "wd", "ws"))).drop("same")
    if n_chunks > 1:  # both passes read them
        right, _ = storage.stored(right)
    return _by_chunks(asked, right, idf, n_chunks, k, block)


def _weights(counts: Counter, idf: dict[str, float], shared: dict[str, float], average: float) -> tuple[list[str], list[float], list[float], tuple]:
    """(terms of a text that are ``shared``, their TF-IDF weights, their BM25 weights, all that these depend on), by term."""
    few = sorted(counts.keys() & shared.keys())
    tf, size = [counts[t] for t in few], counts.total()
    norm = math.sqrt(math.fsum(((1 + math.log(c)) * idf[t]) ** 2 for t, c in counts.items() if t in idf)) or 1.0
    spread = L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * size / average) if size else 0.0
    wd = [(1 + math.log(c)) * idf.get(t, 0.0) / norm for t, c in zip(few, tf, strict=True)]
    return few, wd, [shared[t] * c * (L.BM25_K1 + 1) / (c + spread) for t, c in zip(few, tf, strict=True)], (few, tf, norm, size)


def _asked(queries: DataFrame) -> DataFrame:
    """Rows (q, bag, kind) of the queries that are not blank; those with the same words are of one kind."""
    bags = queries.where(F.trim("text") != "").select(F.col("id").alias("q"), F.array_sort(tokens("text")).alias("bag"))
    return bags.withColumn("kind", F.sha2(F.array_join("bag", " "), 256))


def _part(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _by_chunks(asked: DataFrame, tests: DataFrame, weights: dict[str, float], n_chunks: int, k: int, block: int) -> DataFrame:
    """:func:`search` by blocks of queries and chunks of the library, each pair in a group of its own.

    ``asked`` is of :func:`_asked`; ``tests`` has rows (chunk, tests, term, wd, ws), the tests of a chunk
    with the same postings being one row, and ``weights`` is the vocabulary's.  Queries of a kind are one
    too; no pair of query and test is a row.  Where the library is one chunk, its group ranks all tests.
    Else a chunk gives its best ``FUSION + 2 * k + 1`` tests of each channel: the ``k`` best of one channel
    have a sum above 1 / (FUSION + k - 1), and a test below these places in both channels has not.
    A second pass counts, chunk by chunk, the tests that precede each of these in either channel.
    """
    n_blocks = max(1, -(-asked.agg(F.approx_count_distinct("kind")).first()[0] // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = tests.select("chunk", "tests", "term", "wd", "ws", every(n_blocks).alias("block"))
    kinds = asked.groupBy("kind").agg(F.first("bag").alias("bag")).withColumn("block", _part("kind", n_blocks))
    idf = asked.sparkSession.sparkContext.broadcast(weights)
    name, most = tests.schema["tests"].dataType.elementType.simpleString(), L.FUSION + 2 * k + 1

    def met(run, left: DataFrame, schema: str) -> DataFrame:
        by = left.withColumn("chunk", every(n_chunks)).groupBy("block", "chunk")
        return by.cogroup(right.groupBy("block", "chunk")).applyInPandas(run, f"kind string, test {name}, {schema}")

    def ranked(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out, held = [], _Chunk(two, idf.value)
        for kind, words in zip(one["kind"], one["bag"], strict=True) if len(two) else ():
            dense, sparse = held.scores(words)
            fused = sum(1 / (L.FUSION + _places(held.of_tests(s))) for s in (dense, sparse))
            few = np.flatnonzero(fused >= np.partition(fused, -k)[-k] - 1e-11) if len(fused) > k else np.arange(len(fused))
            few = few[np.lexsort((-few, -np.round(fused[few], 12)))][:k]  # tests are in falling order of ids
            out += [(kind, held.names[i], dense[c], sparse[c], fused[i]) for i, c in zip(few.tolist(), held.kind[few].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["kind", "test", "dense", "sparse", "fused"])

    def first(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out, held = [], _Chunk(two, idf.value)
        for kind, words in zip(one["kind"], one["bag"], strict=True) if len(two) else ():
            dense, sparse = held.scores(words)
            few = np.union1d(*(_first(held.of_tests(s), most) for s in (dense, sparse)))
            c = held.kind[few]
            out.append(pd.DataFrame({"kind": kind, "test": held.names[few], "dense": dense[c], "sparse": sparse[c]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["kind", "test", "dense", "sparse"])

    def counted(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out, held = [], _Chunk(two, idf.value)
        for kind, words, names, *given in zip(one["kind"], one["bag"], one["tests"], one["denses"], one["sparses"], strict=True) if len(two) else ():
            before = [held.before(own, g, names) for own, g in zip(held.scores(words), given, strict=True)]
            out.append(pd.DataFrame({"kind": kind, "test": names, "dense": given[0], "sparse": given[1], "p1": before[0], "p2": before[1]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["kind", "test", "dense", "sparse", "p1", "p2"])

    scores = "dense double, sparse double"
    if n_chunks == 1:
        fused = met(ranked, kinds, f"{scores}, fused double")
    else:
        place = lambda c: F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.round(c, 9)), F.desc("test")))
        best = met(first, kinds, scores).withColumn("r1", place("dense")).withColumn("r2", place("sparse")).where(F.least("r1", "r2") <= most)
        listed = best.groupBy("kind").agg(F.collect_list(F.struct("test", "dense", "sparse")).alias("c")).select("kind", *(F.col(f"c.{c}").alias(f"{c}s") for c in ("test", "dense", "sparse")))
        sums = met(counted, kinds.join(listed, "kind"), f"{scores}, p1 bigint, p2 bigint").groupBy("kind", "test", "dense", "sparse").agg(F.sum("p1").alias("p1"), F.sum("p2").alias("p2"))
        fused = sums.withColumn("fused", 1 / (L.FUSION + F.col("p1")) + 1 / (L.FUSION + F.col("p2")))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.round("fused", 12)), "test"))
    top = fused.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.select("q", "kind").join(top, "kind").select("q", "rank", "test", *_shown())


def _places(score: np.ndarray) -> np.ndarray:
    """The place of each score from above, from 0; equal ones in their order."""
    out = np.empty(len(score), np.int64)
    out[np.argsort(-score, kind="stable")] = np.arange(len(score))
    return out


def _first(score: np.ndarray, most: int) -> np.ndarray:
    """Where the ``most`` greatest scores are; of equal ones the first."""
    if len(score) <= most:
        return np.arange(len(score))
    least = np.partition(score, -most)[-most]
    over = np.flatnonzero(score > least)
    return np.concatenate([over, np.flatnonzero(score == least)[: most - len(over)]])


class _Chunk:
    """Tests of a chunk in falling order of ids, and the postings of their kinds (tests, term, wd, ws)."""

    def __init__(self, rows: pd.DataFrame, idf: dict[str, float]):
        self.idf, self.n = idf, len(rows)
        if not len(rows):
            return
        names, kind = np.concatenate(rows["tests"].tolist()), np.repeat(np.arange(self.n), rows["tests"].map(len))
        falling = np.argsort(names, kind="stable")[::-1]
        self.names, self.kind, self.size = names[falling], kind[falling], np.bincount(kind, minlength=self.n)
        code, terms = pd.factorize(np.concatenate(rows["term"].tolist()))
        by_term = np.argsort(code, kind="stable")
        self.at = np.repeat(np.arange(self.n), rows["term"].map(len))[by_term]
        self.wd, self.ws = (np.concatenate(rows[c].tolist()).astype(np.float64)[by_term] for c in ("wd", "ws"))
        ends = np.cumsum(np.bincount(code, minlength=len(terms))).tolist()
        self.lists = {t: (s, e) for t, s, e in zip(terms, [0, *ends], ends, strict=False)}

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(dense, sparse) scores of each kind of test for a query of ``words``."""
        counts = Counter(words)
        weight = {t: (1 + math.log(c)) * self.idf.get(t, 0.0) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
        held = [(*self.lists[t], weight[t] / norm, c) for t, c in counts.items() if t in self.lists]
        if not held:
            return np.zeros(self.n), np.zeros(self.n)
        rows = np.concatenate([np.arange(s, e) for s, e, _, _ in held])
        w, tf = (np.repeat([h[i] for h in held], [h[1] - h[0] for h in held]) for i in (2, 3))
        return np.bincount(self.at[rows], w * self.wd[rows], self.n), np.bincount(self.at[rows], tf * self.ws[rows], self.n)

    def of_tests(self, score: np.ndarray) -> np.ndarray:
        """The rounded score of every test, of those of each kind."""
        return np.round(score, 9)[self.kind]

    def before(self, score: np.ndarray, given: np.ndarray, names: np.ndarray) -> np.ndarray:
        """How many tests of the chunk precede each of some tests with the scores ``given``."""
        kinds, given = np.round(score, 9), np.round(given, 9)
        values, where = np.unique(kinds, return_inverse=True)
        size = np.bincount(where, self.size, len(values)).astype(np.int64)
        over = np.append(np.cumsum(size[::-1])[::-1], 0)
        out = over[np.searchsorted(values, given, side="right")]
        higher = len(self.names) - np.searchsorted(self.names[::-1], names, side="right")
        for v in np.intersect1d(given, values):
            tied, at = np.append(0, np.cumsum((kinds == v)[self.kind])), given == v
            out[at] += tied[higher[at]]
        return out


def _shown() -> list[Column]:
    return [F.round("dense", 3).alias("dense"), F.round("sparse", 3).alias("sparse"), F.round("fused", 5).alias("fused")]


def search_held(queries: DataFrame, found: DataFrame, vocab: DataFrame, order: DataFrame, k: int = L.TOP_K) -> DataFrame:
    """:func:`search` where every task holds the postings: a row for each result, none for other pairs.

    A query's scores of all tests are two arrays; both channels are ranked in full, so the sums
    are exact.  The caller bounds the size of the postings.
    """
    tests = [r.test for r in order.orderBy("above").collect()]
    rows = found.select("term", "test", "wd", "ws").toArrow().to_pandas().sort_values("term", kind="stable")
    at, ends = rows["test"].map({t: i for i, t in enumerate(tests)}).to_numpy(np.int32), np.flatnonzero(np.append(rows["term"].to_numpy()[1:] != rows["term"].to_numpy()[:-1], True)) + 1
    begin = np.concatenate(([0], ends[:-1]))
    lists = {t: (at[s:e], rows["wd"].to_numpy()[s:e], rows["ws"].to_numpy()[s:e]) for t, s, e in zip(rows["term"].to_numpy()[begin] if len(rows) else [], begin.tolist(), ends.tolist(), strict=len(rows) > 0)}
    sent = queries.sparkSession.sparkContext.broadcast((tests, lists, {r.term: r.idf for r in vocab.select("term", "idf").collect()}))
    kinds = dict(queries.dtypes)["id"], dict(order.dtypes)["test"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, terms, idf = sent.value
        n, few = len(names), min(k, len(names))
        by_name = np.argsort(np.array(names, dtype=object), kind="stable")
        rank_of_name = np.empty(n, np.int64)
        rank_of_name[by_name] = np.arange(n)
        for pdf in frames:
            out = []
            for q, words in zip(pdf["q"], pdf["terms"], strict=True):
                counts = Counter(words)
                weight = {t: (1 + math.log(c)) * idf.get(t, 0.0) for t, c in counts.items()}
                norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
                dense, sparse = np.zeros(n), np.zeros(n)
                for t, c in counts.items():
                    if t in terms:
                        at, wd, ws = terms[t]
                        dense[at] += weight[t] / norm * wd
                        sparse[at] += c * ws
                fused = np.zeros(n)
                for score in (dense, sparse):  # tests are in falling order of ids, and the sort is stable
                    ranks = np.empty(n, np.int64)
                    ranks[np.argsort(-np.round(score, 9), kind="stable")] = np.arange(n)
                    fused += 1 / (L.FUSION + ranks)
                best = np.lexsort((rank_of_name, -np.round(fused, 12)))[:few]
                out += [(q, r, names[i], dense[i], sparse[i], fused[i]) for r, i in enumerate(best.tolist(), 1)]
            yield pd.DataFrame(out, columns=["q", "rank", "test", "dense", "sparse", "fused"])

    asked = queries.where(F.trim("text") != "").select(F.col("id").alias("q"), tokens("text").alias("terms"))
    rows = asked.mapInPandas(run, f"q {kinds[0]}, rank int, test {kinds[1]}, dense double, sparse double, fused double")
    return rows.select("q", "rank", "test", *_shown())


def _unit(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that have a direction and ``size`` numbers, those vectors with length 1)."""
    held = [np.asarray(v) if v is not None and len(v) == size and all(x is not None for x in v) else None for v in vectors]  # as wide as they come
    good = np.array([v is not None and bool(np.isfinite(v).all()) and bool(v.any()) for v in held], bool)
    m = np.stack([v for v, g in zip(held, good, strict=True) if g]).astype(np.float64) if good.any() else np.empty((0, size))
    return np.flatnonzero(good), m / np.linalg.norm(m, axis=1, keepdims=True)


#: Queries of a block whose products with a chunk are held at once: 64 times 16,384 doubles are 8 MB, twice.
_AT_A_TIME = 64


def _products(one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of ``one @ two.T``, rounded, of which few exist at a time."""
    for i in range(0, len(one), _AT_A_TIME):
        yield from np.round(one[i : i + _AT_A_TIME] @ two.T, 6)


def nearest(asked: DataFrame, rows: DataFrame, k: int, block: int = 2_048, chunk: int = 16_384) -> DataFrame:
    """Rows (q, rank, vec_id, score): the ``k`` other vectors of the greatest cosine; ties by vec_id.

    Both sides have (vec_id, embedding).  Blocks of about ``block`` stated queries meet chunks of
    about ``chunk`` rows, each pair in a group of its own: matrix products of at most ``_AT_A_TIME``
    queries, of which the ``k`` best of every query go on.  Norms are worked out once a vector and group.  Vectors that are
    null, zero or not finite have no neighbours and are none; lengths only meet their own.
    """
    n_blocks, n_chunks = (-(-max(1, df.count()) // size) for df, size in ((asked, block), (rows, chunk)))
    size = F.size("embedding").alias("size")
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "embedding", size, part(n_blocks, 1).alias("block"), every(n_chunks).alias("chunk"))
    right = rows.select("vec_id", "embedding", size, part(n_chunks, 2).alias("chunk"), every(n_blocks).alias("block"))
    kind = dict(rows.dtypes)["vec_id"]

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": one["vec_id"].iloc[:0], "vec_id": two["vec_id"].iloc[:0], "score": np.empty(0)})]
        if len(one) and len(two) and one["size"].iloc[0] > 0:
            (qat, qm), (at, m) = (_unit(df["embedding"].tolist(), int(one["size"].iloc[0])) for df in (one, two))
            ids, own = one["vec_id"].to_numpy()[qat], two["vec_id"].to_numpy()[at]
            for q, row in zip(ids, _products(qm, m), strict=True):
                few = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1]) if len(row) > k + 1 else np.arange(len(row))
                few = few[own[few] != q]
                few = few[np.lexsort((own[few], -row[few]))][:k]
                out.append(pd.DataFrame({"q": q, "vec_id": own[few], "score": row[few]}))
        return pd.concat(out)

    keys = ["block", "chunk", "size"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"q {kind}, vec_id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", place).where(F.col("rank") <= k).select("q", "rank", "vec_id", "score")
