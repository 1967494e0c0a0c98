"""Toxicity classifier regularised by counterfactual identity swaps.

A logistic model over the distinct words (and word beginnings) of a text.  For every training text that names a
group, copies with the term swapped for the other terms of its family are scored too, and the
squared change of the score is added to the loss, so a mention by itself carries no weight.
Only the fit uses a bounded sample of labelled rows (``max_rows``); scoring covers whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of

#: Families of identity terms whose members are swapped for each other.
IDENTITY_TERMS = {
    "gender": ("women", "men", "girls", "boys", "woman", "man", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "muslim", "christian", "jewish", "musulmans", "chrétiens", "juifs", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos"),
    "origin": ("black", "white", "asian", "latino", "african", "european", "arab", "immigrants", "refugees", "natives", "immigrés", "einwanderer", "inmigrantes"),
    "orientation": ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    "ability": ("disabled", "blind", "deaf", "autistic", "able-bodied"),
    "age": ("elderly", "young", "teenagers", "seniors", "children"),
}
BUCKETS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = n = bucket(word)
        return n


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, and their beginnings as ``xxxxx*``."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:5] + "*" for w in words if len(w) > 5}


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    bias: float

    def score(self, words: set[str], known: dict[str, float]) -> float:
        z = self.bias + sum(map(known.__getitem__, words))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Weights(dict):
    """Weights by word, filled as words are met."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 50_000:
            self.clear()
        self[word] = w = self.model.weights.get(bucket(word), 0.0)
        return w


@dataclass
class Objective:
    """Logistic loss plus ``swap_weight`` times the mean squared change of the score under swaps.

    ``row`` and ``col`` say which features each text has, ``swaps`` (text, term out, term in,
    times) which copies are compared with it.  ``term_of`` and ``feature`` list the features of
    each term; the last term is one that no text has, whose weight is 0.
    """

    y: np.ndarray
    row: np.ndarray
    col: np.ndarray
    swaps: np.ndarray
    term_of: np.ndarray
    feature: np.ndarray
    terms: int
    swap_weight: float
    l2: float

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss at weights ``w`` (the last one is the bias), and its gradient."""
        n = len(self.y)
        s = 1 / (1 + np.exp(-(w[-1] + np.bincount(self.row, weights=w[self.col], minlength=n))))
        loss = -np.log(np.where(self.y > 0, s, 1 - s) + 1e-300).mean() + self.l2 * (w[:-1] ** 2).sum() / 2
        pull, grad = (s - self.y) / n, np.zeros_like(w)
        if len(self.swaps):
            i, a, b, times = self.swaps.T
            share = times / times.sum()
            held = np.bincount(self.term_of, weights=w[self.feature], minlength=self.terms)
            logit = w[-1] + np.bincount(self.row, weights=w[self.col], minlength=n)
            other = 1 / (1 + np.exp(-(logit[i] - held[a] + held[b])))
            loss += self.swap_weight * (share * (s[i] - other) ** 2).sum()
            gap = 2 * self.swap_weight * share * (s[i] - other)
            here, there = gap * s[i] * (1 - s[i]), gap * other * (1 - other)
            pull = pull + np.bincount(i, weights=here - there, minlength=n)
            turn = np.bincount(a, weights=there, minlength=self.terms) - np.bincount(b, weights=there, minlength=self.terms)
            grad += np.bincount(self.feature, weights=turn[self.term_of], minlength=len(w))
        grad[:-1] += np.bincount(self.col, weights=pull[self.row], minlength=len(w) - 1) + self.l2 * w[:-1]
        grad[-1] += pull.sum()
        return float(loss), grad


def objective(rows: list[tuple[np.ndarray, int]], swap_weight: float, l2: float, min_z: float, families: dict[str, tuple[str, ...]]) -> tuple[Objective, np.ndarray]:
    """The objective on ``rows`` (buckets of distinct words, label), and the bucket of each feature.

    A term is swapped for each other term of its family; one that no text has counts for
    nothing, so a term that stands alone in its family is held to what no mention would score.
    """
    y = np.array([t for _, t in rows], float)
    n, pos = len(y), float(y.sum())
    row = np.repeat(np.arange(n), [len(b) for b, _ in rows])
    col = np.concatenate([b for b, _ in rows])
    seen, hits = np.bincount(col, minlength=BUCKETS), np.bincount(col, weights=y[row], minlength=BUCKETS)
    p = pos / n
    z = (hits - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p), 1e-9))
    keep = (np.abs(z) >= min_z) & (seen >= 2)
    terms = [t for g in families.values() for t in g if seen[bucket(t)]]
    marks = [np.array([bucket(f) for f in words_of(t)]) for t in terms]  # a term and its beginning
    for f in marks:
        keep[f] = True
    chosen = np.flatnonzero(keep)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[col] >= 0
    row, col = row[used], place[col[used]]
    number = {t: k for k, t in enumerate(terms)}
    swaps = [np.empty((0, 4), int)]
    for g in families.values():
        own = [number[t] for t in g if t in number]
        for a in own:
            at = row[col == place[bucket(terms[a])]]
            into = [(b, 1) for b in own if b != a] + ([(len(terms), len(g) - len(own))] if len(g) > len(own) else [])
            swaps += [np.stack([at, *(np.full(len(at), v) for v in (a, b, times))], 1) for b, times in into]
    term_of = np.repeat(np.arange(len(terms)), [len(f) for f in marks])
    feature = place[np.concatenate(marks)] if marks else np.empty(0, int)
    return Objective(y, row, col, np.concatenate(swaps), term_of, feature, len(terms) + 1, swap_weight, l2), chosen


def fit(rows: list[tuple[np.ndarray, int]], swap_weight: float = 10.0, l2: float = 1e-5, min_z: float = 4.0, rounds: int = 400, families: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on rows (buckets of distinct words, label 0/1).  No rows or one class: a constant score."""
    pos = sum(t for _, t in rows)
    prior = (pos + 0.5) / (len(rows) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < pos < len(rows):
        return ToxicityModel({}, bias)
    of, chosen = objective(rows, swap_weight, l2, min_z, families)
    w = np.append(np.zeros(len(chosen)), bias)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = of(w)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel(dict(zip(chosen.tolist(), w[:-1].tolist(), strict=True)), float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_z: float = 4.0, families: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> list[tuple[np.ndarray, int]]:
    """At most about ``max_rows`` labelled texts, chosen by a hash of doc_id, as word buckets.

    Rows with a null doc_id or label are left out; a doc_id labelled more than once counts as
    toxic if any of its rows says so.  Buckets are counted where the texts are, and those that
    :func:`objective` drops by these counts are left out, so the driver holds no whole text's words.
    """
    wanted = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = wanted.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    share = min(1.0, max_rows / max(1, wanted.count()))
    wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _Buckets()
        for pdf in batches:
            found = [np.unique(np.fromiter((of[w] for w in words_of(t)), np.int32)).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"b": found, "toxic": pdf["toxic"]})

    # the chosen rows are bounded by max_rows, so they may be sent to every executor
    own = texts_of(docs).select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = stored(own.mapInPandas(run, "b binary, toxic int"))
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for b, t in zip(pdf["b"], pdf["toxic"], strict=True):  # a text's buckets differ
                b = np.frombuffer(b, np.int32)
                seen[b] += 1
                hits[b] += t
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "seen": seen[at], "hits": hits[at]})

    p = pos / max(1, n)
    mean, terms = F.col("seen") * p, sorted({bucket(f) for g in families.values() for t in g for f in words_of(t)})
    apart = F.abs(F.col("hits") - mean) / F.sqrt(F.greatest(mean * (1 - p), F.lit(1e-9))) >= min_z - 1e-6  # the objective decides
    counts = rows.mapInPandas(count, "bucket bigint, seen bigint, hits bigint").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits"))
    told = counts.where((F.col("seen") >= 2) & apart).select("bucket").toArrow()["bucket"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(np.union1d(told, terms).astype(np.int32))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = (np.frombuffer(b, np.int32) for b in pdf["b"])
            yield pd.DataFrame({"b": [b[np.isin(b, sent.value)].tobytes() for b in held], "toxic": pdf["toxic"]})

    return [(np.frombuffer(r["b"], np.int32), r["toxic"]) for r in rows.mapInPandas(keep, "b binary, toxic int").collect()]


def score_documents(docs: DataFrame, model: ToxicityModel, prefix: str = "") -> DataFrame:
    """Add (score double, predicted int), each name after ``prefix``, to ``docs``.

    Null and empty texts get the prior's score, long texts are scored whole, repeated rows stay
    rows, columns of these two names are replaced, and an empty table gives none.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Weights(model)
        for part in texts:
            yield pd.Series([model.score(words_of(t), known) for t in part], dtype="float64")

    kept = [c for c in docs.columns if c not in (f"{prefix}score", f"{prefix}predicted")]
    scored = texts_of(docs).select(*kept, score("text").alias(f"{prefix}score"))
    return scored.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= 0.5).cast("int"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, swap_weight: float = 10.0, families: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> ToxicityModel:
    """A model of at most ``max_rows`` labelled texts; ``families`` lists the terms that are swapped for each other."""
    return fit(training_rows(docs, labels, max_rows, families=families), swap_weight, families=families)
