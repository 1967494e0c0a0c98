"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees a text's words and shape, the metadata view its source, language and
stated size; neither sees what the other does.  In every round each view labels the
unlabelled documents it is surest of, among all of them, for the other one.  Then both are
calibrated together on labelled rows kept aside, and all documents are scored.  Bounded are the
labelled rows of the fit (``max_rows``, chosen by a hash of doc_id) and the pseudo-labels that a
view hands over in a round (``picks``); the search for them covers the whole table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stored

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…:\"”)]\s*$")
SHAPE, BUCKETS, SLOTS = 14, 1 << 16, 64
META = 2 * SLOTS + 6


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = n = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return n


def content(text: str | None, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(shape, hashed words) of the whole text; the shape holds shares, never sizes."""
    t = text or ""
    n = len(t)
    if not n:
        return np.zeros(SHAPE, np.float32), np.empty(0, np.uint16)
    words, tokens, lines = _WORD.findall(t.lower()), t.split(), [x for x in t.split("\n") if x.strip()]
    k = max(len(tokens), 1)
    chars = Counter(t)
    letters = sum(map(len, words))
    upper = sum(v for c, v in chars.items() if c.isupper())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    spaces = sum(v for c, v in chars.items() if c.isspace())
    common = Counter(tokens)
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    shape = [
        letters / n, upper / max(letters, 1), digits / n, spaces / n, (n - letters - digits - spaces) / n,
        letters / max(len(words), 1), len(common) / k, max(common.values(), default=0) / k, again / k,
        chars["|"] / k, chars["!"] / k, sum(chars[c] for c in "#%*&$@<>{}[]\\^~=") / k,
        len(set(lines)) / max(len(lines), 1), sum(bool(_END.search(x)) for x in lines) / max(len(lines), 1),
    ]
    return np.array(shape, np.float32), np.unique(np.fromiter(map(buckets.__getitem__, set(words)), np.uint16))


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """(slot of the source, slot of the language, size as the page states it)."""
    slot = lambda v: zlib.crc32(f"{v}".encode("utf-8", "surrogatepass")) % SLOTS
    return np.array([slot(source), slot(lang), 0 if n_chars is None or n_chars != n_chars else max(0.0, n_chars)], np.float32)


def spread_metadata(meta: np.ndarray) -> np.ndarray:
    """Indicators of source, language and size class, and the size's logarithm, row by row."""
    out, rows = np.zeros((len(meta), META)), np.arange(len(meta))
    if len(meta):
        out[rows, meta[:, 0].astype(int)] = out[rows, SLOTS + meta[:, 1].astype(int)] = 1
        out[:, 2 * SLOTS] = np.log1p(meta[:, 2])
        out[rows, 2 * SLOTS + 1 + np.minimum(4, np.log10(meta[:, 2] + 1).astype(int))] = 1
    return out


@dataclass
class Rows:
    """Features of some documents: shapes, metadata, and words as (row, bucket) pairs in order of rows."""

    shape: np.ndarray
    meta: np.ndarray
    row: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, shape: list[bytes], words: list[bytes], meta: list[bytes]) -> Rows:
        held = [np.frombuffer(w, np.uint16) for w in words]
        row = np.repeat(np.arange(len(held), dtype=np.int32), [len(w) for w in held])
        rows = lambda raw, n: np.frombuffer(b"".join(raw), np.float32).reshape(-1, n).astype(float)
        return cls(rows(shape, SHAPE), spread_metadata(rows(meta, 3)).astype(np.float32), row, np.concatenate([*held, np.empty(0, np.uint16)]))

    def take(self, at: np.ndarray) -> Rows:
        place = np.full(len(self.shape), -1, np.int32)
        place[at] = np.arange(len(at))
        used = place[self.row] >= 0
        return Rows(self.shape[at], self.meta[at], place[self.row[used]], self.word[used])

    def __add__(self, other: Rows) -> Rows:
        join = lambda a, b: np.concatenate([a, b])
        return Rows(join(self.shape, other.shape), join(self.meta, other.meta), join(self.row, other.row + np.int32(len(self.shape))), join(self.word, other.word))


#: Rows of a design matrix that exist at once while a model is fitted.
BLOCK = 2_000


def logistic(x: np.ndarray | Callable[[int, int], np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Newton's method on [x, 1]; the last weight is the constant.  ``x`` may be a function that makes its rows from one place to another."""
    part = x if callable(x) else lambda s, e: x[s:e]
    weight = np.ones(len(y)) if weight is None else weight
    width = part(0, 0).shape[1] + 1
    w, ridge = np.zeros(width), np.full(width, l2 * max(1.0, weight.sum()))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        grad, curve = ridge * w, np.diag(ridge)
        for s in range(0, len(y), BLOCK):
            e = min(s + BLOCK, len(y))
            rows = np.hstack([part(s, e), np.ones((e - s, 1))])
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            grad += rows.T @ (weight[s:e] * (p - y[s:e]))
            curve += (rows * (weight[s:e] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A logistic model on standardised columns and, for the content view, on words that tell the labels apart."""

    words: bool
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    of_word: np.ndarray

    @classmethod
    def fit(cls, rows: Rows, y: np.ndarray, weight: np.ndarray, words: bool, min_z: float = 3.0, most: int = 400) -> View:
        dense = rows.shape if words else rows.meta
        mean, scale = dense.mean(axis=0, dtype=float), dense.std(axis=0, dtype=float) + 1e-6
        of_word, chosen = np.zeros(BUCKETS), np.empty(0, int)
        at, column = np.empty(0, np.int32), np.empty(0, np.int16)
        if words:
            seen, hits = np.bincount(rows.word, minlength=BUCKETS), np.bincount(rows.word[(y > 0)[rows.row]], minlength=BUCKETS)
            p = y.mean()
            z = np.abs(hits - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p), 1e-9))
            z[seen < 5] = 0
            chosen = np.argsort(-z, kind="stable")[:most]
            chosen = chosen[z[chosen] >= min_z]
            place = np.full(BUCKETS, -1, np.int16)
            place[chosen] = np.arange(len(chosen))
            column = place[rows.word]
            at, column = rows.row[column >= 0], column[column >= 0]

        def part(s: int, e: int) -> np.ndarray:
            x = np.zeros((e - s, dense.shape[1] + len(chosen)))
            x[:, : dense.shape[1]] = (dense[s:e] - mean) / scale
            first, last = np.searchsorted(at, [s, e])
            x[at[first:last] - s, dense.shape[1] + column[first:last]] = 1
            return x

        w = logistic(part, y, weight)
        of_word[chosen] = w[dense.shape[1] : -1]
        return cls(words, mean, scale, np.append(w[: dense.shape[1]], w[-1]), of_word)

    def logit(self, rows: Rows) -> np.ndarray:
        dense = rows.shape if self.words else rows.meta
        z = np.clip((dense - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]
        return z + np.bincount(rows.row, weights=self.of_word[rows.word], minlength=len(dense)) if self.words else z


@dataclass
class QualityModel:
    """Two views and the weights (content, metadata, constant) that combine them."""

    views: tuple[View, View] | None
    mix: np.ndarray
    alone: tuple[np.ndarray, np.ndarray]

    def score(self, rows: Rows) -> np.ndarray:
        """Columns: score, content view's and metadata view's calibrated scores."""
        if self.views is None:
            z = np.full((len(rows.shape), 3), self.mix[-1])
        else:
            a, b = (v.logit(rows) for v in self.views)
            z = np.stack([self.mix[0] * a + self.mix[1] * b + self.mix[2], self.alone[0][0] * a + self.alone[0][1], self.alone[1][0] * b + self.alone[1][1]], 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, shape, words, meta) of all documents, worked out once from whole texts."""
    have = set(docs.columns)
    optional = {"source": "string", "lang": "string", "n_chars": "double"}
    rows = docs.select("doc_id", "text", *((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in optional.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for pdf in batches:
            found = [content(t, buckets) for t in pdf["text"]]
            meta = [metadata(*x).tobytes() for x in zip(pdf["source"], pdf["lang"], pdf["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shape": [s.tobytes() for s, _ in found], "words": [w.tobytes() for _, w in found], "meta": meta})

    kind = dict(docs.dtypes)["doc_id"]
    return map_slices(rows, run, f"doc_id {kind}, shape binary, words binary, meta binary")


def surest(free: DataFrame, views: tuple[View, View], taken: set, picks: tuple[int, int], sure: float) -> list:
    """The documents of ``free`` that each view is surest of: rows (view, label, certainty, doc_id, shape, words, meta).

    For each view and label at most ``picks[label]``, by (certainty, doc_id); ``taken`` ids are
    left out.  A task sends on no more than that many of its own.
    """

    def best(part: pd.DataFrame) -> pd.DataFrame:
        ranked = part.sort_values(["certainty", "doc_id"], ascending=[False, True], kind="stable")
        return pd.concat([g.head(picks[label]) for (_, label), g in ranked.groupby(["view", "label"])] or [part])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf[~pdf["doc_id"].isin(taken)]
            rows = Rows.of(pdf["shape"], pdf["words"], pdf["meta"])
            for k, view in enumerate(views):
                p = 1 / (1 + np.exp(-np.clip(view.logit(rows), -30, 30)))
                for label, certainty in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(certainty >= sure)
                    if len(at):
                        some = pdf.iloc[at].assign(view=k, label=label, certainty=certainty[at])
                        kept = best(some if kept is None else pd.concat([kept, some]))
        if kept is not None:
            yield kept[["view", "label", "certainty", "doc_id", "shape", "words", "meta"]]

    kind = dict(free.dtypes)["doc_id"]
    found = stored(map_slices(free, run, f"view int, label int, certainty double, doc_id {kind}, shape binary, words binary, meta binary"))
    out = []
    for k in (0, 1):
        for label in (1, 0):
            mine = found.where((F.col("view") == k) & (F.col("label") == label))
            out += mine.orderBy(F.desc("certainty"), "doc_id").limit(picks[label]).collect()
    return out


def co_train(known: Rows, y: np.ndarray, aside: np.ndarray, ask, rounds: int = 3, weight: float = 0.3) -> QualityModel:
    """Fit on labelled rows (``aside``: kept for calibration) and on what ``ask(views)`` finds in each round.

    ``ask`` gives, for each view, the rows it labels for the other one, and their labels.
    Without both labels the score is constant.
    """
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    if not 0 < y.sum() < n or len(np.unique(y[~aside])) < 2 or len(np.unique(y[aside])) < 2:
        return QualityModel(None, np.array([0, 0, np.log(prior / (1 - prior))]), (np.zeros(2), np.zeros(2)))
    own = known.take(np.flatnonzero(~aside))
    sets = [(own, y[~aside], np.ones((~aside).sum()))] * 2
    fitted = lambda: tuple(View.fit(*s, words=k == 0) for k, s in enumerate(sets))
    views = fitted()
    for _ in range(rounds):
        found = ask(views)
        if not any(len(labels) for _, labels in found):
            break
        for k, (rows, labels) in enumerate(found):
            have, so_far, weights = sets[1 - k]
            sets[1 - k] = (have + rows, np.concatenate([so_far, labels]), np.concatenate([weights, np.full(len(labels), weight)]))
        views = fitted()
    test = known.take(np.flatnonzero(aside))
    a, b, held = views[0].logit(test), views[1].logit(test), y[aside]
    alone = tuple(logistic(z[:, None], held, l2=1e-3) for z in (a, b))
    return QualityModel(views, logistic(np.stack([a, b], 1), held, l2=1e-3), alone)


def train(seen: DataFrame, labels: DataFrame, max_rows: int = 20_000, rounds: int = 3, picks: int = 1_000, sure: float = 0.9) -> QualityModel:
    """Fit on labelled rows of ``seen`` (:func:`features`) with crc32(doc_id) mod 5 > 1; those with 1 calibrate, those with 0 are left for tests.

    Null ids and labels are left out; a doc_id with several labels counts as good only if all
    are 1.  A view hands over at most ``picks`` rows a round, in the labels' proportions, out of
    all rows without a label.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("fold", fold).where("fold > 0")
    share = int(min(1.0, max_rows / max(1, known.count())) * (1 << 20))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)  # bounded by max_rows, so it may go to every executor
    got = seen.join(F.broadcast(some), "doc_id").select("shape", "words", "meta", "quality", "fold").collect()
    y, aside = np.array([r["quality"] for r in got], float), np.array([r["fold"] == 1 for r in got], bool)
    own = Rows.of(*([r[c] for r in got] for c in ("shape", "words", "meta")))
    del got
    labelled = labels.select("doc_id").distinct().hint("merge")  # it grows with the corpus, so it is never sent to every executor
    free = seen.where("doc_id is not null").join(labelled, "doc_id", "left_anti")
    taken: set = set()
    good = int(np.ceil(picks * (y.mean() if len(y) else 0.5)))

    def ask(views: tuple[View, View]) -> list[tuple[Rows, np.ndarray]]:
        found = surest(free, views, taken, (picks - good + 1, good), sure)
        out = []
        for k in (0, 1):
            mine = [r for r in found if r["view"] == k and r["doc_id"] not in taken]  # the first view's picks come first
            taken.update(r["doc_id"] for r in mine)
            out.append((Rows.of(*([r[c] for r in mine] for c in ("shape", "words", "meta"))), np.array([r["label"] for r in mine], float)))
        return out

    return co_train(own, y, aside, ask, rounds)


def score_documents(seen: DataFrame, model: QualityModel) -> DataFrame:
    """Rows (doc_id, score, predicted, text_score, metadata_score) for every row of ``seen`` (:func:`features`).

    Null and empty texts and missing metadata are scored by what is left, long texts whole;
    repeated rows stay rows, other columns never matter, an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.score(Rows.of(pdf["shape"], pdf["words"], pdf["meta"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s[:, 0], "predicted": (s[:, 0] >= 0.5).astype(int), "text_score": s[:, 1], "metadata_score": s[:, 2]})

    kind = dict(seen.dtypes)["doc_id"]
    return map_slices(seen, run, f"doc_id {kind}, score double, predicted int, text_score double, metadata_score double")
