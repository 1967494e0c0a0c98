"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from labelled text.  A document is cut, from left
to right, into the longest phrases the automaton contains; the language that needs the fewest
phrases a letter describes the text best.  Parsing starts anew every ``SEGMENT`` letters, so
all segments of a batch advance together and a giant text costs no more a letter than a short
one; whole texts are parsed.  Only the labelled text of the automata is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of

SEGMENT = 1024
#: Between the words of a text in ASCII, and a word of any other: letters, with the marks that stand on them.
_GAP, _WORD = re.compile(r"[\W\d_]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Letters are numbered from 1; 0 stands for a letter no training text has.
_NONE = -1


def letters(text: str | None) -> str:
    """Lower-case words, with one space between two: letters (L*) and the marks (M*) that follow them in a word.

    Numbers of any kind (digits, fractions, Roman numeral signs) are no letters.
    """
    low = (text or "").lower()
    return _GAP.sub(" ", low).strip() if low.isascii() else " ".join(_WORD.findall(low))


class SuffixAutomaton:
    """Transitions of the smallest automaton that accepts all substrings of some texts."""

    def __init__(self, texts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)

    def _extend(self, last: int, c: str) -> int:
        following, link, length = self.next, self.link, self.length
        if c in following[last]:
            q = following[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, c)
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: str) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(following)
        following.append(dict(following[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and following[p].get(c) == q:
            following[p][c] = copy
            p = link[p]
        return copy


class LanguageModel:
    """Transitions of one automaton for each language: dense tables for the ``alphabet - 1`` most frequent letters, sorted keys for all others."""

    def __init__(self, samples: dict[str, list[str]], alphabet: int = 64):
        self.languages = sorted(samples)
        counts: dict[str, int] = {}
        for texts in samples.values():
            for t in texts:
                for c in t:
                    counts[c] = counts.get(c, 0) + 1
        number = {c: n for n, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)), 1)}
        self.codes = np.zeros(0x110000, np.int32)
        for c, n in number.items():
            self.codes[ord(c)] = n
        self.width, self.letters = min(len(number), alphabet - 1) + 1, len(number) + 1
        tables = []
        rare: list[tuple[int, int]] = []
        self.roots = []
        at = 0
        for lang in self.languages:
            found = SuffixAutomaton(samples[lang])
            t = np.full((len(found.next), self.width), _NONE, np.int32)
            for state, following in enumerate(found.next):
                for c, to in following.items():
                    if number[c] < self.width:
                        t[state, number[c]] = (at + to) * self.width
                    else:
                        rare.append(((at + state) * self.letters + number[c], (at + to) * self.width))
            self.roots.append(at * self.width)
            at += len(found.next)
            tables.append(t)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        rare.append((np.iinfo(np.int64).max, _NONE))
        self.rare_keys, self.rare_to = np.array(sorted(rare), np.int64).T.copy()

    def _follow(self, state: np.ndarray, c: np.ndarray, rare: bool) -> np.ndarray:
        """The states after letters ``c``, ``_NONE`` where there are none."""
        if not rare:
            return self.table[state + c]
        to = self.table[state + np.where(c < self.width, c, 0)]  # no letter has number 0
        some = np.flatnonzero(c >= self.width)
        if len(some):
            key = np.broadcast_to(state, c.shape)[some].astype(np.int64) // self.width * self.letters + c[some]
            at = np.searchsorted(self.rare_keys, key)
            to[some] = np.where(self.rare_keys[at] == key, self.rare_to[at], _NONE)
        return to

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Row by text, column by language: phrases that cover the text, divided by its letters."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        rare = bool((codes >= self.width).any())
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        first = np.concatenate(([0], np.cumsum(parts)))[:-1]
        nth = np.arange(len(owner)) - first[owner]
        start = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
        length = np.minimum(sizes[owner] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        live = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")  # lanes longer than step
        found = np.zeros((len(owner), len(self.languages)), np.int32)
        for k, root in enumerate(self.roots):
            state, count = np.full(len(owner), root, np.int32), np.ones(len(owner), np.int32)
            for step in range(SEGMENT):
                n = live[step]
                if not n:
                    break
                c = codes[start[:n] + step]
                to = self._follow(state[:n], c, rare)
                stuck = np.flatnonzero(to < 0)
                if len(stuck):  # the phrase ends before this letter, or the letter is a phrase of its own
                    again = self._follow(np.int32(root), c[stuck], rare)
                    count[stuck] += state[stuck] != root
                    alone = again < 0
                    count[stuck[alone]] += 1
                    again[alone] = root
                    to[stuck] = again
                state[:n] = to
            found[:, k] = count - ((state == root) & (length > 0))
        out = np.zeros((len(texts), len(self.languages)))
        np.add.at(out, owner, found)
        return out / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases a letter): ``und`` with score 0 where a text has no letter."""
        plain = [letters(t) for t in texts]
        if not self.languages:
            return [("und", 0.0, 0.0)] * len(texts)
        rates = self.phrases(plain)
        best = rates.argmin(axis=1)
        low = rates[np.arange(len(best)), best]
        odds = np.exp(-12 * (rates / np.maximum(low, 1e-9)[:, None] - 1))
        return [(self.languages[b], float(1 / o), float(r)) if t else ("und", 0.0, 0.0) for t, b, o, r in zip(plain, best.tolist(), odds.sum(axis=1).tolist(), low.tolist(), strict=True)]


#: Characters of a training text that are learned from together.
SAMPLE = 512


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_letters: int = 40_000, max_rows: int = 400) -> LanguageModel:
    """A model from at most ``max_rows`` labelled texts, ``max_letters`` letters, of each language.

    The texts are those whose id has the smallest hash; of these, stretches of ``SAMPLE``
    characters from anywhere in the text are learned from, in the order of a hash of id and
    place.  Rows whose text or language is null are left out.
    """
    rows = docs.where(f"`{text_col}` is not null and `{lang_col}` is not null").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias(id_col))
    keyed = rows.select("lang", "text", F.xxhash64(id_col).alias("h"))
    share = keyed.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row for each language
    limits = {r["lang"]: max_rows / r["n"] for r in share}
    if not limits:
        return LanguageModel({})
    pick = F.create_map(*(F.lit(x) for k, v in limits.items() for x in (k, int(min(1.0, v) * (1 << 20)))))
    few = keyed.where(F.pmod("h", F.lit(1 << 20)) < pick[F.col("lang")])
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / SAMPLE).cast("int"))
    part = few.select("lang", "h", "text", F.explode(places).alias("k")).select("lang", F.xxhash64("h", "k").alias("h"), F.expr(f"substring(text, k * {SAMPLE} + 1, {SAMPLE})").alias("text"))
    nth = Window.partitionBy("lang").orderBy("h", "text")
    most = 4 * max_letters // SAMPLE  # enough stretches even where only a quarter of the characters are letters
    sample: dict[str, list[str]] = {k: [] for k in limits}
    for r in part.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most).orderBy("lang", "nth").collect():
        text = letters(r["text"])
        if text and sum(map(len, sample[r["lang"]])) < max_letters:
            sample[r["lang"]].append(text)
    return LanguageModel({k: v for k, v in sample.items() if v})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add (lang_pred string, score double, phrase_rate double), each name after ``prefix``, to ``docs``.

    Null, empty and letterless texts are ``und`` with score 0, long texts are parsed whole,
    repeated rows stay rows, columns of these names are replaced, and an empty table gives
    none.  The score compares the best language's phrase rate with all others'; ties go to the
    language that comes first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_letters a language
    own = ["lang_pred", "score", "phrase_rate"]

    @F.pandas_udf("lang_pred string, score double, phrase_rate double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for part in texts:
            rows, batch, size = [], [], 0
            for t in part:
                batch.append(t)
                size += len(t or "")
                if size > 1_000_000:
                    rows += known.predict(batch)
                    batch, size = [], 0
            rows += known.predict(batch) if batch else []
            yield pd.DataFrame(rows, columns=own)

    kept = [c for c in docs.columns if c not in [prefix + k for k in own]]
    found = texts_of(docs).select(*kept, of(text_col).alias("__language__"))
    return found.select(*kept, *(F.col(f"__language__.{k}").alias(prefix + k) for k in own))
