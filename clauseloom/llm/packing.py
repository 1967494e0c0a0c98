"""Sequence packing: dominance reduction first, best fit for the rest.

Documents are cut into pieces of at most one sequence.  Pieces of one length are alike, so
the packing is planned on the histogram of lengths alone: at most ``capacity`` numbers reach
the driver, whatever the corpus.  The plan is a list of runs, each saying which ranks of a
length go to which sequences; a run ends only when a length or a group of equal sequences is
used up, so their number depends on the capacity and not on the corpus.  Ranks are dealt per
(length, salt), so that no length is numbered in one task.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, stored

#: Marks that may end a word; they are pre-tokens of their own after a letter.
_MARKS = ".,!?;:%#*&$|"
#: Words whose ids each worker remembers.
_KEEP = 200_000
#: A line feed between visible characters; _LINE, which no text holds, stands for it before the next word.
_FEED, _LINE = re.compile(r"(?<=\S)\n(?=\S)"), "\ud800"
_JOIN = " " + _LINE


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: visible ones as they are, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in seen]
    return {x: chr(x) for x in seen} | {x: chr(256 + n) for n, x in enumerate(hidden)}


class WordEncoder:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit bytes.

    Such tokenizers never join across a space, or one line feed, between visible characters,
    so texts are encoded by words and repeated words come from a table.  A word of letters is one
    pre-token, which goes straight to the model, and marks at its end are others; words of another
    kind go through the whole tokenizer.  A text in which a space follows other white space is
    encoded in one piece.
    """

    def __init__(self, path: str, keep: int = _KEEP):
        self.keep = keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.direct = kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        self.letters = _byte_letters()
        self.known: dict[str, bytes | None] = {}
        self.again: set[str] = set()  # words of more than one batch
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self._ids([marks])[0]
        return self.tails[marks]

    def _learn(self, words: set[str]) -> None:
        """Ids of words after a space, or a line feed; None where what follows may belong to a word's white space."""
        known, model, letters, odd = self.known, self.tokenizer.model, self.letters, []
        feed = self._tail("\n")
        for w in words:
            s = w.rstrip(_MARKS)
            fed = s[:1] == _LINE
            body = s[1:] if fed else s
            if not (self.direct and body.isalpha() and (body.isascii() or max(body) < "\u0530")):
                odd.append(w)
                continue
            ids = known.get(s)
            if ids is None:
                found = model.tokenize((body if fed else " " + body).encode().decode("latin-1").translate(letters))
                ids = array("I", [x.id for x in found]).tobytes()
                known[s] = ids = feed + ids if fed else ids
            if len(s) != len(w):
                known[w] = ids + self._tail(w[len(s) :])
        known.update((w, None) for w in odd if not w or w[-1].isspace())
        odd = [w for w in odd if w and not w[-1].isspace()]
        known.update(zip(odd, self._ids(["\n" + w[1:] if w[0] == _LINE else " " + w for w in odd]), strict=True))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known = {w: self.known[w] for w in self.again}
            self.again = set()
        known = self.known
        cut = [_FEED.sub(_JOIN, t).split(" ") for t in texts]
        later = {k: words[1:] for k, words in enumerate(cut) if max(map(len, words)) <= 200}
        met = set(itertools.chain.from_iterable(later.values()))
        new = met.difference(known)
        self.again |= met.difference(new)
        self._learn(new)
        found: dict[int, list] = {}
        for k, words in later.items():
            ids = list(map(known.__getitem__, words))
            if None not in ids and not cut[k][0][-1:].isspace():
                found[k] = ids
        heads = dict(zip(found, self._ids([cut[k][0] for k in found]), strict=True))
        rest = [k for k in range(len(texts)) if k not in found]
        whole = dict(zip(rest, self._ids([texts[k] for k in rest]), strict=True))
        return [whole[k] if k in whole else heads[k] + b"".join(found[k]) for k in range(len(texts))]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, keep: int = _KEEP) -> WordEncoder:
    """One encoder for each Python worker, file and number of words to remember."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = WordEncoder(path, keep)
    return _ENCODERS[path, keep]


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: int = _KEEP) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and id 0, cut to ``capacity``.

    Only documents longer than that are cut; their first piece is the shorter one.  A null
    text counts as empty (the single id 0).  ``keep`` is the number of words whose ids each
    worker remembers: it trades memory for speed and changes no result.
    """
    path = tokenizer or public_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = encoder(path, keep)
        for pdf in batches:
            rows = []
            for i, ids in zip(pdf["i"], of.encode_all([t or "" for t in pdf["t"]]), strict=True):
                ids += b"\0\0\0\0"
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    rows.append((i, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, piece = start + size, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_slices(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, schema)


@dataclass
class Plan:
    """Runs (length, first rank, count, per bin, first bin, offset) and the number of bins."""

    capacity: int
    counts: dict[int, int]
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0

    def __post_init__(self) -> None:
        self.left = {k: v for k, v in self.counts.items() if v}
        self.used = dict.fromkeys(self.left, 0)

    def put(self, length: int, count: int, per: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, per, first, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...]) -> None:
        """Close as many equal bins of these lengths as there are pieces for."""
        need = {k: lengths.count(k) for k in lengths}
        n = min(self.left[k] // m for k, m in need.items())
        offset = 0
        for k, m in need.items():
            self.put(k, n * m, m, self.bins, offset)
            offset += k * m
        self.bins += n

    def reduce(self) -> None:
        """Martello and Toth's dominance: fix a bin that no other bin with its largest piece can beat."""
        for length in sorted(self.left, reverse=True):
            while length in self.left and (found := self._dominating(length)):
                self.fix(found)

    def _dominating(self, length: int) -> tuple[int, ...] | None:
        room = self.capacity - length
        others = self.left | {length: self.left[length] - 1}
        fit = sorted(k for k, n in others.items() if n and k <= room)
        if not fit:
            return (length,)
        best = fit[-1]
        if best == room:
            return (length, best)  # fills the bin
        small = [k for k in fit[:3] for _ in range(min(3, others[k]))][:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return (length, best)  # one more piece fits: the largest is the best
        if len(small) < 3 or sum(small) > room:  # at most two more fit
            others[best] -= 1
            second = max((k for k in fit if others[k] and k <= room - best), default=0)
            others[best] += 1
            above = dict(zip(fit, fit[1:], strict=False))
            lower = max((k for k in fit if 2 * k <= room and (others[k] > 1 or above.get(k, room) <= room - k)), default=0)
            if second and lower <= second:
                return (length, best, second)
        return None

    def best_fit(self) -> None:
        """Best fit, longest first, for whole groups of bins with the same room."""
        rooms: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, offset)
        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                room = min((r for r in rooms if r >= length), default=self.capacity)
                if room in rooms:
                    first, size, offset = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                else:
                    first, size, offset = self.bins, -(-n // (self.capacity // length)), 0
                    self.bins += size
                per = room // length
                if n < per:  # one bin takes all
                    take, per = 1, n
                else:
                    take = min(size, n // per)
                self.put(length, take * per, per, first, offset)
                if left := room - per * length:
                    rooms.setdefault(left, []).append((first, take, offset + per * length))
                if take < size:
                    rooms.setdefault(room, []).append((first + take, size - take, offset))


def plan(counts: dict[int, int], capacity: int = 2048) -> Plan:
    out = Plan(capacity, counts)
    out.reduce()
    out.best_fit()
    return out


def pack(cut: DataFrame, capacity: int = 2048, salts: int = 256) -> DataFrame:
    """Add (sequence_id, offset) to ``cut``, rows of :func:`pieces` in storage.

    Offsets of a sequence are gapless from 0.  An empty table gives none; equal rows are
    separate pieces.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    todo = sorted(plan(counts, capacity).runs)
    salts = max(salts, sum(counts.values()) // 1_000_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("rank") + F.col("base")).alias("rank"))
    runs = spark.sparkContext.broadcast(np.array(todo, np.int64).reshape(-1, 6))  # a few thousand rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = runs.value
        keys = table[:, 0] << 44 | table[:, 1]
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            run = table[np.searchsorted(keys, pdf["length"].to_numpy(np.int64) << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pdf.drop(columns="rank").assign(sequence_id=run[:, 4] + nth // run[:, 3], offset=run[:, 5] + nth % run[:, 3] * run[:, 0])

    kinds = ", ".join(f"`{c}` {k}" for c, k in cut.dtypes)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep: int = _KEEP) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, capacity, tokenizer, keep=keep)), capacity)
