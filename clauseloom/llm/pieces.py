"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into the pieces of a vocabulary with the greatest sum of scores.  No piece spans
the start of a word, so words are cut on their own and remembered.  Texts beyond ``chunk`` code
points are cut into chunks, wherever that falls.  The state at a boundary is the number of code
points that the last piece reaches beyond it; a chunk gives a matrix of the best score from each
state to each, matrices combine by max-plus products in a tree of fan-out ``FAN``, and the states
on the best path come back down the tree.  Then each chunk finds its own pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import group_bounds, map_slices, stored, texts_of, whole_groups

CHUNK, FAN = 16_384, 64
#: Words in each of two generations that a worker remembers; a task may have a worker that encodes and one that decodes.
KEEP = 200_000
SPACE = "▁"
#: Stands for a SPACE mark in a text itself, which goes to bytes; no text can hold it.
_MARK = "\ud800"
#: Lower scores (pieces that the vocabulary never wants) count as this one.
FLOOR = -200_000
_NEVER = np.int64(-(1 << 60))


def public_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words, cut as they are met; words not met for two generations are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.vocabulary.cut(SPACE + word)
        if len(word) < 100:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.texts = [p.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.texts[i][1:-1], 16) for i in range(n) if p.is_byte(i)}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        # runs of spaces are left out, so no piece spans the start of a word
        self.pieces = {self.texts[i]: (max(round(p.get_score(i)), FLOOR), i) for i in plain if SPACE not in self.texts[i][1:]}
        self.tree: dict = {}  # children by letter, the score of the piece that ends here under 0
        for t, (score, _) in self.pieces.items():
            node = self.tree
            for c in t:
                node = node.setdefault(c, {})
            node[0] = score
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        # what an id adds to the score: an unknown letter counts once, at the first of its bytes
        self.worth = np.array([self.pieces[t][0] if self.pieces.get(t, (0, -1))[1] == i else self.unknown * (self.byte_of.get(i, 0x80) & 0xC0 != 0x80) for i, t in enumerate(self.texts)], np.int64)
        self.words = _Words(self)

    def forward(self, s: str, first: int = 0) -> tuple[list[int], list[int]]:
        """Best score to each place from ``first``, and where its last piece begins (ties: the earliest)."""
        n, never = len(s), int(_NEVER)
        best, back = [never] * (n + 1), [0] * (n + 1)
        best[first] = 0
        root, unknown, pieces = self.tree, self.unknown, self.pieces
        for i in range(first, n):
            here, node, j = best[i], root, i
            for c in s[i:]:
                if c not in node:
                    break
                node = node[c]
                j += 1
                if 0 in node and here + node[0] > best[j]:
                    best[j], back[j] = here + node[0], i
            if here + unknown > best[i + 1] and s[i] not in pieces:
                best[i + 1], back[i + 1] = here + unknown, i
        return best, back

    def cut(self, s: str) -> bytes:
        """Ids (unsigned 32-bit) of the best cut of a marked string."""
        back = self.forward(s)[1]
        ids, j, pieces = array("I"), len(s), self.pieces
        while j:
            i = back[j]
            part = s[i:j]
            if part in pieces:
                ids.append(pieces[part][1])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(part.replace(_MARK, SPACE).encode("utf-8", "surrogatepass")))
            j = i
        ids.reverse()
        return ids.tobytes()

    def encode(self, text: str) -> tuple[bytes, int]:
        """Ids and score of a stretch of text; a leading space belongs to its first word."""
        first, *later = text.replace(SPACE, _MARK).split(" ")
        head = self.cut(first) if first else b""
        ids = head + b"".join(map(self.words.__getitem__, later))
        return ids, int(self.worth[np.frombuffer(ids, np.uint32)].sum())

    def decode(self, ids: bytes) -> str:
        """The text of a stretch, its leading space included."""
        return b"".join(map(self.raw.__getitem__, array("I", ids))).decode("utf-8", "surrogatepass")

    def transfer(self, chunk: str, size: int) -> np.ndarray:
        """Best scores from states (rows) to states; ``chunk`` goes on beyond ``size`` for the last piece."""
        n = self.longest
        out = np.full((n, n), _NEVER)
        s = chunk.replace(SPACE, _MARK).replace(" ", SPACE)
        here = s[:size]
        first, last = here.find(SPACE), here.rfind(SPACE)
        if first < 0:
            for k in range(min(n, len(s) + 1)):
                best = self.forward(s, k)[0]
                for to in range(min(n, len(s) - size + 1)):
                    out[k, to] = best[size + to] if size + to >= k else _NEVER
            return out
        heads = [self.forward(s[:first], k)[0][first] for k in range(min(n, first + 1))]
        middle = self.encode(chunk[first:last])[1] if last > first else 0
        best = self.forward(s[last:])[0]
        tails = [best[size - last + to] for to in range(min(n, len(s) - size + 1))]
        h, t = np.array(heads, np.int64)[:, None], np.array(tails, np.int64)[None, :]
        out[: len(heads), : len(tails)] = np.where((h > _NEVER) & (t > _NEVER), h + middle + t, _NEVER)
        return out


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker and file."""
    if path not in _KNOWN:
        _KNOWN[path] = Vocabulary(path)
    return _KNOWN[path]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), _NEVER)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all boundaries of a run of chunks on the best path from ``entry`` to ``leave``."""
    reach = [np.full(len(matrices[0]), _NEVER)]
    reach[0][entry] = 0
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(axis=0), _NEVER))
    out = [leave]
    for m, r in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        out.append(int((r + m[:, out[-1]]).argmax()))
    return out[::-1]


def _matrix(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw, np.int64)
    return m.reshape(int(len(m) ** 0.5), -1)


def _chunks(texts: DataFrame, chunk: int, beyond: int) -> DataFrame:
    n = F.ceil(F.char_length("s") / chunk).cast("int")
    cut = texts.select("row", "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return cut.select("row", "k", F.expr(f"substring(s, k * {chunk} + 1, {chunk + beyond})").alias("part"))


def _giant_states(parts: DataFrame, vocab: str, chunk: int) -> DataFrame:
    """Rows (row, k, entry, leave): states of each chunk on the best path of its text."""

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(vocab)
        for pdf in batches:
            yield pdf[["row", "k"]].assign(m=[v.transfer(p, min(chunk, len(p))).tobytes() for p in pdf["part"]])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["row", "block"]):
            rows = []
            for s, n in zip(*group_bounds(pdf, ["row", "block"]), strict=True):
                m = _matrix(pdf["m"].iloc[s])
                for k in range(s + 1, s + n):
                    m = product(m, _matrix(pdf["m"].iloc[k]))
                rows.append((pdf["row"].iloc[s], pdf["block"].iloc[s], m.tobytes()))
            yield pd.DataFrame(rows, columns=["row", "k", "m"])

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["row", "block"]):
            found: list[int] = []
            leave: list[int] = []
            for s, n in zip(*group_bounds(pdf, ["row", "block"]), strict=True):
                path = states([_matrix(m) for m in pdf["m"].iloc[s : s + n]], int(pdf["entry"].iloc[s]), int(pdf["leave"].iloc[s]))
                found += path[:-1]
                leave += path[1:]
            yield pdf[["row", "k"]].assign(entry=found, leave=leave)

    blocked = lambda df: df.withColumn("block", F.expr(f"int(k div {FAN})")).repartition("row", "block").sortWithinPartitions("row", "block", "k")
    levels = [stored(parts.mapInPandas(transfers, "row bigint, k int, m binary"))]
    while not levels[-1].where(f"k >= {FAN}").isEmpty():
        levels.append(stored(blocked(levels[-1]).mapInPandas(products, "row bigint, k int, m binary")))
    path = levels[-1].select("row").distinct().select("row", F.lit(0).alias("block"), F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels):
        known = level.withColumn("block", F.expr(f"int(k div {FAN})")).join(path, ["row", "block"])
        path = known.repartition("row", "block").sortWithinPartitions("row", "block", "k").mapInPandas(descend, "row bigint, k int, entry int, leave int")
        path = path.withColumnRenamed("k", "block")
    return path.withColumnRenamed("block", "k")


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, chunk, start, n_chars, ids binary, score): the pieces of each text, by chunk.

    ``start`` and ``n_chars`` are the code points of the text that the row's ids cover, ids are
    unsigned 32-bit little-endian.  A null or empty text has one row without ids; rows that
    repeat are encoded again; an empty table gives none.
    """
    path = model or public_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, chunk int, start bigint, n_chars bigint, ids binary, score bigint"

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            found = [v.encode(" " + t) if t else (b"", 0) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "chunk": 0, "start": 0, "n_chars": pdf["text"].map(len), "ids": [a for a, _ in found], "score": [b for _, b in found]})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            out = []
            for i, k, part, entry, leave in zip(pdf["doc_id"], pdf["k"], pdf["part"], pdf["entry"], pdf["leave"], strict=True):
                own = part[entry : min(chunk, len(part)) + leave]
                ids, score = v.encode(own)
                out.append((i, k, max(0, k * chunk + entry - 1), len(own) - (k == 0), ids, score))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "start", "n_chars", "ids", "score"])

    giant = F.char_length("text") >= chunk
    one = map_slices(rows.where(~giant), short, schema)
    texts = stored(rows.where(giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(F.lit(" "), "text").alias("s")))
    parts = _chunks(texts, chunk, vocabulary(path).longest - 1)
    bounds = _giant_states(parts, path, chunk)
    many = map_slices(parts.join(bounds, ["row", "k"]).join(texts.select("row", "doc_id"), "row"), pieces, schema, rows=100)
    return one.unionByName(many)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Replace ``ids`` by the ``text`` they stand for, row by row; rows of a text join to the whole."""
    path = model or public_vocabulary()
    kept = [c for c in encoded.columns if c not in ("ids", "text")]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in encoded.select(*kept).dtypes), "text string"])
    target = to_arrow_schema(StructType.fromDDL(schema))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, chunks = part.column("ids").to_pylist(), part.column("chunk").to_pylist()
                found = [v.decode(x)[1 if k == 0 else 0 :] for x, k in zip(ids, chunks, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(target.field(c).type) for c in kept), pa.array(found, target.field("text").type)], schema=target)

    return encoded.select(*kept, "ids").mapInArrow(texts, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, chunk, start, n_chars, n_ids, ids_crc32, text_crc32 and score of encoded rows, decoded again."""
    ids = encoded.withColumn("n_ids", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))
    return decode(ids).select("doc_id", "chunk", "start", "n_chars", "n_ids", "ids_crc32", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "score")
