"""Fill-in-the-middle: every text is cut into prefix, middle and suffix and its parts are reordered.

A text is matched twice.  The first pass counts its units; the second advances a lazy match
iterator to the two cut ranks that the document's hash draws.  No list of units is ever built, so a
text of any length costs the text itself and one match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Before prefix, suffix and middle; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a run of Latin letters or any other code point.
UNITS = r"[A-Za-z]+|[^A-Za-z]"


def draws(doc_id: object, seed: int = 1) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document; a null id is written ``null``."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def count_units(pattern: re.Pattern, text: str) -> int:
    """How many units a text has, one match at a time."""
    return sum(1 for _ in pattern.finditer(text))


def cut_places(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the text's first ``low`` and first ``high`` (not fewer) units end, in code points."""
    matches = pattern.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def arrange(text: str, doc_id: object, pattern: re.Pattern, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's length, middle's length, output) of one text."""
    n = count_units(pattern, text)
    one, two, shown, kind = draws(doc_id, seed)
    if not text or shown % 100 >= percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = cut_places(pattern, text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if kind % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, units: str = UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n long, form, prefix_chars long, middle_chars long, output) of every text.

    ``units`` is a pattern that matches every code point of a text, left to right; ``n`` counts
    its matches.  ``percent`` of the texts are reordered, ``spm_percent`` of these with the suffix
    first; the rest, empty texts and texts that hold a marker are ``plain``, with null lengths.
    Lengths are in code points, and equal draws give an empty middle.  A null text is an empty one; a null doc_id
    draws like any other id; rows that repeat are separate rows with equal results; texts of any
    length are handled whole; an empty table gives none; other columns are ignored.
    """
    pattern = re.compile(units)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids = [None if v is pd.NA or v is None or v != v else v for v in pdf["i"].astype(object)]
            rows = [arrange(t or "", i, pattern, seed, percent, spm_percent) for i, t in zip(ids, pdf["t"], strict=True)]
            made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield made.assign(doc_id=ids)[["doc_id", *made.columns]].astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    out = map_slices(rows, run, "doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[id_col]))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of a form was made from.

    Texts hold no marker where the form is not plain, and markers begin and end with marks of
    their own, so the first of each that occurs is the one that was put there.
    """
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after = lambda text, mark: F.split_part(text, F.lit(mark), F.lit(2))
    before = lambda text, mark: F.split_part(text, F.lit(mark), F.lit(1))
    middle = after(out, MIDDLE)
    psm = F.concat(before(after(out, PREFIX), SUFFIX), middle, before(after(out, SUFFIX), MIDDLE))
    spm = F.concat(before(after(out, PREFIX), MIDDLE), middle, before(after(out, SUFFIX), PREFIX))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)
