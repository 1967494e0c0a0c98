"""Fill-in-the-middle against a plain version that lists all units, and odd rows."""

import hashlib
import re
from random import Random

from clauseloom.llm import middles as L

SCHEMA = "doc_id long, text string, n long, form string, output string"


def plain(doc_id, text):
    """The contract, read off a list of all units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_against_plain(spark):
    rng = Random(7)
    texts = ["".join(rng.choice(["ab", "Ωé", " ", "\n", "<", "P", ">", "<S", "M>", "😀", "x1", "́"]) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += ["long words " * 30_000, "<P", "<", ">", "P>"]
    got = {r.doc_id: r for r in L.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("back", L.restored()).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, text) and r.back == text
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [(5, None, 1, "a", "b"), (5, "", 1, "a", "b"), (6, "a b c", None, None, None), (6, "a b c", 1, "a", "b"), (None, "a b", 1, "a", "b"), (7, "x <P> y", 1, "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.fill_in_middle(df).withColumn("back", L.restored()).collect()
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((i or 0, t or "") for i, t, *_ in rows)
    assert [(r.n, r.form, r.prefix_chars) for r in got if r.doc_id == 5] == [(0, "plain", None)] * 2
    assert len({r.output for r in got if r.doc_id == 6}) == 1 and next(r for r in got if r.doc_id == 7).form == "plain"
    assert L.fill_in_middle(df.limit(0)).collect() == []


def test_no_list_of_units(monkeypatch):
    """At no time are more than a few matches of a long text alive."""
    alive, most = [0], [0]

    class Match:
        def __init__(self, m):
            self.m = m
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def end(self):
            return self.m.end()

        def __del__(self):
            alive[0] -= 1

    class Pattern:
        def finditer(self, text):
            return map(Match, re.finditer(L.UNITS, text))

    text = "ab " * 10_000
    assert L.count_units(Pattern(), text) == 20_000 and L.cut_places(Pattern(), text, 3, 15_000) == (5, 22_500) and most[0] < 4
