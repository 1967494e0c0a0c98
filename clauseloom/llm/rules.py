"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated.

Every rule reads a few counts of a text and votes that it is good, votes that it is bad, or
abstains.  Expectation-maximisation over the vote patterns estimates how often each rule is right
about good and about bad texts and how many are good; the posterior probability of a document's
pattern then decides, instead of a filter that every rule must pass.  All of it is DataFrame
expressions; a corpus has at most 3 to the power of the number of rules patterns, whatever its
size, and only their numbers take part in the estimation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[ \x09-\x0D]"
#: Symbols that count, all of them marks.
SYMBOLS, MARKS = "[#*$%&|<>]", r"[\p{P}\p{S}]+"
#: A rule votes bad where its measure is the first number or more, good where it is the second or less, and abstains between.
RULES = {
    "symbols": (0.10, 0.02), "marks": (0.10, 0.05), "dup_lines": (0.30, 0.05), "repeats": (0.40, 0.20),
    "capitals": (0.40, 0.15), "lengths": (0.50, 0.0), "short_lines": (0.40, 0.20),
}
#: What the estimation starts from: the share of good texts, and of right votes on good and on bad ones; each counts as WEIGHT texts.
PRIOR, RIGHT_GOOD, RIGHT_BAD, WEIGHT = 0.8, 0.95, 0.5, 10.0
ROUNDS = 60


def _once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of a value that is worked out once, however often the rule reads it."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many of ``words`` lie in runs of ``window`` words that occur twice or more.

    A number for each run holds 36 bits of its hash above its place (28 bits; no array holds
    more), so equal runs are neighbours among the sorted numbers.  Neighbours of equal hash are
    compared by their words; where that shows a collision of hashes, all runs with a repeated
    hash are sorted by their words instead, so the count is exact.
    """
    bits = 28
    run = lambda ws, i: F.concat_ws(" ", *(F.get(ws, i + k) for k in range(window)))
    place = lambda key: key.bitwiseAND((1 << bits) - 1).cast("int")
    apart = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), bits)

    def keys(ws: Column) -> Column:
        full = lambda hs: F.slice(hs, 1, F.greatest(F.size(hs) - (window - 1), F.lit(0)))
        key = lambda hs: lambda x, i: F.shiftleft(F.xxhash64(x, *(F.get(hs, i + k) for k in range(1, window))), bits).bitwiseOR(i.cast("bigint"))
        return F.sort_array(_once(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: F.transform(full(hs), key(hs))))

    def alike(sorted_keys: Column) -> Column:
        return _once(sorted_keys, lambda s: F.filter(s, lambda x, i: F.least(apart(x, F.get(s, i + 1)), apart(x, F.get(s, i - 1))) == 0))

    def clash(ws: Column, s: Column) -> Column:
        pairs = F.transform(s, lambda x, i: F.struct(x.alias("x"), F.get(s, i + 1).alias("y")))
        return F.exists(pairs, lambda p: (apart(p["x"], p["y"]) == 0) & (run(ws, place(p["x"])) != run(ws, place(p["y"]))))

    def by_words(ws: Column, s: Column) -> Column:
        held = F.sort_array(F.transform(s, lambda x: F.struct(run(ws, place(x)).alias("run"), place(x).alias("at"))))
        same = lambda h, x, i: F.coalesce(F.get(h, i)["run"] == x["run"], F.lit(False))
        return _once(held, lambda h: F.transform(F.filter(h, lambda x, i: same(h, x, i + 1) | same(h, x, i - 1)), lambda x: x["at"]))

    def covered(places: Column) -> Column:
        later = lambda k: F.transform(places, lambda i: i + k)
        return F.size(reduce(F.array_union, (later(k) for k in range(1, window)), places)).cast("bigint")

    found = lambda ws: _once(alike(keys(ws)), lambda s: F.when(clash(ws, s), by_words(ws, s)).otherwise(F.transform(s, place)))
    return _once(words, lambda ws: _once(found(ws), covered))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals,
    n_marks) of every text.

    Words are runs of other characters than space and U+0009 to U+000D, lines are those with a
    word, and a line is a duplicate if an earlier one is equal to it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    wide = lambda c: c.cast("bigint")

    def of_words(parts: Column) -> Column:
        held = lambda ws: F.struct(
            wide(F.size(ws)).alias("n_words"), wide(F.size(parts) - 1).alias("n_spaces"), repeated_words(ws).alias("n_repeat_words")
        )
        return _once(F.array_remove(parts, ""), held)

    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    of_lines = _once(lines, lambda ls: F.struct(wide(F.size(ls)).alias("n_lines"), wide(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    marks = F.array_join(F.regexp_extract_all("t", F.lit(MARKS), F.lit(0)), "")
    of_marks = _once(marks, lambda m: F.struct(wide(F.length(m)).alias("n_marks"), wide(F.regexp_count(m, F.lit(SYMBOLS))).alias("n_symbols")))
    found = rows.select(
        "doc_id", _once(F.split("t", SPACE, -1), of_words).alias("w"), of_lines.alias("l"), wide(F.length("t")).alias("n_chars"),
        of_marks.alias("m"), wide(F.regexp_count("t", F.lit(r"\p{Lu}"))).alias("n_capitals"),
    )
    return found.select("doc_id", "w.n_words", (F.col("n_chars") - F.col("w.n_spaces")).alias("word_chars"), "m.n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_capitals", "m.n_marks")


def measures() -> dict[str, Column]:
    """What each rule reads, from :func:`counts`; null, so that it abstains, where a text has nothing to measure."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    mean = share("word_chars", "n_words")
    return {
        "symbols": share("n_symbols", "n_words"),
        "marks": share("n_marks", "word_chars"),
        "dup_lines": F.when(F.col("n_lines") > 1, share("n_dup_lines", "n_lines")),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "lengths": F.greatest(F.lit(0.0), 1 - mean / 3, 1 - 10 / mean),
        "short_lines": share("n_lines", "n_words"),
    }


def vote(counted: DataFrame, rules: dict[str, tuple[float, float]] = RULES) -> DataFrame:
    """Add ``votes``: for each rule 1 (good), -1 (bad) or 0 (abstains)."""
    known = measures()
    one = lambda name, bad, good: F.when(known[name] >= bad, -1).when(known[name] <= good, 1).otherwise(0)
    return counted.withColumn("votes", F.array(*(one(name, *limits) for name, limits in rules.items())))


def fit(patterns: Column, rules: int, rounds: int = ROUNDS) -> Column:
    """Struct (prior, good, bad) after ``rounds`` of expectation-maximisation over patterns, an array of (votes, n).

    ``prior`` is the share of good texts, ``good`` and ``bad`` say how often each rule that votes
    is right about good and about bad texts.  The starting values count as WEIGHT texts, and a
    rule that is no better than chance is held at chance, so good and bad cannot change places.
    """
    number = F.lit(0.0)
    total = lambda xs, f: F.aggregate(xs, number, lambda s, x: s + f(x))

    def step(now: Column) -> Column:
        weighed = F.transform(patterns, lambda x: _once(posterior(x["votes"], now), lambda p: F.struct(x["votes"].alias("votes"), (x["n"] * p).alias("g"), (x["n"] * (1 - p)).alias("b"))))

        def shares(xs: Column) -> Column:
            share = lambda j, side, vote, start: (
                (WEIGHT * start + total(xs, lambda x: F.when(x["votes"][j] == vote, x[side]).otherwise(number)))
                / (WEIGHT + total(xs, lambda x: F.when(x["votes"][j] != 0, x[side]).otherwise(number)))
            )
            every = F.sequence(F.lit(0), F.lit(rules - 1))
            good = F.transform(every, lambda j: share(j, "g", 1, RIGHT_GOOD))
            bad = F.transform(every, lambda j: share(j, "b", -1, RIGHT_BAD))
            prior = (WEIGHT * PRIOR + total(xs, lambda x: x["g"])) / (WEIGHT + total(xs, lambda x: x["g"] + x["b"]))
            held = lambda g: F.struct(prior.alias("prior"), g.alias("good"), F.zip_with(g, bad, lambda a, b: F.greatest(b, 1 - a)).alias("bad"))
            return _once(good, held)

        return _once(weighed, shares)

    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(RIGHT_GOOD), rules).alias("good"), F.array_repeat(F.lit(RIGHT_BAD), rules).alias("bad"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda now, _: step(now))


def posterior(votes: Column, known: Column) -> Column:
    """The probability that a text with these votes is good, by accuracies (prior, good, bad)."""
    up = F.zip_with(known["good"], known["bad"], lambda g, b: F.struct(F.log(g / (1 - b)).alias("good"), F.log((1 - g) / b).alias("bad")))
    told = F.zip_with(votes, up, lambda v, t: F.when(v == 1, t["good"]).when(v == -1, t["bad"]).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-F.aggregate(told, F.log(known["prior"] / (1 - known["prior"])), lambda s, x: s + x)))


def estimate(voted: DataFrame, rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """Rows (votes, n, p_good, accuracies) of each pattern that occurs: at most 3 to the power of ``rules``.

    Texts are counted by pattern; the patterns, in order, are one array, over which a single
    expression runs all rounds.
    """
    seen = voted.groupBy("votes").agg(F.count("*").alias("n"))
    one = seen.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # a bounded number of rows
    known = one.select(_once(F.col("patterns"), lambda ps: F.struct(ps.alias("patterns"), fit(ps, rules, rounds).alias("known"))).alias("e"))
    each = known.select(F.col("e.known").alias("accuracies"), F.inline("e.patterns"))
    return each.select("votes", "n", posterior(F.col("votes"), F.col("accuracies")).alias("p_good"), "accuracies")


def judge(docs: DataFrame, rules: dict[str, tuple[float, float]] = RULES, least: float = 0.5, least_words: int = 50, most_repeats: int = 50,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, counts, votes, p_good, base_failed, kept) of every document.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeats`` percent of
    them in repeated runs of three.  ``kept``: not so, and the posterior is ``least`` or more.
    Accuracies are estimated over all documents, those of the table itself, without labels.  A null
    or empty text has no word, so it fails; a null doc_id is a row like any other; rows that
    repeat are separate rows with equal results and count each; texts of any length are read
    whole; an empty table gives none; other columns are ignored.
    """
    voted = stored(vote(counts(docs, id_col, text_col), rules))
    known = F.broadcast(estimate(voted, len(rules)).select("votes", "p_good"))  # a row for each pattern
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return voted.join(known, "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= least))
