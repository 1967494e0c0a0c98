"""Text functions as Columns: clean-up, noise rules, classification, duties, drafting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _once(value: Column, rule) -> Column:
    """``rule`` of a value that is worked out once, however often the rule reads it."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def _holds(text: Column, *signs: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in signs))


def clean(text: Column | str) -> Column:
    """Line ends, no-break spaces, runs of blanks and of empty lines; all offsets refer to this form.

    Each expression is for texts that have something for it, as plain search is far cheaper.
    """
    steps = (
        (lambda t: _holds(t, "\r"), lambda t: F.regexp_replace(t, r"\r\n?", "\n")),
        (lambda t: _holds(t, "\u00a0"), lambda t: F.regexp_replace(t, "\u00a0", " ")),
        (lambda t: _holds(t, "\t", "  "), lambda t: F.regexp_replace(t, r"[ \t]+", " ")),
        (lambda t: _holds(t, "\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")),
        (lambda t: F.substring(t, 1, 1).rlike(r"\s") | F.substring(t, -1, 1).rlike(r"[\s\u0085\u2028\u2029]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")),
    )
    return reduce(lambda t, step: _once(t, lambda x: F.when(step[0](x), step[1](x)).otherwise(x)), steps, _c(text))


def has_text(text: Column | str) -> Column:
    """Whether anything is left of a text by :func:`clean`, without making it; false for null."""
    return F.coalesce(_c(text).rlike(r"[^\s\u00a0]"), F.lit(False))


def flat(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s{2,}|[^\S ]", " "))


def tokens(text: Column | str) -> Column:
    """Lower-case alphanumeric tokens of three characters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*L.STOP_WORDS))


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_c(text), F.lit(L.WORDS), F.lit(0)))


def looks_like_heading(text: Column | str) -> Column:
    """Short, no sentence end, and mostly capitals or every larger word capitalised."""
    t = _c(text)
    letters = F.regexp_replace(t, r"[^A-Za-z]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^A-Z]", ""))
    words = F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z'’]*"), F.lit(0))
    small = F.array(*(F.lit(w) for w in L.SMALL_WORDS))
    large = F.filter(words, lambda w: ~F.array_contains(small, F.lower(w)))
    shape = (F.length(letters) == 0) | (capitals >= 0.6 * F.length(letters)) | ((F.size(large) > 0) & F.forall(large, lambda w: w.rlike("^[A-Z]")))
    return (t != "") & ~t.rlike(L.SENTENCE_END) & ~t.rlike(L.MANY_WORDS) & shape  # cheap tests first


def _noise(t: Column) -> Column:
    n = F.size(F.split(t, " "))
    title = F.regexp_replace(F.regexp_extract(t, L.CONTENTS_ENTRY, 1), r":+\s*$", "")
    return (
        F.when(F.length(t) < L.MIN_FRAGMENT, "too short")
        .when(t.rlike(L.EMAIL_HEADER) & (n <= 20), "email header")
        .when(t.rlike(L.PAGE_FURNITURE), "page number")
        .when(t.rlike(L.SIGNATURE), "signature")
        .when(t.rlike(L.SALUTATION) & (n <= 6), "salutation")
        .when(t.rlike(L.SIGN_OFF), "sign-off")
        .when(F.substring(t, -3, 3).rlike(L.CONTENTS_END) & t.rlike(L.CONTENTS_ENTRY) & looks_like_heading(title), "contents entry")
        .when(looks_like_heading(t), "heading")
    )


def noise_rule(text: Column | str) -> Column:
    """The rule that makes a fragment structural noise, or null for content; the first that holds."""
    return _once(flat(F.coalesce(_c(text), F.lit(""))), _noise)


def block_noise(lines: Column | str) -> Column:
    """The rule that makes a whole block noise, or null: all its lines are, and none is a table's.

    Lines that are only too short are judged once more as one, joined by spaces.
    """

    def rule(ls: Column) -> Column:
        rules = F.transform(ls, noise_rule)
        return _once(rules, lambda rs: F.coalesce(F.get(F.filter(rs, lambda r: r != "too short"), F.lit(0)), noise_rule(F.array_join(ls, " "))))

    row = lambda t: t.rlike(L.SHEET_ROW) | t.isin("[table]", "[/table]") | t.contains(" | ")
    return _once(_c(lines), lambda ls: F.when((F.size(ls) > 0) & ~F.exists(ls, row) & ~F.exists(ls, lambda t: noise_rule(t).isNull()), rule(ls)))


def points_to_data(piece: Column | str) -> Column:
    """Whether the last sentence of a piece's wording refers to what follows it."""
    wording = F.trim(F.split(F.coalesce(_c(piece), F.lit("")), "\n")[0])
    last = F.regexp_replace(wording, r"^.*[.:;]\s+(?=" + L.SENTENCE_START + ")", "")
    return ~wording.startswith("###") & wording.rlike("[.:;]$") & last.rlike(L.POINTS_FORWARD)


def list_mark(piece: Column | str) -> Column:
    """The letter or number that marks a list item: empty for a bullet, null for what is no item."""
    t = _c(piece)
    return F.when(t.rlike(L.LIST_ITEM), F.regexp_extract(t, L.LIST_MARK, 1))


def inline_list(piece: Column | str) -> Column:
    """(stem, items) of the first family of marks that makes a list inside a piece, or null.

    A list has two items or more of MIN_FRAGMENT characters, and its first mark opens a sequence;
    a list that starts in the middle of one is a quotation.  The stem is what precedes the first
    mark, and a numbered sentence before items with other marks is one too.
    """

    def family(t: Column, pattern: str) -> Column:
        parts = F.filter(F.transform(F.split(t, pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

        def read(ps: Column) -> Column:
            head, second = list_mark(ps[0]), F.get(F.transform(ps, list_mark), F.lit(1))
            stemmed = F.coalesce(head.rlike(r"^\d+$") & ~second.rlike(r"^\d+$"), F.lit(False))
            items = F.filter(F.when(stemmed, F.slice(ps, 2, 2**30)).otherwise(ps), lambda p: p.rlike(L.LIST_ITEM) & (F.length(p) >= L.MIN_FRAGMENT))
            stem = F.when(stemmed | head.isNull(), ps[0]).otherwise("")
            return F.when((F.size(items) >= 2) & list_mark(F.get(items, F.lit(0))).isin(*L.OPENERS), F.struct(stem.alias("stem"), items.alias("items")))

        return _once(parts, read)

    some = _holds(_c(piece), ")", "•", "▪") | _c(piece).rlike(L.LIST_SIGN)
    return F.when(some, _once(_c(piece), lambda t: F.coalesce(*(F.when(t.rlike(pattern), family(t, pattern)) for pattern in L.LIST_FAMILIES))))


def is_data_table(rows: Column | str) -> Column:
    """Whether every cell of every row has at most eight words."""
    return F.forall(_c(rows), lambda r: F.forall(F.split(r, r" \| "), lambda c: F.size(F.split(F.trim(c), r"\s+")) <= L.DATA_CELL_WORDS))


def row_reference(number: Column, body: Column) -> Column:
    """A row's own clause id if its first cell looks like one, else ``row N``."""
    first = F.trim(F.split(body, r"\|")[0])
    return F.when(first.rlike(L.ROW_REF), first).otherwise(F.concat(F.lit("row "), number))


def strata(text: Column | str, hints=L.STRATA, default: str = L.DEFAULT_STRATA) -> Column:
    """The first subject whose hint occurs."""
    t, out = F.lower(_c(text)), F
    for name, pattern in hints:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise(default)


def department(subject: Column | str, fallback: Column | None = None) -> Column:
    known = F.create_map(*(F.lit(x) for pair in L.DEPARTMENT_OF_STRATA.items() for x in pair))
    return F.coalesce(known[_c(subject)], *([fallback] if fallback is not None else []), F.lit("BA"))


def _finds(t: Column, pattern: str) -> Column:
    """``t.rlike(pattern)``; texts without any of the words that the pattern needs are not searched."""
    signs = L.SIGNS.get(pattern)
    return _once(F.lower(t), lambda x: _holds(x, *signs)) & t.rlike(pattern) if signs else t.rlike(pattern)


def classify(text: Column | str, informational: str = L.INFORMATIONAL, supersession: str = L.SUPERSESSION, obligation: str = L.OBLIGATION) -> Column:
    """``information``, ``supersession``, ``obligation`` or ``none``, in that order."""
    t = _c(text)
    return (
        F.when(F.substring(F.trim(t), 1, 160).rlike(informational), "information")
        .when(_finds(t, supersession), "supersession")
        .when(_finds(t, obligation), "obligation")
        .otherwise("none")
    )


def duties(text: Column | str) -> Column:
    """The distinct duties of a clause: later ones get its subject; the whole clause if there are not two."""
    t = F.trim(_c(text))
    lines = F.split(t, "\n")
    wording = F.trim(lines[0])
    attached = F.filter(F.transform(F.slice(lines, 2, 2**30), F.trim), lambda x: x != "")
    strip = lambda p: F.regexp_replace(p, r"^[ ,;]+|[ ,;]+$", "")
    parts = F.filter(F.transform(F.split(wording, L.DUTY_JOIN), strip), lambda p: p != "")
    subject = F.trim(F.regexp_replace(F.trim(F.split(F.split(wording, " shall")[0], " must")[0]), L.LIST_ITEM, ""))
    subject = F.when(F.length(subject) > 60, "").otherwise(subject)
    full = F.filter(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.trim(F.concat(subject, F.lit(" "), p)))), lambda p: F.length(p) >= L.MIN_DUTY)
    each = F.transform(F.slice(full, 1, L.MAX_DUTIES), lambda p: F.array_join(F.concat(F.array(p), attached), "\n"))
    return F.when((F.size(parts) < 2) | (F.size(full) < 2), F.array(t)).otherwise(each)


def cited_references(text: Column | str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(L.CITED), F.lit(0))
    return F.transform(found, flat)


def normal_reference(reference: Column | str) -> Column:
    """Lower case, marks as spaces, no leading zero after ``no``."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(reference), F.lit(""))), "[^a-z0-9 ]", " ")
    return flat(F.regexp_replace(t, r"\bno\s*0*(\d+)", "no $1"))


def lower_first(text: Column | str) -> Column:
    t = _c(text)
    keep = F.split(t, " ")[0].rlike("^.+[A-Z]")
    return F.when(keep | (t == ""), t).otherwise(F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 2**30)))


def draft_test(text: Column | str) -> Column:
    """A ``Check that …`` sentence from a clause's first line, its attached lines below."""
    lines = F.split(F.trim(_c(text)), "\n")
    raw = F.trim(lines[0])
    cells = F.filter(F.transform(F.split(raw, r"\|"), F.trim), lambda s: s != "")
    carrying = F.filter(cells, lambda s: s.rlike(L.CARRYING))
    longest = F.array_max(F.transform(cells, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    body = F.when(raw.contains("|"), F.coalesce(F.get(carrying, F.lit(0)), longest, F.lit(""))).otherwise(raw)
    body = flat(F.regexp_replace(body, L.DRAFT_MARK, ""))
    halves = F.split(body, L.DUTY_VERB, 2)
    who = F.regexp_replace(F.trim(halves[0]), ",+$", "")
    plural = who.rlike(L.PLURAL)
    duty = F.trim(F.get(halves, F.lit(1)))
    be, do = F.when(plural, "are").otherwise("is"), F.when(plural, "do").otherwise("does")
    rest = lambda pattern: F.regexp_replace(duty, pattern, "")
    duty = (
        F.when(duty.rlike(L.NOT_BE), F.concat(be, F.lit(" not "), rest(L.NOT_BE)))
        .when(duty.rlike(L.NOT), F.concat(do, F.lit(" not "), rest(L.NOT)))
        .when(duty.rlike(L.BE), F.concat(be, F.lit(" "), rest(L.BE)))
        .otherwise(duty)
    )
    said = F.when((F.size(halves) > 1) & (who != ""), F.concat(lower_first(who), F.lit(" "), duty)).otherwise(lower_first(body))
    ended = lambda s: F.regexp_replace(s, r"\.+$", "")
    sentence = ended(F.trim(F.split(F.concat(F.lit("Check that "), said), r"\. ")[0]))
    fuller = F.regexp_replace(flat(F.regexp_replace(raw, r"\|", " ")), L.DRAFT_NUMBER, "")
    sentence = F.when(F.length(sentence) < L.DRAFT_SHORT, ended(F.concat(F.lit("Check that "), lower_first(fuller)))).otherwise(sentence)
    short = F.concat(F.regexp_replace(F.substring(sentence, 1, L.DRAFT_LONG - 3), r" [^ ]*$", ""), F.lit("…"))
    sentence = F.concat(F.when(F.length(sentence) > L.DRAFT_LONG, short).otherwise(sentence), F.lit("."))
    attached = F.filter(F.transform(F.slice(lines, 2, 2**30), F.trim), lambda x: x != "")
    return F.array_join(F.concat(F.array(sentence), attached), "\n")


def exception_wording(proposed: Column | str) -> Column:
    first = F.regexp_replace(F.split(_c(proposed), "\n")[0], r"^Check that (.*?)\.*$", "$1")
    return F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 2**30), F.lit(" — not complied with."))


def root_cause(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return (
        F.when(t.rlike(L.SYSTEM_GAP), "System Gap")
        .when(t.rlike(L.POLICY_GAP), "Policy Gap")
        .when(t.rlike(L.PROCESS_GAP), "Process / Procedure Gap")
        .otherwise("Implementation Gap")
    )


def risk(text: Column | str) -> Column:
    return F.when(F.lower(_c(text)).rlike(L.HIGH_RISK), "High").otherwise("Medium")


def change_type(value: Column | str) -> Column:
    """One of the four change types; anything else is ``No action``."""
    t = flat(F.regexp_replace(F.lower(F.coalesce(_c(value), F.lit(""))), "[^a-z ]", " "))
    out = F
    for name in L.CHANGE_TYPES:
        out = out.when(t == name.lower(), name)
    return out.otherwise("No action")


def confidence(value: Column | str) -> Column:
    """A number from 0 to 1 with two decimals: 0.6 for no number, 0 for NaN."""
    v = _c(value).try_cast("double")
    return F.when(v.isNull(), 0.6).when(F.isnan(v), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 2))


def same_wording(a: Column | str, b: Column | str) -> Column:
    normal = lambda x: F.regexp_replace(flat(F.lower(F.coalesce(_c(x), F.lit("")))), "[^a-z0-9 ]", "")
    return (F.trim(normal(a)) != "") & (F.trim(normal(a)) == F.trim(normal(b)))


def serial(day: Column, index: Column, subject: Column) -> Column:
    """ISO year, week, index (two digits at least) and the subject's initials."""
    year, week = F.extract(F.lit("YEAROFWEEK"), day), F.extract(F.lit("WEEK"), day)
    number = F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    initials = F.array_join(F.transform(F.regexp_extract_all(subject, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.concat_ws("-", year.cast("string"), F.lpad(week.cast("string"), 2, "0"), number, initials)


def week_label(day: Column) -> Column:
    """``38 (15.09.2025 - 21.09.2025)``: ISO week, Monday and Sunday."""
    monday = F.date_trunc("week", day)
    return F.format_string("%d (%s - %s)", F.extract(F.lit("WEEK"), day), F.date_format(monday, "dd.MM.yyyy"), F.date_format(F.date_add(monday, 6), "dd.MM.yyyy"))


def is_change(type_col: Column | str = "change_type", status_col: Column | str = "status") -> Column:
    """The live-change predicate that nearly all counts share."""
    return (_c(type_col) != "No action") & (_c(status_col) != "Withdrawn (superseded)")


def page_number(start: Column, length: Column, pages: Column) -> Column:
    return F.floor(start / F.greatest(F.floor(length / F.greatest(pages, F.lit(1))), F.lit(1))).cast("long") + 1


def safe_name(stem: Column | str) -> Column:
    return F.substring(F.regexp_replace(_c(stem), "[^A-Za-z0-9]+", "_"), 1, 55)


def title(text: Column | str, filename: Column | str) -> Column:
    """The first line near the top that is mostly capitals and no boilerplate, else the file's stem."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.transform(F.slice(F.split(F.coalesce(_c(text), F.lit("")), "\n"), 1, L.TITLE_LINES), lambda x: F.regexp_replace(strip(x), r"^\[row \d+\]\s*", ""))
    boilerplate = "|".join(L.NO_TITLE)
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    capitals = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    fits = lambda x: F.length(x).between(12, 110) & (letters(x) > 0) & (capitals(x) / letters(x) > 0.4)
    found = F.filter(lines, lambda x: ~F.lower(x).rlike(boilerplate) & fits(x))
    stem = strip(F.replace(F.regexp_replace(_c(filename), r"(?<=.)\.[^./]*$", ""), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.get(found, F.lit(0)), stem)


def date_of(text: Column | str) -> Column:
    """The first date near the top, as it is written; empty if there is none."""
    return F.regexp_extract(F.substring(F.coalesce(_c(text), F.lit("")), 1, L.DATE_CHARS), L.DATE, 1)


def numeric_depth(reference: Column | str) -> Column:
    """1 for ``3``, 2 for ``3.2``; null for a reference that is no plain number."""
    r = _c(reference)
    return F.when(r.rlike(r"^\d+(\.\d+)*$"), F.size(F.split(r, r"\.")))


def is_unstructured(kind: Column | str) -> Column:
    """Whether text of this kind has lost its tables' structure."""
    return _c(kind).isin(*L.UNSTRUCTURED_KINDS)


def is_data_line(line: Column | str) -> Column:
    """A line that reads as a table row without its columns: short, and neither a duty nor an opener of any kind."""
    t = F.trim(_c(line))
    openers = (L.OBLIGATION, L.NUMBERED, L.LIST_ITEM, L.LEAD_IN, L.INFORMATIONAL, L.SHEET_ROW, L.SECTION)
    out = (t != "") & (word_count(t) <= L.DATA_CELL_WORDS)
    for pattern in openers:
        out = out & ~t.rlike(pattern)
    return out


def is_data_block(block: Column | str) -> Column:
    lines = F.filter(F.split(_c(block), "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, is_data_line)


def relabel(value: Column | str, labels: dict[str, str]) -> Column:
    """``labels`` of a value, the value itself where there is none."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(known[_c(value)], _c(value))
