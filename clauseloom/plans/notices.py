"""Segmentation of notices made from the parts: one template for each thing a block can become.

Both engines read the same texts; the SQL states what each template's clauses are, Spark finds them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import diagnose, segment

from .registry import Registry
from .state import RELATIONS, _rel, _with

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_NL, _GAP = "chr(10)", "chr(10), chr(10)"
#: Text, and the clauses (reference, text, source, verdict, rescued_by) and drops (text, rule) to be found, of each template.
_TEMPLATES = [
    # a table without columns, in two blocks, under a clause that points to it
    (f"concat('1. Branches shall keep the ', p_name, ' limits given below:', {_GAP}, 'Town ', p_size, {_NL}, 'Village ', p_size + 1, {_GAP}, 'City ', p_size + 2, {_GAP}, '2. Staff must keep the ', p_name, ' register in the vault.')",
     [("'1'", f"concat('1. Branches shall keep the ', p_name, ' limits given below:', {_NL}, 'Town ', p_size, {_NL}, 'Village ', p_size + 1, {_NL}, 'City ', p_size + 2)", f"split_part(text, concat({_GAP}, '2. '), 1)", "obligation", None),
      ("'2'", "concat('2. Staff must keep the ', p_name, ' register in the vault.')", "concat('2. Staff must keep the ', p_name, ' register in the vault.')", "obligation", None)], []),
    # the same lines in the clause's own block
    (f"concat('1. Branches shall keep the ', p_name, ' limits.', {_NL}, 'They are given below:', {_NL}, 'Town ', p_size, {_NL}, 'Village ', p_size + 1, {_NL}, '2. Staff must keep the ', p_name, ' register in the vault.')",
     [("'1'", f"concat('1. Branches shall keep the ', p_name, ' limits. They are given below:', {_NL}, 'Town ', p_size, {_NL}, 'Village ', p_size + 1)", f"split_part(text, concat({_NL}, '2. '), 1)", "obligation", None),
      ("'2'", "concat('2. Staff must keep the ', p_name, ' register in the vault.')", "concat('2. Staff must keep the ', p_name, ' register in the vault.')", "obligation", None)], []),
    # a table that nothing points to, right under a clause, is kept whole
    (f"concat('1. Branches shall keep a register of the ', p_name, ' in the vault.', {_GAP}, 'Town branches of ', p_brand, ' ', p_size, {_NL}, 'Village branches ', p_size + 1, {_GAP}, 'The manager must sign the register of the ', p_name, '.')",
     [("'1'", "concat('1. Branches shall keep a register of the ', p_name, ' in the vault.')", "concat('1. Branches shall keep a register of the ', p_name, ' in the vault.')", "obligation", None),
      ("'table'", f"concat('Town branches of ', p_brand, ' ', p_size, {_NL}, 'Village branches ', p_size + 1)", f"concat('Town branches of ', p_brand, ' ', p_size, {_NL}, 'Village branches ', p_size + 1)", "none", None),
      ("NULL", "concat('The manager must sign the register of the ', p_name, '.')", "concat('The manager must sign the register of the ', p_name, '.')", "obligation", None)], []),
    # short lines at the top are a letterhead, not a table
    (f"concat(upper(p_brand), ' OFFICE', {_NL}, 'Notice', {_GAP}, '1. Branches shall count the ', p_name, ' each day.')",
     [("'1'", "concat('1. Branches shall count the ', p_name, ' each day.')", "concat('1. Branches shall count the ', p_name, ' each day.')", "obligation", None)],
     [(f"concat(upper(p_brand), ' OFFICE', {_NL}, 'Notice')", "too short")]),
    # sentences that go on over gaps
    (f"concat('1. The register of the ', p_name, ' shall be', {_GAP}, 'maintained for the purpose', {_GAP}, 'and signed by the officer.', {_GAP}, '2. Staff must report every case of ', p_brand, '.')",
     [("'1'", "concat('1. The register of the ', p_name, ' shall be maintained for the purpose and signed by the officer.')", f"split_part(text, concat({_GAP}, '2. '), 1)", "obligation", None),
      ("'2'", "concat('2. Staff must report every case of ', p_brand, '.')", "concat('2. Staff must report every case of ', p_brand, '.')", "obligation", None)], []),
    # a list inside a numbered sentence
    ("concat('1. Banks shall ensure the following: (a) the ', p_name, ' are counted each evening; (b) the keys are kept apart from the ', p_brand, '.')",
     [("'1'", "concat('1. Banks shall ensure the following: (a) the ', p_name, ' are counted each evening;')", "text", "obligation", None),
      ("'1'", "concat('1. Banks shall ensure the following: (b) the keys are kept apart from the ', p_brand, '.')", "text", "obligation", None)], []),
    # marks that start in the middle of a sequence are a quotation
    ("concat('He read vi. the rule on the ', p_name, ' and vii. the rule on ', p_brand, ' aloud, and staff must obey.')",
     [("NULL", "text", "text", "obligation", None)], []),
    # a list over blocks; a numbered paragraph ends its stem
    (f"concat('3. The plan for ', p_brand, ' shall cover these points:', {_GAP}, 'a) every branch that holds the ', p_name, ';', {_GAP}, 'b) every machine of size ', p_size, ' that gives out cash.', {_GAP}, '4. The ', p_name, ' is sold in many shops of the town.')",
     [("NULL", "concat('3. The plan for ', p_brand, ' shall cover these points: a) every branch that holds the ', p_name, ';')", "concat('a) every branch that holds the ', p_name, ';')", "obligation", None),
      ("NULL", "concat('3. The plan for ', p_brand, ' shall cover these points: b) every machine of size ', p_size, ' that gives out cash.')", "concat('b) every machine of size ', p_size, ' that gives out cash.')", "obligation", None),
      ("'4'", "concat('4. The ', p_name, ' is sold in many shops of the town.')", "concat('4. The ', p_name, ' is sold in many shops of the town.')", "none", None)], []),
    # a sentence broken over narrow lines is no noise; page numbers are
    (f"concat('Staff must keep', {_NL}, 'the ', p_brand, ' keys.', {_GAP}, 'page ', p_size, {_GAP}, 'Loans of the ', p_name, ' are made by the branches of the bank.')",
     [("NULL", "concat('Staff must keep the ', p_brand, ' keys.')", f"concat('Staff must keep', {_NL}, 'the ', p_brand, ' keys.')", "obligation", None),
      ("NULL", "concat('Loans of the ', p_name, ' are made by the branches of the bank.')", "concat('Loans of the ', p_name, ' are made by the branches of the bank.')", "none", None)],
     [("concat('page ', p_size)", "too short")]),
    # a heading that states a duty comes back
    (f"concat('ALL BRANCHES SHALL COUNT THE CASH OF ', upper(p_brand), {_GAP}, 'The ', p_name, ' is counted by the teller of the branch.')",
     [("NULL", "concat('ALL BRANCHES SHALL COUNT THE CASH OF ', upper(p_brand))", "concat('ALL BRANCHES SHALL COUNT THE CASH OF ', upper(p_brand))", "obligation", "heading"),
      ("NULL", "concat('The ', p_name, ' is counted by the teller of the branch.')", "concat('The ', p_name, ' is counted by the teller of the branch.')", "none", None)], []),
    # nothing but noise: the longer lines
    (f"concat('NOTICE ', p_size, ' TO ALL OFFICES OF ', upper(p_brand), {_GAP}, 'Page 7')",
     [("NULL", "concat('NOTICE ', p_size, ' TO ALL OFFICES OF ', upper(p_brand))", "concat('NOTICE ', p_size, ' TO ALL OFFICES OF ', upper(p_brand))", "none", None)],
     [("concat('NOTICE ', p_size, ' TO ALL OFFICES OF ', upper(p_brand))", "heading"), ("'Page 7'", "too short")]),
    # a marked table that the clause above points to, and what follows it
    (f"concat('1. Branches shall keep the ', p_name, ' limits given below:', {_NL}, '[table]', {_NL}, '[row 1] Town | ', p_size, {_NL}, '[row 2] Village | 7', {_NL}, '[/table]', {_NL}, 'They are checked each day.')",
     [("'1'", f"concat('1. Branches shall keep the ', p_name, ' limits given below:', {_NL}, 'Town | ', p_size, {_NL}, 'Village | 7', {_NL}, 'They are checked each day.')", "text", "obligation", None)], []),
    # one that nothing points to, with a cell of two lines
    (f"concat('The ', p_name, ' register is kept in the vault of the branch.', {_GAP}, '[table]', {_NL}, '[row 1] Town branches | ', p_size, {_NL}, '[row 2] Village branches', {_NL}, 'and agents | 7', {_NL}, '[/table]', {_GAP}, 'Staff must sign the ', p_name, ' register.')",
     [("NULL", "concat('The ', p_name, ' register is kept in the vault of the branch.')", "concat('The ', p_name, ' register is kept in the vault of the branch.')", "none", None),
      ("'table'", f"concat('Town branches | ', p_size, {_NL}, 'Village branches and agents | 7')", f"concat('Town branches | ', p_size, {_NL}, '[row 2] Village branches', {_NL}, 'and agents | 7')", "none", None),
      ("NULL", "concat('Staff must sign the ', p_name, ' register.')", "concat('Staff must sign the ', p_name, ' register.')", "obligation", None)], []),
    # a table of requirements is a clause for each row
    (f"concat('[table]', {_NL}, '[row 1] A-1 | Every branch of the town shall report its ', p_name, ' to the office at once | 01-Oct', {_NL}, '[row 2] Second | Staff must count the cash of the day in the evening before they go home | ', p_size, {_NL}, '[/table]', {_NL}, 'Loans of the ', p_name, ' are made by the branches.')",
     [("'A-1'", "concat('A-1 | Every branch of the town shall report its ', p_name, ' to the office at once | 01-Oct')", "concat('A-1 | Every branch of the town shall report its ', p_name, ' to the office at once | 01-Oct')", "obligation", None),
      ("'row 2'", "concat('Second | Staff must count the cash of the day in the evening before they go home | ', p_size)", "concat('Second | Staff must count the cash of the day in the evening before they go home | ', p_size)", "obligation", None),
      ("NULL", "concat('Loans of the ', p_name, ' are made by the branches.')", "concat('Loans of the ', p_name, ' are made by the branches.')", "none", None)], []),
    # and a document of which nothing is left
    (f"concat('Page ', p_size)", [], [("concat('Page ', p_size)", "too short")]),
]

RELATIONS["notices"] = ("part", ("p_partkey AS doc_id", f"CASE p_partkey % {len(_TEMPLATES)} " + " ".join(f"WHEN {k} THEN {t[0]}" for k, t in enumerate(_TEMPLATES)) + " END AS text", "p_name", "p_brand", "p_size"), "true")

_ROUGH = next(k for k, t in enumerate(_TEMPLATES) if "TO ALL OFFICES" in t[0])
_S = lambda v: "NULL" if v is None else f"'{v}'"
_CLAUSES = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS sequence, {ref} AS clause_ref, {text} AS text, {source} AS source, {_S(verdict)} AS verdict, {_S(rescued)} AS rescued_by, '{'obligation-lines' if k == _ROUGH else 'structure'}' AS rung FROM notices WHERE doc_id % {len(_TEMPLATES)} = {k}"
    for k, (_, found, _) in enumerate(_TEMPLATES)
    for n, (ref, text, source, verdict, rescued) in enumerate(found, 1)
)
_DROPS = " UNION ALL ".join(f"SELECT doc_id, {text} AS text, '{rule}' AS rule FROM notices WHERE doc_id % {len(_TEMPLATES)} = {k}" for k, (_, _, gone) in enumerate(_TEMPLATES) for text, rule in gone)


def _found(spark, sf):
    docs = _rel(spark, sf, "notices").select("doc_id", "text")
    return docs, *segment.clauses(docs, loose=True)


@query(f"{_with('notices')} {_CLAUSES}")
def notice_clauses(spark, sf):
    """Clauses of the notices, in order, with the piece of the source that their offsets cut out."""
    docs, found, _ = _found(spark, sf)
    texts = docs.select("doc_id", T.clean("text").alias("whole"))
    source = F.expr("substring(whole, int(char_start + 1), int(char_end - char_start))")
    rows = found.join(texts, "doc_id")
    return rows.select("doc_id", F.col("sequence").cast("long").alias("sequence"), "clause_ref", "text", source.alias("source"), "verdict", "rescued_by", "rung")


@query(f"{_with('notices')} {_DROPS}")
def notice_drops(spark, sf):
    """Fragments of the notices that a noise rule took and no duty brought back."""
    return _found(spark, sf)[2].select("doc_id", "text", "rule")


@query(f"{_with('notices')} SELECT doc_id, CASE WHEN doc_id % {len(_TEMPLATES)} = {len(_TEMPLATES) - 1} THEN 'no clauses found at all' ELSE '' END AS warning FROM notices")
def notice_warnings(spark, sf):
    """Quality flags of the notices' splits."""
    docs, found, _ = _found(spark, sf)
    return segment.split_warnings(docs, found)


@query(f"""{_with('notices')}, c AS ({_CLAUSES}), l AS (SELECT doc_id, sequence AS clause, string_split(text, chr(10)) AS ls FROM c WHERE verdict IN ('obligation', 'supersession'))
  SELECT doc_id, clause, 1 AS sequence, array_to_string(ls, chr(10)) AS text FROM l""")
def notice_duties(spark, sf):
    """Duties of the notices' clauses: each states one, and carries the rows under it."""
    _, found, _ = _found(spark, sf)
    rows = segment.obligations(found)
    return rows.select("doc_id", F.col("clause").cast("long").alias("clause"), F.col("sequence").cast("long").alias("sequence"), "text")


_SPANS = f"""c AS ({_CLAUSES}), s AS (SELECT doc_id, strpos(n.text, source) - 1 AS a, strpos(n.text, source) - 1 + length(source) AS b FROM c JOIN notices n USING (doc_id)),
  r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  i AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM r), m AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM i GROUP BY doc_id, island)"""


@query(f"""{_with('notices')}, {_SPANS}, k AS (SELECT doc_id, sum(b - a) AS covered FROM m GROUP BY 1)
  SELECT doc_id, length(text) AS size, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(100.0::DOUBLE * coalesce(covered, 0) / greatest(length(text), 1), 1) AS percent FROM notices LEFT JOIN k USING (doc_id)""")
def notice_coverage(spark, sf):
    """How much of each notice ended up inside a clause."""
    docs, found, _ = _found(spark, sf)
    return diagnose.captured(docs.select("doc_id", T.clean("text").alias("text")), found)


@query(f"""{_with('notices')}, {_SPANS}, g AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM m UNION ALL SELECT doc_id, coalesce(e, 0), length(text) FROM notices LEFT JOIN (SELECT doc_id, max(b) AS e FROM m GROUP BY 1) USING (doc_id)),
  t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y - x DESC, x) AS rank FROM g WHERE y - x > 6)
  SELECT doc_id, rank, x AS char_start, y AS char_end, replace(substring(text, x + 1, least(y - x, 120)), chr(10), ' / ') AS excerpt FROM t JOIN notices USING (doc_id) WHERE rank <= 5""")
def notice_gaps(spark, sf):
    """The longest stretches of each notice that became no clause."""
    docs, found, _ = _found(spark, sf)
    return diagnose.gaps(docs.select("doc_id", T.clean("text").alias("text")), found, least=6)


@query(f"{_with('notices')}, d AS ({_DROPS}) SELECT doc_id, rule, count(*) AS n FROM d GROUP BY ALL")
def notice_drop_histogram(spark, sf):
    """What each noise rule took of each notice."""
    return diagnose.by_rule(_found(spark, sf)[2])
