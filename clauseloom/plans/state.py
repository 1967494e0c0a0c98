"""Document and proposal state, exports and wording rules, on relations derived from the given tables.

The derivations below are read by both engines, so they use only what both understand; the
rules under test are written apart: as Spark operators here and as SQL beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T
from clauseloom.operators import decide, exports, intake, review

from .registry import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Derived relations: (table, columns, filter).
RELATIONS = {
    "props": ("orders", (
        "o_orderkey AS id", "o_custkey AS document_id", "o_orderkey % 11 AS clause_id", "concat('2025-38-', o_orderkey) AS sr_no",
        "CASE o_orderkey % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Amendment' WHEN 2 THEN 'Deletion' ELSE 'No action' END AS change_type",
        "CASE o_orderkey % 7 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Pending approval' WHEN 3 THEN 'Changes requested' WHEN 4 THEN 'Withdrawn (superseded)' ELSE 'Pending review' END AS status",
        "CASE o_orderkey % 3 WHEN 0 THEN 'BA' WHEN 1 THEN 'MA' ELSE 'RR' END AS department", "o_orderpriority AS strata",
        "CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Unrated' END AS risk", "'System Gap' AS root_cause", "concat('because of ', o_orderpriority) AS rationale",
        "CASE WHEN o_orderkey % 5 < 3 THEN concat('T-', o_custkey) ELSE CASE WHEN o_orderkey % 5 = 3 THEN '' END END AS target_code",
        "CASE WHEN o_orderkey % 6 < 4 THEN concat('Check that ', o_orderstatus, ' is kept.') END AS existing_test", "concat('Check that ', o_orderpriority, ' is kept.') AS proposed_test",
        "CASE WHEN o_orderkey % 5 = 1 THEN concat('E-', o_custkey) END AS existing_exception_code", "concat(o_orderstatus, ' not complied with') AS existing_exception", "concat(o_orderpriority, ' not complied with') AS proposed_exception",
    ), "true"),
    "approvals": ("events", ("event_id AS id", "user_id * 3 + event_id % 3 AS proposal_id", "event_id % 2 + 1 AS level", "event_type AS decided_by", "ts AS decided_at"), "event_id % 4 = 0"),
    "revisions": ("events", ("user_id * 3 AS proposal_id", "event_id AS seq", "CASE event_id % 3 WHEN 0 THEN 'strata_tag' WHEN 1 THEN 'risk_rating' ELSE 'locked' END AS field", "concat(' ', upper(substr(event_type, 1, 1)), ' ') AS new_value"), "event_id % 5 = 0"),
    "docs": ("customer", (
        "c_custkey AS document_id", "CASE WHEN c_custkey % 3 > 0 THEN concat('Notice of ', c_mktsegment) ELSE '' END AS title",
        "concat(CASE WHEN c_custkey % 4 = 0 THEN 'bprd_' ELSE 'memo_' END, c_custkey, '.pdf') AS filename", "CASE WHEN c_custkey % 2 = 0 THEN '2021-03-12' END AS doc_date",
        "CASE WHEN c_custkey % 6 = 5 THEN 'duplicate' WHEN c_custkey % 6 = 4 THEN 'error' ELSE 'ingested' END AS status", "CASE WHEN c_custkey % 10 > 0 AND c_custkey % 3 = 0 THEN c_custkey - c_custkey % 10 END AS parent_id",
    ), "true"),
    "nested": ("customer", (
        "c_custkey AS id", "CASE WHEN c_custkey % 10 BETWEEN 1 AND 3 THEN c_custkey - c_custkey % 10 WHEN c_custkey % 10 > 3 THEN c_custkey - 3 END AS parent_id", "concat('part-', c_custkey % 7, '.docx') AS name",
        "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('Text of ', c_nationkey, ' in ', c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN concat(' by ', c_custkey) ELSE '' END) END AS text",
    ), "true"),
    "arrived": ("customer", (
        "c_custkey AS doc_id", "concat('memo_', c_nationkey, '.pdf') AS filename", "CASE WHEN c_custkey % 10 > 0 AND c_custkey % 3 = 0 THEN c_custkey - c_custkey % 10 END AS parent_id",
        "CASE WHEN c_custkey % 6 = 5 THEN 'duplicate' WHEN c_custkey % 6 = 4 THEN 'error' ELSE 'ingested' END AS status", "c_custkey % 8 > 0 AS processed",
    ), "true"),
    "docs_state": ("customer", ("c_custkey AS document_id", "c_custkey % 9 AS ocr_pages", "CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS superseded_by", "CASE WHEN c_custkey % 7 = 0 THEN 'one clause for a long document' END AS segment_warning"), "true"),
    "clause_state": ("part", ("p_partkey AS id", "p_partkey % 13 = 0 AS model_input_truncated", "CASE WHEN p_partkey % 17 = 0 THEN 'heading' END AS rescued_by", "p_partkey % 19 = 0 AS table_unattached"), "true"),
    "reissued": ("customer", ("c_custkey AS old_id", "c_custkey + 1 AS new_id"), "c_custkey % 5 = 0"),
    "clauses": ("part", (
        "p_partkey AS id", "p_partkey % 50 AS document_id", "p_size AS sequence", "CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_actionable",
        "CASE p_partkey % 4 WHEN 0 THEN 'rules (model failed)' WHEN 1 THEN 'model' WHEN 2 THEN 'rules (no model)' END AS judged_by",
    ), "true"),
    "obligations": ("lineitem", ("l_orderkey * 10 + l_linenumber AS id", "l_partkey AS clause_id", "l_linenumber AS sequence"), "l_suppkey % 3 = 0"),
    "lines": ("part", (
        "p_partkey AS id",
        """CASE p_partkey % 20 WHEN 0 THEN concat('Page ', p_size, ' of 90') WHEN 1 THEN concat('Subject: rules about every ', p_name) WHEN 2 THEN concat(upper(p_name), ' ', upper(p_brand), ' NOTICE') WHEN 3 THEN concat('Dear reader of the ', p_name)
        WHEN 4 THEN 'Yours faithfully and obediently,' WHEN 5 THEN '(Sd) (Sd) (Sd) (Sd) (Sd) (Sd) (Sd)' WHEN 6 THEN concat('Chapter On Every ', upper(p_brand), ' .... ', p_size) WHEN 7 THEN concat('The branch shall count the ', p_name, ' every day.')
        WHEN 8 THEN concat(p_name, ' ', p_size) WHEN 9 THEN concat(p_size, '. The ', p_name, ' must be kept in the vault.') WHEN 10 THEN concat('a) ', p_name, ' and its key') WHEN 11 THEN '### Sheet of figures' WHEN 12 THEN concat('[row ', p_size, '] ', p_name)
        WHEN 13 THEN concat('For information only: the ', p_name, ' is sold in many shops of the town.') WHEN 14 THEN '' WHEN 15 THEN concat('The following ', p_name, ':') WHEN 16 THEN concat('- ', p_size, ' -') WHEN 17 THEN 'Kind regards'
        WHEN 18 THEN concat('Limits   for  the ', p_name, ' and all of the other things that a branch of the bank keeps') ELSE concat('From: ', p_brand, ' to the head of the ', p_name) END AS line""",
    ), "true"),
    "duties": ("part", (
        "p_partkey AS id",
        """CASE p_partkey % 12 WHEN 0 THEN concat('1. Branches shall keep a register of the ', p_name, ' and shall report fraud without delay.') WHEN 1 THEN concat('The system must not be used for ', p_name, ', and must be configured by the owner of ', p_brand, ' at once.')
        WHEN 2 THEN concat('Records shall not be destroyed before the ', p_name, ' policy allows it. Old ones stay.') WHEN 3 THEN concat('(a) ', p_size, ' | ', p_name, ' should be counted by a teller | ', p_brand) WHEN 4 THEN concat('T', p_size, ' | ', p_name, ' and more of it | ', p_brand)
        WHEN 5 THEN concat('Forms must been filed.', chr(10), p_name, ' | 5', chr(10), chr(10), p_brand, ' | 6') WHEN 6 THEN concat('KYC files are required to hold the ', p_name, ' of each customer; shall be updated yearly, and shall be signed by the officer in charge of them')
        WHEN 7 THEN concat('Agents shall ', repeat('count and write down the cash of the day, ', 8), 'and the ', p_name) WHEN 8 THEN concat('Circular No. ', p_size, ' of 2019 shall stand withdrawn.') WHEN 9 THEN concat('Dear ', p_name, ' holder, loans must be repaid.')
        WHEN 10 THEN concat('A remittance of ', p_name, ' is free') ELSE concat('Staff shall do') END AS text""",
    ), "true"),
    "cited": ("part", (
        "p_partkey AS id",
        """CASE p_partkey % 6 WHEN 0 THEN concat('As told in BRXD Circular No. ', p_size, ' of 2020, the rules of circular letter no.0', p_size, ' of 2019 shall stand withdrawn.') WHEN 1 THEN concat('CIRCULAR LETTER NO. ', p_size, ' OF 2018 is superseded.')
        WHEN 2 THEN concat('The ', p_name, ' is no longer applicable.') WHEN 3 THEN concat('Keep Circular No. ', p_size, ' of 2021 at hand.') WHEN 4 THEN concat('IN Circular No ', p_size, ' of 2020 and OPS&D Circular  Letter No. 00', p_size, ' of 2021 rules cease to have effect') ELSE p_name END AS text""",
    ), "true"),
    "tests": ("part", (
        "concat('T-', p_partkey) AS test_code", "concat('Check that ', p_name, ' is kept.') AS test_description",
        "CASE p_partkey % 3 WHEN 0 THEN concat('Circular Letter No. ', p_size, ' of 2019') WHEN 1 THEN concat('circular letter no 0', p_size, ' of 2018') ELSE concat('OPS&D circular letter no. ', p_size, ' of 2021') END AS source_reference", "p_partkey % 4 > 0 AS is_active",
    ), "true"),
    "catalogue": ("part", (
        "concat('T-', p_partkey) AS test_code", "concat('Check that every ', p_name, ' of ', p_brand, ' is kept in the ', p_type, ' register.') AS test_description",
        "CASE p_partkey % 3 WHEN 0 THEN concat('Circular Letter No. ', p_size, ' of 2019') WHEN 1 THEN concat('circular letter no 0', p_size, ' of 2018') ELSE concat('OPS&D circular letter no. ', p_size, ' of 2021') END AS source_reference",
        "CASE p_partkey % 2 WHEN 0 THEN 'Credit' ELSE 'Cash & Teller' END AS strata", "CASE p_partkey % 3 WHEN 0 THEN 'MA' ELSE 'RR' END AS department", "concat('E-', p_partkey) AS exception_code", "p_partkey % 4 > 0 AS is_active",
    ), "true"),
    "claims": ("part", (
        "p_partkey AS id", """CASE p_partkey % 5 WHEN 0 THEN concat('Branches shall keep every ', p_name, ' of ', p_brand, ' in the ', p_type, ' register.') WHEN 1 THEN concat('The rules of circular letter no.0', p_size, ' of 2019 on loans shall stand withdrawn.')
        WHEN 2 THEN concat('The ', p_name, ' of the agent is no longer applicable.') WHEN 3 THEN concat('Staff must report zebra ', p_name, ' to the regulator without delay') ELSE concat('Nothing like it is known, ', p_size) END AS text""",
    ), "true"),
    "decisions": ("part", (
        "p_partkey AS id", "CASE p_partkey % 8 WHEN 0 THEN 'amendment' WHEN 1 THEN 'merge' WHEN 2 THEN 'Amendment' WHEN 3 THEN 'New' WHEN 4 THEN 'Deletion' WHEN 5 THEN 'NO_ACTION' WHEN 6 THEN NULL ELSE ' Amendment! ' END AS change_type",
        "CASE p_partkey % 5 WHEN 0 THEN concat(' t-', p_size, ' ') WHEN 1 THEN 'T-none' WHEN 2 THEN NULL WHEN 3 THEN '  ' ELSE concat('T-', p_size) END AS code", "CASE WHEN p_partkey % 3 = 0 THEN concat('Check that  ', p_name, '.', chr(10), 'x') ELSE 'Check that a' END AS existing",
        "concat('check that ', p_name) AS proposed", "CASE p_partkey % 6 WHEN 0 THEN '0.8' WHEN 1 THEN 'high' WHEN 2 THEN '2' WHEN 3 THEN '-1' WHEN 4 THEN 'NaN' ELSE '0.456' END AS confidence",
    ), "true"),
    "letters": ("documents", (
        "doc_id", "concat(source, '_', doc_id, '.v1.txt') AS filename",
        """CASE doc_id % 4 WHEN 0 THEN concat('CONFIDENTIAL PAPER OF THE BANK', chr(10), '  ', upper(source), ' NOTICE TO ALL BRANCHES  ', chr(10), text) WHEN 1 THEN concat('[row 1] ', upper(source), ' NOTICE ', doc_id, chr(10), 'Dated 12 March 2021 and 2020-01-05', text)
        WHEN 2 THEN concat('issued on March 3, 2019', chr(10), text) ELSE text END AS text""",
    ), "true"),
    "files": ("documents", ("doc_id AS id", "concat(source, '/', lang) AS filename", "concat('h', n_chars % 40) AS file_hash", "CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'docx' WHEN 2 THEN 'scanned-pdf' ELSE 'xlsx' END AS kind"), "true"),
}


def _rel(spark, sf, name):
    source, columns, where = RELATIONS[name]
    return table(spark, sf, source).selectExpr("*").where(where).selectExpr(*columns)


def _with(*names):
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(RELATIONS[n][1])} FROM {RELATIONS[n][0]} WHERE {RELATIONS[n][2]})" for n in names)


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_WEEK = "38 (15.09.2025 - 21.09.2025)"
_NAME = "coalesce(nullif(title, ''), filename, '')"
_RISK = "CASE risk WHEN 'High' THEN 'High Risk' WHEN 'Medium' THEN 'Medium Risk' WHEN 'Low' THEN 'Low Risk' ELSE risk END"
_KIND = "CASE change_type WHEN 'Amendment' THEN 'Amendment ' ELSE change_type END"
_LIVE = "change_type <> 'No action' AND status <> 'Withdrawn (superseded)'"
_CELLS = {
    1: _q(_WEEK), 2: "sr_no", 3: "department", 4: "department", 5: _KIND, 6: "CASE WHEN change_type = 'Amendment' THEN 'Amendment in Test ' ELSE '' END",
    7: "CASE WHEN change_type = 'Amendment' THEN 'Approved checklist Implemented in eAudit' ELSE '' END", 9: "strata", 11: "CASE WHEN change_type = 'Deletion' THEN coalesce(existing_test, '') ELSE proposed_test END",
    12: "coalesce(target_code, '')", 13: "CASE WHEN coalesce(target_code, '') <> '' THEN coalesce(existing_test, '') ELSE '' END", 14: "CASE WHEN change_type = 'Deletion' THEN existing_exception ELSE proposed_exception END",
    15: "coalesce(existing_exception_code, '')", 16: "CASE WHEN existing_exception_code IS NOT NULL THEN existing_exception ELSE '' END", 17: _RISK, 22: "root_cause", 23: "'Yes'", 24: _NAME, 25: _NAME,
    26: "coalesce(doc_date, '')", 27: "coalesce(doc_date, '')", 64: "rationale",
}


def _week():
    return T.week_label(F.lit("2025-09-17").cast("date"))


@query(f"{_with('props', 'docs')} SELECT id, " + ", ".join(f"{_CELLS.get(k, chr(39) * 2)} AS c{k:02d}" for k in range(1, 79)) + f" FROM props LEFT JOIN docs USING (document_id) WHERE {_LIVE.replace('status', 'props.status')}")
def proposed_tests_78(spark, sf):
    live = _rel(spark, sf, "props").where(T.is_change())
    return exports.proposed_tests(live, _rel(spark, sf, "docs").drop("status"), _week())


@query(f"""{_with('props', 'docs')}, n AS (SELECT document_id, count(*) AS n FROM props WHERE {_LIVE} GROUP BY 1)
  SELECT row_number() OVER (ORDER BY document_id) AS number, document_id, CASE WHEN upper(filename) LIKE 'BPRD%' THEN 'SBP' ELSE 'ABL' END AS origin, CASE WHEN n > 0 THEN 'INST' ELSE 'INF' END AS kind, {_NAME} AS name, coalesce(doc_date, '') AS doc_date,
    CASE WHEN n > 0 THEN concat(n, ' test(s) proposed') ELSE 'No change required' END AS outcome, CASE WHEN n > 0 THEN 'Yes' ELSE 'No' END AS actionable, {_q(_WEEK)} AS week FROM docs LEFT JOIN n USING (document_id)""")
def week_report(spark, sf):
    return exports.week_report(_rel(spark, sf, "docs"), _rel(spark, sf, "props").where(T.is_change()), _week())


@query(f"{_with('props')} SELECT id, sr_no AS a01, sr_no AS a02, 'New' AS a03, " + ", ".join(f"'' AS a{k:02d}" for k in range(4, 14)) + " FROM props WHERE change_type = 'New' AND department = 'BA'")
def annexure_rows(spark, sf):
    return exports.annexure(_rel(spark, sf, "props"))


@query(f"""{_with('props')} SELECT id, CASE change_type WHEN 'Deletion' THEN concat('Remove — ', coalesce(existing_test, '(test wording not recorded)')) ELSE proposed_test END AS cell,
  CASE change_type WHEN 'New' THEN concat('New test ', sr_no) WHEN 'Amendment' THEN 'Covered in ' || target_code || ' — amended' WHEN 'Deletion' THEN concat('Deletion — ', coalesce(nullif(target_code, ''), 'affected tests'), ' withdrawn') ELSE 'Information' END AS note,
  {_RISK} AS risk, {_KIND} AS kind FROM props""")
def change_cells(spark, sf):
    return _rel(spark, sf, "props").select("id", exports.change_cell().alias("cell"), exports.note().alias("note"), T.relabel("risk", L.RISK_LABELS).alias("risk"), T.relabel("change_type", L.TEST_TYPES).alias("kind"))


_SUPERSEDE = f"""{_with('props', 'approvals', 'revisions', 'reissued')}, acted AS (SELECT proposal_id FROM approvals UNION SELECT proposal_id FROM revisions),
  w AS (SELECT props.*, old_id, old_id IS NOT NULL AND status IN ('Pending review', 'Changes requested') AND change_type <> 'No action' AND id NOT IN (SELECT proposal_id FROM acted) AS gone FROM props LEFT JOIN reissued ON document_id = old_id)"""


@query(f"""{_SUPERSEDE} SELECT r.old_id, r.new_id, count(*) FILTER (WHERE gone) AS withdrawn, count(*) FILTER (WHERE {_LIVE} AND NOT gone) AS kept FROM reissued r LEFT JOIN w ON w.old_id = r.old_id GROUP BY 1, 2""")
def supersede_counts(spark, sf):
    return intake.supersede(_rel(spark, sf, "reissued"), *(_rel(spark, sf, k) for k in ("props", "approvals", "revisions")))[1]


@query(f"{_SUPERSEDE} SELECT id, CASE WHEN gone THEN 'Withdrawn (superseded)' ELSE status END AS status FROM w")
def supersede_statuses(spark, sf):
    return intake.supersede(_rel(spark, sf, "reissued"), *(_rel(spark, sf, k) for k in ("props", "approvals", "revisions")))[0].select("id", "status")


@query(f"""{_with('files')}, known AS (SELECT filename, file_hash, min(id) AS known_id FROM files WHERE id % 3 = 0 GROUP BY 1, 2)
  SELECT id, known_id, CASE WHEN known_id IS NULL THEN 'new' WHEN known_id % 2 = 0 THEN 'unchanged' WHEN known_id IN (SELECT doc_id FROM labels) THEN 'left' ELSE 'reclaim' END AS action FROM files LEFT JOIN known USING (filename, file_hash)""")
def already_processed(spark, sf):
    files = _rel(spark, sf, "files")
    earlier = files.where("id % 3 = 0")
    touched = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return intake.already_processed(files, earlier, earlier.where("id % 2 = 0").select(F.col("id").alias("document_id")), touched).select("id", "known_id", "action")


@query(f"""{_with('clauses')}, v AS (SELECT id, id % 2 = 0 AS actionable, CASE WHEN id % 7 = 0 THEN 'rules (again)' ELSE 'model 2' END AS judge FROM clauses WHERE id % 9 > 0), h AS (SELECT DISTINCT l_partkey AS clause_id FROM lineitem WHERE l_quantity > 49),
  q AS (SELECT c.*, v.actionable, v.judge, CASE WHEN c.is_actionable IS NULL AND judged_by LIKE 'rules (%' THEN CASE WHEN judge IS NULL OR judge LIKE 'rules (%' THEN 'still_provisional' WHEN c.id IN (SELECT clause_id FROM h) THEN 'kept_human' ELSE 'confirmed' END END AS outcome FROM clauses c LEFT JOIN v USING (id))
  SELECT id, outcome, CASE WHEN outcome = 'confirmed' THEN actionable ELSE is_actionable END AS is_actionable, CASE outcome WHEN 'confirmed' THEN judge WHEN 'kept_human' THEN 'kept: a person acted on it' ELSE judged_by END AS judged_by FROM q""")
def rejudged_clauses(spark, sf):
    clauses = _rel(spark, sf, "clauses")
    verdicts = clauses.where("id % 9 > 0").selectExpr("id", "id % 2 = 0 AS actionable", "CASE WHEN id % 7 = 0 THEN 'rules (again)' ELSE 'model 2' END AS judge")
    human = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("clause_id"))
    return intake.rejudge(clauses, verdicts, human).select("id", "outcome", "is_actionable", "judged_by")


@query(f"""{_with('obligations', 'clauses', 'docs', 'props')} SELECT o.id, c.document_id, row_number() OVER (PARTITION BY c.document_id ORDER BY c.sequence, o.sequence, o.id) AS place FROM obligations o JOIN clauses c ON c.id = o.clause_id JOIN docs d ON d.document_id = c.document_id
  WHERE (c.is_actionable OR c.is_actionable IS NULL) AND d.status = 'ingested' AND NOT EXISTS (SELECT 1 FROM props p WHERE p.id = o.id)""")
def pending_obligations(spark, sf):
    docs = _rel(spark, sf, "docs").withColumnRenamed("document_id", "id")
    proposals = _rel(spark, sf, "props").select(F.col("id").alias("obligation_id"))
    return intake.pending_obligations(_rel(spark, sf, "obligations"), _rel(spark, sf, "clauses"), docs, proposals).select("id", "document_id", F.col("place").cast("long").alias("place"))


@query(f"""{_with('props', 'approvals', 'revisions', 'clauses', 'docs')}, t AS (SELECT proposal_id FROM approvals UNION SELECT proposal_id FROM revisions)
  SELECT document_id FROM docs d WHERE EXISTS (SELECT 1 FROM clauses c WHERE c.document_id = d.document_id AND EXISTS (SELECT 1 FROM props p WHERE p.clause_id = c.id AND p.id IN (SELECT proposal_id FROM t)))""")
def human_touched_documents(spark, sf):
    docs = _rel(spark, sf, "docs").withColumnRenamed("document_id", "id")
    return intake.human_touched(docs, *(_rel(spark, sf, k) for k in ("clauses", "props", "approvals", "revisions"))).select(F.col("id").alias("document_id"))


@query(f"""{_with('docs')} SELECT c.document_id, p.document_id AS parent, p.filename AS parent_name FROM docs c JOIN docs p ON c.parent_id = p.document_id""")
def child_to_parent(spark, sf):
    docs = _rel(spark, sf, "docs")
    up = docs.select(F.col("document_id").alias("parent"), F.col("filename").alias("parent_name"))
    return docs.join(up, docs["parent_id"] == up["parent"]).select("document_id", "parent", "parent_name")


_COUNTS = {
    "documents": "status <> 'duplicate'", "duplicates": "status = 'duplicate'", "nested": "parent_id IS NOT NULL", "failed": "status = 'error'",
}
_PROPOSAL_COUNTS = {
    "assessed": "true", "proposals": _LIVE, "no_action": "change_type = 'No action'", "withdrawn": "status = 'Withdrawn (superseded)'",
    "approved": f"status = 'Approved' AND {_LIVE}", "pending": f"status NOT IN ('Approved', 'Rejected') AND {_LIVE}",
}
_DOC_STATE_COUNTS = {"superseded": "superseded_by IS NOT NULL", "flagged_splits": "segment_warning IS NOT NULL"}
_CLAUSE_STATE_COUNTS = {"truncated_for_model": "model_input_truncated", "rescued": "rescued_by IS NOT NULL", "unattached_tables": "table_unattached"}
_CLAUSE_COUNTS = {"clauses": "true", "actionable": "is_actionable", "provisional": "is_actionable IS NULL"}


def _counts_sql(relation, counts):
    return f"SELECT unnest([{', '.join(map(_q, counts))}]) AS figure, unnest([{', '.join(f'count(*) FILTER (WHERE {c})' for c in counts.values())}]) AS n FROM {relation}"


@query(f"""{_with('docs', 'props', 'clauses', 'obligations', 'docs_state', 'clause_state')} {_counts_sql('docs', _COUNTS)} UNION ALL {_counts_sql('docs_state', _DOC_STATE_COUNTS)} UNION ALL {_counts_sql('clause_state', _CLAUSE_STATE_COUNTS)}
  UNION ALL SELECT 'ocr_pages', CAST(coalesce(sum(ocr_pages), 0) AS BIGINT) FROM docs_state UNION ALL SELECT 'dropped', count(*) FROM documents WHERE length(text) < 40
   UNION ALL {_counts_sql('props', _PROPOSAL_COUNTS)} UNION ALL {_counts_sql('clauses', _CLAUSE_COUNTS)}
  UNION ALL SELECT 'obligations', count(*) FROM obligations UNION ALL SELECT 'multi_obligation_clauses', count(*) FROM (SELECT clause_id FROM obligations GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'tests', count(*) FROM part""")
def headline_counts(spark, sf):
    """The figures of the dashboards: one pass over each relation."""
    def figures(df, counts):
        one = df.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in counts.items()))
        return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("figure"), F.col(k).alias("n")) for k in counts))))

    per_clause = _rel(spark, sf, "obligations").groupBy("clause_id").agg(F.count("*").alias("m"))
    duties = per_clause.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("obligations"), F.count_if(F.col("m") > 1).alias("multi_obligation_clauses"))
    duties = duties.select(F.inline(F.array(*(F.struct(F.lit(k).alias("figure"), F.col(k).alias("n")) for k in duties.columns))))
    parts = [figures(_rel(spark, sf, name), counts) for name, counts in (("docs", _COUNTS), ("props", _PROPOSAL_COUNTS), ("clauses", _CLAUSE_COUNTS), ("docs_state", _DOC_STATE_COUNTS), ("clause_state", _CLAUSE_STATE_COUNTS))]
    pages = _rel(spark, sf, "docs_state").agg(F.coalesce(F.sum("ocr_pages"), F.lit(0)).cast("long").alias("n")).select(F.lit("ocr_pages").alias("figure"), "n")
    out = reduce(DataFrame.unionByName, [*parts, duties, pages, figures(table(spark, sf, "documents").where("length(text) < 40"), {"dropped": "true"})])
    return out.unionByName(figures(table(spark, sf, "part"), {"tests": "true"}))


@query(f"""{_with('props', 'approvals')}, last AS (SELECT proposal_id, arg_max(decided_by, id) AS decided_by FROM approvals WHERE level = 2 GROUP BY 1)
  SELECT id, CASE WHEN change_type = 'No action' THEN 'no change' WHEN status <> 'Approved' THEN 'status is ' || status END AS reason, CASE WHEN change_type <> 'No action' AND status = 'Approved' THEN decided_by END AS decided_by FROM props LEFT JOIN last ON proposal_id = id""")
def approved_export(spark, sf):
    out, refused = review.export(_rel(spark, sf, "props"), _rel(spark, sf, "approvals"))
    none = F.lit(None).cast("string")
    return out.select("id", none.alias("reason"), "decided_by").unionByName(refused.select("id", "reason", none.alias("decided_by")))


@query(f"{_with('revisions')} SELECT proposal_id, field, arg_max(new_value, seq) AS value FROM revisions JOIN orders ON o_orderkey = proposal_id WHERE field IN ('strata_tag', 'risk_rating') GROUP BY 1, 2")
def current_fields(spark, sf):
    return review.current_fields(_rel(spark, sf, "props"), _rel(spark, sf, "revisions"))


@query(f"""{_with('props', 'revisions')}, held AS (SELECT id AS proposal_id, 'strata_tag' AS field, strata AS old_value FROM props UNION ALL SELECT id, 'risk_rating', CASE WHEN id % 2 = 0 THEN 'C' ELSE risk END FROM props)
  SELECT proposal_id, field, old_value, trim(new_value) AS new_value FROM revisions JOIN held USING (proposal_id, field) WHERE trim(coalesce(old_value, '')) <> trim(new_value)""")
def real_edits(spark, sf):
    held = _rel(spark, sf, "props").select("id", F.col("strata").alias("strata_tag"), F.expr("CASE WHEN id % 2 = 0 THEN 'C' ELSE risk END").alias("risk_rating"))
    return review.edits(held, _rel(spark, sf, "revisions"))


@query(f"""{_with('props', 'approvals')} SELECT proposal_id, props.status AS before, CASE WHEN props.status IN ('Pending review', 'Changes requested') THEN 'Pending approval' ELSE props.status END AS after, props.status IN ('Pending review', 'Changes requested') AS applied
  FROM (SELECT DISTINCT proposal_id FROM approvals) JOIN props ON id = proposal_id""")
def bulk_decision(spark, sf):
    return review.bulk(_rel(spark, sf, "props"), _rel(spark, sf, "approvals").select("proposal_id").distinct(), 1, "Approved")


@query(f"{_with('approvals')} SELECT id, proposal_id, row_number() OVER (PARTITION BY proposal_id ORDER BY decided_at, id) AS place FROM approvals")
def approval_history(spark, sf):
    return review.history(_rel(spark, sf, "approvals")).select("id", "proposal_id", F.col("place").cast("long").alias("place"))


@query(f"""{_with('props')}, r AS (SELECT id, CASE WHEN id % 8 < 4 THEN 'New' ELSE 'No action' END AS change_type, 'R' AS target_code FROM props WHERE id % 16 > 2)
  SELECT p.id, CASE WHEN r.id IS NOT NULL THEN r.change_type ELSE p.change_type END AS change_type, CASE WHEN r.id IS NOT NULL THEN r.target_code ELSE p.target_code END AS target_code, r.id IS NOT NULL AS recovered
  FROM props p LEFT JOIN r ON r.id = p.id AND p.change_type = 'No action' AND r.change_type <> 'No action'""")
def recovered_decisions(spark, sf):
    model = _rel(spark, sf, "props").select("id", "change_type", "target_code")
    rules = model.where("id % 16 > 2").selectExpr("id", "CASE WHEN id % 8 < 4 THEN 'New' ELSE 'No action' END AS change_type", "'R' AS target_code")
    return decide.recover(model, rules)


@query(f"""{_with('files')}, u AS (SELECT id, file_hash, 0 AS arrival FROM files WHERE id % 2 = 1 UNION ALL SELECT id, file_hash, 1 FROM files WHERE id % 2 = 0)
  SELECT id, arrival, first_value(id) OVER (PARTITION BY file_hash ORDER BY arrival, id) AS original FROM u""")
def mail_first_union(spark, sf):
    """Mail and folder as one; of equal contents the mail's copy is the original."""
    files = _rel(spark, sf, "files").select("id", "file_hash")
    both = intake.arrival_order(files.where("id % 2 = 1"), files.where("id % 2 = 0"))
    first = both.groupBy("file_hash").agg(F.min(F.struct("arrival", "id"))["id"].alias("original"))
    return both.join(first, "file_hash").select("id", F.col("arrival").cast("int").alias("arrival"), "original")


@query(f"{_with('files')} SELECT kind, kind IN ({', '.join(map(_q, L.UNSTRUCTURED_KINDS))}) AS unstructured, count(*) AS n FROM files GROUP BY 1, 2")
def kinds_unstructured(spark, sf):
    return _rel(spark, sf, "files").groupBy("kind", T.is_unstructured("kind").alias("unstructured")).agg(F.count("*").alias("n"))


_BOILERPLATE = "|".join(L.NO_TITLE)


@query(f"""{_with('letters')}, x AS (SELECT doc_id, filename, text, list_transform(string_split(text, chr(10))[1:{L.TITLE_LINES}], lambda l: regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '^\\[row \\d+\\]\\s*', '')) AS lines FROM letters),
  t AS (SELECT *, list_filter(lines, lambda l: NOT regexp_matches(lower(l), '{_BOILERPLATE}') AND length(l) BETWEEN 12 AND 110 AND length(regexp_replace(l, '[^\\pL]', '', 'g')) > 0 AND length(regexp_replace(l, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(l, '[^\\pL]', '', 'g')) > 0.4)[1] AS found FROM x)
  SELECT doc_id, coalesce(found, trim(replace(regexp_replace(filename, '\\.[^./]*$', ''), '_', ' '))) AS title, regexp_extract(substring(text, 1, {L.DATE_CHARS}), '{L.DATE}', 1) AS doc_date FROM t""")
def title_and_date(spark, sf):
    return _rel(spark, sf, "letters").select("doc_id", T.title("text", "filename").alias("title"), T.date_of("text").alias("doc_date"))


_WORDS = _q(L.WORDS)
_SMALL = ", ".join(map(_q, L.SMALL_WORDS))


def _heading(t):
    words = f"list_filter(regexp_extract_all({t}, '[A-Za-z][A-Za-z''’]*'), lambda w: lower(w) NOT IN ({_SMALL}))"
    letters, capitals = f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))", f"length(regexp_replace({t}, '[^A-Z]', '', 'g'))"
    shape = f"({letters} = 0 OR {capitals} >= 0.6 * {letters} OR (len({words}) > 0 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0))"
    return f"({t} <> '' AND NOT regexp_matches({t}, {_q(L.SENTENCE_END)}) AND len(regexp_extract_all({t}, {_WORDS})) <= {L.HEADING_WORDS} AND {shape})"


_NOISE = f"""CASE WHEN length(t) < {L.MIN_FRAGMENT} THEN 'too short' WHEN regexp_matches(t, {_q(L.EMAIL_HEADER)}) AND n <= 20 THEN 'email header' WHEN regexp_matches(t, {_q(L.PAGE_FURNITURE)}) THEN 'page number' WHEN regexp_matches(t, {_q(L.SIGNATURE)}) THEN 'signature'
    WHEN regexp_matches(t, {_q(L.SALUTATION)}) AND n <= 6 THEN 'salutation' WHEN regexp_matches(t, {_q(L.SIGN_OFF)}) THEN 'sign-off' WHEN regexp_matches(t, {_q(L.CONTENTS_ENTRY)}) AND {_heading('head')} THEN 'contents entry' WHEN {_heading('t')} THEN 'heading' END"""


def _flat_lines(source: str) -> str:
    return f"t AS (SELECT id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM {source}), n AS (SELECT *, len(string_split(t, ' ')) AS n, regexp_replace(regexp_extract(t, {_q(L.CONTENTS_ENTRY)}, 1), ':+\\s*$', '') AS head FROM t)"


@query(f"WITH x AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents), {_flat_lines('x')} SELECT {_NOISE} AS rule, count(*) AS n FROM n GROUP BY 1")
def noise_rule_histogram(spark, sf):
    """Lines of all documents by the noise rule that takes them; content has the rule null."""
    rows = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy(T.noise_rule("line").alias("rule")).agg(F.count("*").alias("n"))


@query(f"{_with('lines')}, {_flat_lines('lines')} SELECT id, {_NOISE} AS rule, {_heading('t')} AS heading, len(regexp_extract_all(t, {_WORDS})) AS words FROM n")
def noise_rules(spark, sf):
    """Every rule that makes a line structural noise, on lines of all kinds."""
    return _rel(spark, sf, "lines").select("id", T.noise_rule("line").alias("rule"), T.looks_like_heading(T.flat("line")).alias("heading"), T.word_count(T.flat("line")).cast("long").alias("words"))


_NUMBERED = L.NUMBERED.replace("(?=", "(?:")  # only whether it matches is asked here
_OPENERS = " OR ".join(f"regexp_matches(t, {_q(p)})" for p in (L.OBLIGATION, _NUMBERED, L.LIST_ITEM, L.LEAD_IN, L.INFORMATIONAL, L.SHEET_ROW, L.SECTION))


@query(f"""{_with('lines')}, t AS (SELECT id, trim(line) AS t FROM lines) SELECT id, t <> '' AND len(regexp_extract_all(t, {_WORDS})) <= {L.DATA_CELL_WORDS} AND NOT ({_OPENERS}) AS data_line FROM t""")
def data_lines(spark, sf):
    return _rel(spark, sf, "lines").select("id", T.is_data_line("line").alias("data_line"))


_STRATA_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {_q(p)}) THEN {_q(n)}" for n, p in L.STRATA) + f" ELSE {_q(L.DEFAULT_STRATA)} END"
_DEPARTMENT_SQL = "CASE strata " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in L.DEPARTMENT_OF_STRATA.items()) + " ELSE 'BA' END"


@query(f"""{_with('duties')}, s AS (SELECT id, text, {_STRATA_SQL} AS strata FROM duties)
  SELECT id, strata, {_DEPARTMENT_SQL} AS department, CASE WHEN regexp_matches(substring(trim(text), 1, 160), {_q(L.INFORMATIONAL)}) THEN 'information' WHEN regexp_matches(text, {_q(L.SUPERSESSION)}) THEN 'supersession' WHEN regexp_matches(text, {_q(L.OBLIGATION)}) THEN 'obligation' ELSE 'none' END AS verdict,
    CASE WHEN regexp_matches(lower(text), '{L.SYSTEM_GAP}') THEN 'System Gap' WHEN regexp_matches(lower(text), '{L.POLICY_GAP}') THEN 'Policy Gap' WHEN regexp_matches(lower(text), '{L.PROCESS_GAP}') THEN 'Process / Procedure Gap' ELSE 'Implementation Gap' END AS root_cause,
    CASE WHEN regexp_matches(lower(text), '{L.HIGH_RISK}') THEN 'High' ELSE 'Medium' END AS risk FROM s""")
def clause_labels(spark, sf):
    rows = _rel(spark, sf, "duties").withColumn("strata", T.strata("text"))
    return rows.select("id", "strata", T.department("strata").alias("department"), T.classify("text").alias("verdict"), T.root_cause("text").alias("root_cause"), T.risk("text").alias("risk"))


_LOWER = "CASE WHEN {0} = '' OR regexp_matches(string_split({0}, ' ')[1], '^.+[A-Z]') THEN {0} ELSE lower({0}[1]) || {0}[2:] END"


@query(f"""{_with('duties')}, a AS (SELECT id, string_split(trim(text), chr(10)) AS lines FROM duties), b AS (SELECT *, trim(lines[1]) AS raw, list_filter(list_transform(lines[2:], lambda x: trim(x)), lambda x: x <> '') AS attached FROM a),
  c AS (SELECT *, list_filter(list_transform(string_split(raw, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM b),
  d AS (SELECT *, CASE WHEN contains(raw, '|') THEN coalesce(list_filter(cells, lambda x: regexp_matches(x, {_q(L.CARRYING)}))[1], list_filter(cells, lambda x: length(x) = list_max(list_transform(cells, lambda y: length(y))))[1], '') ELSE raw END AS body0 FROM c),
  e AS (SELECT *, trim(regexp_replace(regexp_replace(body0, '^\\s*\\(?(?:\\d+(?:\\.\\d+)*|[ivxIVX]{{1,5}}|[a-z])\\)?[.):]?\\s+', ''), '\\s+', ' ', 'g')) AS body FROM d),
  f AS (SELECT *, regexp_extract(body, '(?is)^(.*?)\\b(?:shall|must|are required to|is required to|are advised)\\b(.*)$', ['who', 'duty']) AS h, regexp_matches(body, {_q(L.DUTY_VERB)}) AS has FROM e),
  g AS (SELECT *, regexp_replace(trim(CASE WHEN has THEN h.who ELSE body END), ',+$', '') AS who, trim(h.duty) AS duty0 FROM f),
  i AS (SELECT *, regexp_matches(who, '(?i)((^|[^s])s|records|forms|documents)[.,]*$') AS plural FROM g),
  j AS (SELECT *, CASE WHEN regexp_matches(duty0, '^not\\s+(be|been)\\s+') THEN CASE WHEN plural THEN 'are' ELSE 'is' END || ' not ' || regexp_replace(duty0, '^not\\s+(be|been)\\s+', '')
    WHEN regexp_matches(duty0, '^not\\s+') THEN CASE WHEN plural THEN 'do' ELSE 'does' END || ' not ' || regexp_replace(duty0, '^not\\s+', '') WHEN regexp_matches(duty0, '^(be|been)\\s+') THEN CASE WHEN plural THEN 'are' ELSE 'is' END || ' ' || regexp_replace(duty0, '^(be|been)\\s+', '') ELSE duty0 END AS duty FROM i),
  k AS (SELECT *, CASE WHEN has AND who <> '' THEN {_LOWER.format('who')} || ' ' || duty ELSE {_LOWER.format('body')} END AS said, trim(regexp_replace(replace(raw, '|', ' '), '\\s+', ' ', 'g')) AS plain FROM j),
  l AS (SELECT *, regexp_replace(trim(string_split('Check that ' || said, '. ')[1]), '\\.+$', '') AS s0, regexp_replace(plain, '^\\s*\\(?[\\divxIVX]+[.)]\\s*', '') AS fuller FROM k),
  m AS (SELECT *, CASE WHEN length(s0) < 45 THEN regexp_replace('Check that ' || {_LOWER.format('fuller')}, '\\.+$', '') ELSE s0 END AS s1 FROM l),
  n AS (SELECT *, CASE WHEN length(s1) > 240 THEN regexp_replace(substring(s1, 1, 237), ' [^ ]*$', '') || '…' ELSE s1 END || '.' AS s2 FROM m),
  o AS (SELECT id, array_to_string(list_concat([s2], attached), chr(10)) AS proposed, regexp_replace(s2, '^Check that (.*?)\\.*$', '\\1') AS x FROM n)
  SELECT id, proposed, upper(x[1]) || x[2:] || ' — not complied with.' AS exception FROM o""")
def drafted_tests(spark, sf):
    """The drafted test and exception of every duty: cells, be and not-be forms, long and short ones, attached lines."""
    rows = _rel(spark, sf, "duties").withColumn("proposed", T.draft_test("text"))
    return rows.select("id", "proposed", T.exception_wording("proposed").alias("exception"))


_CITE = "(?i)((?-i:[A-Z&]{2,10})\\s+)?(?:Circular(?:\\s+Letter)?\\s*No\\.?\\s*\\d+\\s+of\\s+\\d{4})"
_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), '\\bno\\s*0*(\\d+)', 'no \\1', 'g'), '\\s+', ' ', 'g'))"
# a word that may not be a prefix is cut off afterwards, as this dialect has no look-ahead
_REFS = f"""r AS (SELECT id, text, list_transform(regexp_extract_all(text, {_q(_CITE)}), lambda x: trim(regexp_replace(regexp_replace(x, '^(IN|OF|TO|BY|THE|AND|FOR|VIDE|NO)\\s+', ''), '\\s+', ' ', 'g'))) AS refs FROM cited)"""


@query(f"{_with('cited')}, {_REFS} SELECT id, generate_subscripts(refs, 1) AS nth, unnest(refs) AS reference, {_NORMAL.format('unnest(refs)')} AS normal FROM r")
def cited_prefixes(spark, sf):
    each = _rel(spark, sf, "cited").select("id", F.posexplode(T.cited_references("text")).alias("nth", "reference"))
    return each.select("id", (F.col("nth") + 1).cast("long").alias("nth"), "reference", T.normal_reference("reference").alias("normal"))


_TARGETS = f"""w AS (SELECT * FROM r WHERE regexp_matches(text, {_q(L.SUPERSESSION)})), c AS (SELECT id, generate_subscripts(refs, 1) AS nth, unnest(refs) AS reference FROM w),
  t AS (SELECT test_code, {_NORMAL.format('source_reference')} AS norm FROM tests WHERE is_active), m AS (SELECT id, nth, reference, min(test_code) AS target, count(*) AS n FROM c JOIN t ON norm = {_NORMAL.format('reference')} GROUP BY ALL),
  f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY nth) = 1),
  targets AS (SELECT w.id, CASE WHEN target IS NOT NULL THEN 'source match' WHEN len(refs) > 0 THEN 'subject only' ELSE 'unnamed' END AS tier, coalesce(reference, refs[1]) AS reference, target, coalesce(n, 1) - 1 AS others, CASE WHEN target IS NOT NULL THEN 0.85 WHEN len(refs) > 0 THEN 0.30 ELSE 0.45 END AS confidence FROM w LEFT JOIN f USING (id))"""


@query(f"{_with('cited', 'tests')}, {_REFS}, {_TARGETS} SELECT * FROM targets")
def withdrawal_targets(spark, sf):
    return decide.withdrawal_targets(_rel(spark, sf, "cited"), _rel(spark, sf, "tests"))


_FLAT_CHANGE = "trim(regexp_replace(regexp_replace(lower(coalesce(change_type, '')), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDING = "trim(regexp_replace(trim(regexp_replace(lower(string_split(coalesce({0}, ''), chr(10))[1]), '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g'))"


@query(f"""{_with('decisions', 'tests')}, x AS (SELECT *, {_FLAT_CHANGE} AS ft, trim(coalesce(code, '')) <> '' AS named, upper(trim(code)) IN (SELECT upper(test_code) FROM tests) AS known, try_cast(confidence AS DOUBLE) AS v FROM decisions),
  y AS (SELECT *, CASE ft WHEN 'new' THEN 'New' WHEN 'amendment' THEN 'Amendment' WHEN 'deletion' THEN 'Deletion' ELSE 'No action' END AS ct, CASE WHEN v IS NULL THEN 0.6 WHEN isnan(v) THEN 0 ELSE round(least(1, greatest(0, v)), 2) END AS sure FROM x),
  z AS (SELECT *, CASE WHEN ct = 'No action' AND ft <> 'no action' THEN 'unknown_type' WHEN ct IN ('Amendment', 'Deletion') AND named AND NOT known THEN 'invented_code' WHEN ct IN ('Amendment', 'Deletion') AND NOT named THEN 'missing_target'
    WHEN ct = 'Amendment' AND {_WORDING.format('existing')} <> '' AND {_WORDING.format('existing')} = {_WORDING.format('proposed')} THEN 'empty_change' END AS wrong FROM y)
  SELECT id, CASE WHEN wrong IS NOT NULL THEN 'No action' ELSE ct END AS change_type, CASE WHEN wrong IS NULL AND ct <> 'No action' AND NOT (ct = 'New' AND named AND NOT known) THEN code END AS code, CASE WHEN wrong IS NULL AND ct <> 'No action' THEN proposed END AS proposed,
    CASE WHEN wrong IS NOT NULL THEN least(sure, 0.5) ELSE sure END AS confidence, coalesce(wrong, CASE WHEN ct = 'New' AND named AND NOT known THEN 'stray_code' END) AS correction FROM z""")
def grounded_decisions(spark, sf):
    codes = _rel(spark, sf, "tests").select(F.col("test_code").alias("code"))
    return decide.ground(_rel(spark, sf, "decisions"), codes).select("id", "change_type", "code", "proposed", "confidence", "correction")


@query("""SELECT p_partkey AS id, CASE WHEN regexp_matches(r, '^\\d+(\\.\\d+)*$') THEN len(string_split(r, '.')) END AS depth FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '.', p_partkey % 7) WHEN 1 THEN concat(p_size, '') WHEN 2 THEN 'a' WHEN 3 THEN concat('C-', p_size) ELSE concat(p_size, '.1.2') END AS r FROM part)""")
def reference_depth(spark, sf):
    reference = "CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '.', p_partkey % 7) WHEN 1 THEN concat(p_size, '') WHEN 2 THEN 'a' WHEN 3 THEN concat('C-', p_size) ELSE concat(p_size, '.1.2') END"
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.numeric_depth(F.expr(reference)).cast("long").alias("depth"))


@query("""SELECT p_partkey AS id, substring(regexp_replace(p_name || ': ' || p_type || repeat('/x y', p_size), '[^A-Za-z0-9]+', '_', 'g'), 1, 55) AS name, floor(p_partkey * 13 / greatest(floor(p_retailprice / greatest(p_size % 9, 1)), 1))::BIGINT + 1 AS page FROM part""")
def names_and_pages(spark, sf):
    stem = F.concat("p_name", F.lit(": "), "p_type", F.expr("repeat('/x y', p_size)"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.safe_name(stem).alias("name"), T.page_number(F.col("p_partkey") * 13, F.col("p_retailprice"), F.col("p_size") % 9).alias("page"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth, regexp_replace(o_orderpriority, '[^A-Za-z ]', ' ', 'g') AS subject FROM orders)
  SELECT o_orderkey AS id, concat(isoyear(d), '-', lpad(CAST(week(d) AS VARCHAR), 2, '0'), '-', CASE WHEN nth < 100 THEN lpad(CAST(nth AS VARCHAR), 2, '0') ELSE CAST(nth AS VARCHAR) END, '-', array_to_string(list_transform(regexp_extract_all(subject, '[A-Za-z]+'), lambda w: upper(w[1])), '')) AS sr_no FROM s""")
def running_serials(spark, sf):
    """A serial within each prefix, numbered by ranges of keys so that no prefix is numbered in one task."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").withColumn("range", F.expr("o_orderkey div 65536"))
    sizes = rows.groupBy("o_orderpriority", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("o_orderpriority").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("o_orderpriority", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("o_orderpriority", "range").orderBy("o_orderkey"))
    ranked = rows.withColumn("nth", nth).join(base, ["o_orderpriority", "range"])
    return ranked.select(F.col("o_orderkey").alias("id"), T.serial(F.col("o_orderdate").cast("date"), F.col("nth") + F.col("base"), F.col("o_orderpriority")).alias("sr_no"))


@query("SELECT event_id, event_id + 1000 AS id, row_number() OVER (ORDER BY event_id) + (SELECT max(o_orderkey) FROM orders) AS sequence FROM events")
def global_sequence(spark, sf):
    """New rows numbered on from the largest id so far, by ranges of keys."""
    last = table(spark, sf, "orders").agg(F.max("o_orderkey").alias("last"))
    rows = exports.numbered(table(spark, sf, "events").select("event_id"), "event_id")
    return rows.crossJoin(F.broadcast(last)).select("event_id", (F.col("event_id") + 1000).alias("id"), (F.col("number") + F.col("last")).alias("sequence"))  # one row


@query("""SELECT o_orderkey AS id, substring(o_orderpriority, 1, 4) AS shown FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND (o_orderstatus = 'F' OR o_orderstatus IS NULL)""")
def not_in_list(spark, sf):
    rows = table(spark, sf, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & F.coalesce(F.col("o_orderstatus") == "F", F.lit(True)))
    return rows.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 4).alias("shown"))


@query("SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY 1")
def counts_descending(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")).cast("long"))  # one row for each brand


@query("""WITH u AS (SELECT l_orderkey AS id, 0 AS source, l_orderkey AS pos FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT o_orderkey, 1, o_orderkey FROM orders WHERE o_totalprice > 200000)
  SELECT id, min(source) AS source FROM u GROUP BY 1""")
def ordered_distinct_union(spark, sf):
    """Distinct ids of two lists with the list each is met in first; order by (source, id)."""
    one = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"), F.lit(0).alias("source"))
    two = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("source"))
    return one.unionByName(two).groupBy("id").agg(F.min("source").alias("source"))


_HELD = "parent_id IS NULL AND status = 'ingested' AND processed"


@query(f"""{_with('arrived')}, e AS (SELECT doc_id, lag(doc_id) OVER w AS supersedes, lead(doc_id) OVER w AS superseded_by FROM arrived WHERE {_HELD} WINDOW w AS (PARTITION BY filename ORDER BY doc_id))
  SELECT doc_id, filename, supersedes, superseded_by FROM arrived LEFT JOIN e USING (doc_id)""")
def reissue_links(spark, sf):
    """Which document each top-level one that was read to the end replaces, among files of one name."""
    found = intake.reissues(_rel(spark, sf, "arrived"), eligible=F.expr(_HELD), width=64)
    return found.select("doc_id", "filename", "supersedes", "superseded_by")


def _tree_sql(rounds: int) -> str:
    """The duplicates of each round without what lay inside the duplicates of the round before."""
    steps = ["g0 AS (SELECT id FROM every WHERE false)"]
    for k in range(1, rounds + 1):
        left = f"SELECT * FROM every WHERE id NOT IN (SELECT id FROM g{k - 1})"
        steps.append(f"d{k} AS (SELECT id, original FROM (SELECT id, arg_min(id, path) OVER (PARTITION BY file_hash) AS original FROM ({left})) WHERE original <> id)")
        steps.append(f"g{k} AS (SELECT DISTINCT id FROM (SELECT id, unnest(path[1:len(path) - 1]) AS up FROM every) WHERE up IN (SELECT id FROM d{k}))")
    return ", ".join(steps)


@query(f"""{_with('nested').replace('WITH ', 'WITH RECURSIVE ', 1)}, h AS (SELECT id, parent_id, sha256(CASE WHEN text <> '' THEN text WHEN parent_id IS NOT NULL THEN name ELSE '' END) AS file_hash FROM nested),
  every AS (SELECT id, file_hash, [id] AS path FROM h WHERE parent_id IS NULL UNION ALL SELECT h.id, h.file_hash, list_append(path, h.id) FROM h JOIN every ON h.parent_id = every.id), {_tree_sql(8)}
  SELECT id, path[1] AS root, len(path) - 1 AS depth, original AS duplicate_of FROM every LEFT JOIN d8 USING (id) WHERE id NOT IN (SELECT id FROM g8)""")
def document_tree(spark, sf):
    """Documents inside documents, without what lies in a duplicate at any depth."""
    found = intake.recorded_tree(_rel(spark, sf, "nested"))
    return found.select("id", "root", F.col("depth").cast("long").alias("depth"), "duplicate_of")
