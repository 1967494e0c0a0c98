"""Duties of clauses and decisions on withdrawals, on texts made from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T
from clauseloom.operators import decide, diagnose, exports, retrieve

from .documents import scores_sql
from .registry import Registry, table
from .state import ORACLES as ORACLES_OF_STATE
from .state import _REFS, _STRATA_SQL, _TARGETS, RELATIONS, _q, _rel, _with, grounded_decisions

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

RELATIONS["library"] = ("part", ("concat('T-', p_partkey) AS code", "concat('Check that every ', p_name, ' of ', p_brand, ' is kept as circular letter no ', p_size, ' of 2019 says.') AS text"), "p_partkey % 5 < 2")
RELATIONS["answers"] = ("part", ("p_partkey AS id", """concat('[{"code": "T-', p_size, '", "score": ', p_size % 7, '}, {"code": "', p_brand, '", "score": null}, {"score": ', p_partkey, '}]') AS reply"""), "p_partkey % 3 > 0")


_DUTIES = rf"""{_with('duties')}, l AS (SELECT id, trim(text) AS whole, string_split(trim(text), chr(10)) AS ls FROM duties),
  c AS (SELECT id, whole, trim(ls[1]) AS text, list_filter(list_transform(ls[2:], lambda x: trim(x)), lambda x: x <> '') AS attached FROM l),
  m AS (SELECT *, regexp_replace(text, '(,\s*and|;\s*and|,|;)\s+(shall|must|may not|is required to|are required to)\b', '@@\2', 'gi') AS marked FROM c),
  p AS (SELECT *, list_filter(list_transform(string_split(marked, '@@'), lambda x: trim(x, ' ,;')), lambda x: x <> '') AS parts, trim(regexp_replace(trim(string_split(string_split(text, ' shall')[1], ' must')[1]), {_q(L.LIST_ITEM)}, '')) AS s0 FROM m),
  s AS (SELECT *, CASE WHEN length(s0) > 60 THEN '' ELSE s0 END AS subject FROM p),
  f AS (SELECT *, list_filter(list_concat([parts[1]], list_transform(parts[2:], lambda x: trim(subject || ' ' || x))), lambda x: length(x) >= {L.MIN_DUTY}) AS full_parts FROM s),
  e AS (SELECT id, CASE WHEN len(parts) < 2 OR len(full_parts) < 2 THEN [whole] ELSE list_transform(full_parts[1:{L.MAX_DUTIES}], lambda x: array_to_string(list_concat([x], attached), chr(10))) END AS d FROM f)"""


@query(f"""{_DUTIES}
  SELECT id, generate_subscripts(d, 1) AS nth, unnest(d) AS duty FROM e""")
def split_duties(spark, sf):
    """The duties of clauses of all kinds, each with the lines attached to its clause."""
    each = _rel(spark, sf, "duties").select("id", F.posexplode(T.duties("text")).alias("nth", "duty"))
    return each.select("id", (F.col("nth") + 1).cast("long").alias("nth"), "duty")


@query(f"""{_with('cited', 'library')}, {scores_sql('library', 'code', 'cited', 'id')}, best AS (SELECT q, arg_max(struct_pack(test := test, dense := dense), dense - rank * 1e-9) AS b FROM top WHERE rank <= {L.TOP_K} GROUP BY 1),
  d AS (SELECT q, b.test AS test, b.dense AS dense, CASE WHEN regexp_matches(text, {_q(L.SUPERSESSION)}) THEN 'Deletion' WHEN b.dense >= {L.AMEND_AT} THEN 'Amendment' WHEN b.dense >= {L.NEW_AT} THEN 'New' ELSE 'No action' END AS change_type FROM best JOIN cited ON cited.id = q)
  SELECT q, test, dense, change_type, CASE change_type WHEN 'Amendment' THEN round(least(0.92, 0.45 + dense * 0.6), 2) WHEN 'New' THEN 0.66 WHEN 'No action' THEN 0.60 END AS confidence FROM d""")
def decisions_with_withdrawals(spark, sf):
    """The ladder over clauses some of which withdraw earlier rules: these ask for a Deletion, whatever they resemble."""
    asked = _rel(spark, sf, "cited")
    best = decide.best_by_cosine(retrieve.search(asked, _rel(spark, sf, "library").withColumnRenamed("code", "id")))
    rows = best.join(asked, F.col("q") == F.col("id"))
    change = decide.ladder(F.col("dense"), F.col("text").rlike(L.SUPERSESSION))
    return rows.withColumn("change_type", change).withColumn("confidence", decide.ladder_confidence(F.col("change_type"), F.col("dense"))).select("q", "test", "dense", "change_type", "confidence")


@query(f"""{_with('answers')}, e AS (SELECT id, unnest(CAST(json_extract(reply, '$[*]') AS JSON[])) AS x FROM answers)
  SELECT id, json_extract_string(x, '$.code') AS code, CAST(json_extract_string(x, '$.score') AS BIGINT) AS score FROM e""")
def json_arrays(spark, sf):
    """Each object of a JSON array as a row, with nulls for what it lacks."""
    return _rel(spark, sf, "answers").select("id", F.inline(F.from_json("reply", "array<struct<code:string,score:bigint>>"))).select("id", "code", "score")


@query(f"""{_DUTIES}, v AS (SELECT id, len(regexp_extract_all(text, {_q(L.OBLIGATION)})) AS verbs FROM duties) SELECT id, verbs FROM v JOIN e USING (id) WHERE verbs > 1 AND len(d) = 1""")
def missed_joins(spark, sf):
    """Clauses with several duty verbs in which only one duty was found."""
    return diagnose.missed_joins(_rel(spark, sf, "duties"))


@query(f"SELECT correction, count(*) AS n FROM ({ORACLES_OF_STATE['grounded_decisions']}) GROUP BY 1")
def correction_histogram(spark, sf):
    """How often each kind of correction was made to a decision."""
    return grounded_decisions(spark, sf).groupBy("correction").agg(F.count("*").alias("n"))


@query(f"{_with('props')} SELECT clause_id, max(id) AS id, arg_max(change_type, id) AS change_type, arg_max(status, id) AS status FROM props GROUP BY 1")
def last_proposal_of_clause(spark, sf):
    """The proposal that stands for a clause: the last one made."""
    last = F.max_by(F.struct("id", "change_type", "status"), "id").alias("p")
    return _rel(spark, sf, "props").groupBy("clause_id").agg(last).select("clause_id", "p.*")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 8 AS BIGINT) AS batch FROM orders")
def batches_of_eight(spark, sf):
    """Batches over the whole stream of orders, numbered by ranges of keys."""
    rows = exports.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0)
    return rows.select("o_orderkey", F.floor(F.col("number") / 8).cast("bigint").alias("batch"))


_DEPARTMENT = "CASE strata " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in L.DEPARTMENT_OF_STRATA.items()) + " END"


@query(f"""{_with('claims', 'catalogue')}, cited AS (SELECT * FROM claims), tests AS (SELECT * FROM catalogue), lib AS (SELECT test_code AS code, concat_ws(' ', test_description, strata, department, source_reference) AS text FROM catalogue WHERE is_active),
  {scores_sql('lib', 'code', 'claims', 'id')}, {_REFS}, {_TARGETS}, best AS (SELECT q, arg_max(struct_pack(test := test, dense := dense), dense - rank * 1e-9) AS b FROM top WHERE rank <= {L.TOP_K} GROUP BY 1),
  x AS (SELECT claims.id, text, {_STRATA_SQL} AS strata, b.test AS test, b.dense AS dense, targets.id IS NOT NULL AS gone, target, confidence FROM claims LEFT JOIN best ON q = claims.id LEFT JOIN targets ON targets.id = claims.id),
  y AS (SELECT *, CASE WHEN gone THEN 'Deletion' WHEN dense >= {L.AMEND_AT} THEN 'Amendment' WHEN test IS NULL OR dense >= {L.NEW_AT} THEN 'New' ELSE 'No action' END AS change_type FROM x),
  z AS (SELECT *, CASE change_type WHEN 'Deletion' THEN coalesce(target, test) WHEN 'Amendment' THEN test END AS code FROM y)
  SELECT z.id, change_type, z.code, test_description AS existing, exception_code, z.strata, {_DEPARTMENT.replace('strata', 'z.strata', 1)} AS department,
    coalesce(confidence, CASE change_type WHEN 'Amendment' THEN round(least(0.92, 0.45 + dense * 0.6), 2) WHEN 'New' THEN 0.66 WHEN 'No action' THEN 0.60 END) AS confidence
  FROM z LEFT JOIN (SELECT q, test AS code FROM top WHERE rank <= {L.TOP_K}) s ON s.q = z.id AND s.code = z.code LEFT JOIN catalogue ON test_code = s.code""")
def proposals(spark, sf):
    """A proposal for each clause: decision, withdrawal target, the test as it stands if it was on the shortlist, routing."""
    found = decide.propose(_rel(spark, sf, "claims"), _rel(spark, sf, "catalogue"), "2025-09-17")
    return found.select("id", "change_type", "code", "existing", "exception_code", "strata", "department", "confidence")
