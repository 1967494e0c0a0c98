"""Citations, withdrawal targets, the grounding gate and drafting on worked examples."""

from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import decide

DUTIES = [
    (1, "Each branch shall keep a signed register of visitors at the door, and shall hand it to the auditor on request without any delay"),
    (2, "The officer must count the drawer twice every evening; must note the count in the ledger kept for that purpose, shall report any gap to the manager"),
    (3, "Branches shall reconcile daily and shall file the sheet"),
    (4, "A short one shall be, shall it"),
]
REFERENCES = [
    (1, "As told in BRXD Circular No. 7 of 2020, the rules of circular letter no.03 of 2019 shall stand withdrawn."),
    (2, "CIRCULAR LETTER NO. 12 OF 2018 is superseded."),
    (3, "Nothing is cited here, yet it is no longer applicable."),
    (4, "Keep Circular No. 5 of 2021 at hand."),
]
LIBRARY = [
    ("T-1", "Check that the old rule is kept.", "Circular Letter No. 3 of 2019", True),
    ("T-2", "Check that the second old rule is kept.", "circular letter no 003 of 2019", True),
    ("T-0", "Check that a closed rule is kept.", "Circular Letter No. 12 of 2018", False),
]
DECISIONS = [
    (1, "amendment", "T-1", "Check that a is kept.", "Check that b is kept.", "0.8"), (2, "merge", "T-1", None, "x", "0.9"), (3, "Amendment", "T-9", "a", "b", "high"),
    (4, "New", "T-9", None, "Check that c is kept.", "2"), (5, "Deletion", None, None, None, "-1"), (6, "Amendment", " t-2 ", "Check that d.", "check  that d", "0.7"), (7, "NO_ACTION", None, None, None, None),
]


def test_citations(spark):
    rows = spark.createDataFrame(REFERENCES, "id long, text string")
    got = rows.select("id", F.transform(T.cited_references("text"), lambda x: F.regexp_replace(T.normal_reference(x), "^.*?(?=circular)", "")).alias("refs")).collect()
    assert {r.id: r.refs for r in got} == {1: ["circular no 7 of 2020", "circular letter no 3 of 2019"], 2: ["circular letter no 12 of 2018"], 3: [], 4: ["circular no 5 of 2021"]}


def test_withdrawal_targets(spark):
    library = spark.createDataFrame(LIBRARY, "test_code string, test_description string, source_reference string, is_active boolean")
    got = decide.withdrawal_targets(spark.createDataFrame(REFERENCES, "id int, text string"), library).collect()
    assert {(r.id, r.tier, r.target, r.others, r.confidence) for r in got} == {(1, "source match", "T-1", 1, 0.85), (2, "subject only", None, 0, 0.30), (3, "unnamed", None, 0, 0.45)}


def test_many_tests_of_one_reference_meet_as_one_row(spark):
    """300 clauses and 3,000 tests that cite one circular: the largest table is a row for each of either, no pairs."""
    library = spark.range(3_000).selectExpr("format_string('T-%04d', id) AS test_code", "'Circular Letter No. 3 of 2019' AS source_reference", "true AS is_active")
    clauses = spark.range(300).selectExpr("id", "'The rules of circular letter no.03 of 2019 shall stand withdrawn.' AS text")
    found = decide.withdrawal_targets(clauses, library)
    assert {tuple(r)[1:] for r in found.collect()} == {("source match", "circular letter no.03 of 2019", "T-0000", 2_999, 0.85)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Join Inner") :]  # the tests are counted before they meet the clauses
    assert "min(test_code" in below and "count(1)" in below


def test_grounding_gate(spark):
    rows = spark.createDataFrame(DECISIONS, "id int, change_type string, code string, existing string, proposed string, confidence string")
    got = decide.ground(rows, spark.createDataFrame([(r[0],) for r in LIBRARY], "code string")).collect()
    assert {(r.id, r.change_type, r.code, r.confidence, r.correction) for r in got} == {
        (1, "Amendment", "T-1", 0.8, None), (2, "No action", None, 0.5, "unknown_type"), (3, "No action", None, 0.5, "invented_code"), (4, "New", None, 1.0, "stray_code"),
        (5, "No action", None, 0.0, "missing_target"), (6, "No action", None, 0.5, "empty_change"), (7, "No action", None, 0.6, None),
    }


def test_drafting(spark):
    rows = spark.createDataFrame(DUTIES, "id int, text string").select("id", T.draft_test("text").alias("t"), T.root_cause("text").alias("c"), T.risk("text").alias("r"))
    got = {r.id: (r.t, r.c, r.r) for r in rows.collect()}
    assert got[1] == ("Check that each branch keep a signed register of visitors at the door, and shall hand it to the auditor on request without any delay.", "Process / Procedure Gap", "Medium")
    assert got[2][0].startswith("Check that the officer count the drawer twice every evening; must note the count") and got[2][1:] == ("Implementation Gap", "High")
    assert got[3][0] == "Check that branches reconcile daily and shall file the sheet." and got[4][0] == "Check that a short one shall be, shall it."
