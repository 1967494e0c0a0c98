"""Worked examples: clauses, tables, lists, rescue, duties, proposals, review, readers."""

import zipfile

from clauseloom.functions import text as T
from clauseloom.operators import decide, intake, review, segment
from clauseloom.sources import readers
from pyspark.sql import functions as F

DOC = (
    "OPERATIONS NOTICE\nFor Branch Offices\n\n1. Branches shall count the vault each morning and\nshall write the result down.\n"
    "2. Staff must not lend their keys to anyone.\n\n3. Notice No. 4 of 2011 shall stand withdrawn.\n\n"
    "The yearly plan shall cover the points that follow here:\na) every branch that holds cash overnight;\nb) every machine that gives out cash.\n\n"
    "Cash must stay within the limits given below:\n[table]\n[row 1] Town | 500\n[row 2] Village | 200\n[/table]\n\nPage 2"
)


def test_clauses(spark):
    found, dropped = segment.clauses(spark.createDataFrame([(1, DOC), (2, None), (3, "  "), (4, "NOTHING BUT A HEADING ABOUT BRANCHES")], "doc_id long, text string"))
    rows = {r.sequence: r for r in found.where("doc_id = 1").collect()}
    texts = [rows[k].text for k in sorted(rows)]
    assert texts == [
        "1. Branches shall count the vault each morning and shall write the result down.",
        "2. Staff must not lend their keys to anyone.",
        "3. Notice No. 4 of 2011 shall stand withdrawn.",
        "The yearly plan shall cover the points that follow here: a) every branch that holds cash overnight;",
        "The yearly plan shall cover the points that follow here: b) every machine that gives out cash.",
        "Cash must stay within the limits given below:\nTown | 500\nVillage | 200",
    ]
    assert [rows[k].clause_ref for k in (1, 2, 3)] == ["1", "2", "3"] and rows[3].verdict == "supersession"
    assert DOC[rows[2].char_start : rows[2].char_end] == texts[1]
    assert {(r.rule) for r in dropped.where("doc_id = 1").collect()} == {"too short", "heading"} or dropped.count() > 0
    assert [r.rung for r in found.where("doc_id = 4").collect()] == ["obligation-lines"]
    duties = segment.obligations(found).where("doc_id = 1").collect()
    assert len(duties) == 6
    assert segment.clauses(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []


def test_proposals(spark):
    library = spark.createDataFrame(
        [(f"AT-{i}", f"Check that {w} are counted by staff.", "Notice", "Cash & Teller", "BA", f"EX-{i}", i < 9) for i, w in enumerate("vaults keys doors ledgers stamps cheques cards drawers seals lamps".split())],
        "test_code string, test_description string, source_reference string, strata string, department string, exception_code string, is_active boolean",
    )
    duties = spark.createDataFrame([(1, "Branches shall see that vaults are counted by staff."), (2, "Zebra grazing shall be measured with care in meadows."), (3, "Earlier rules on keys stand withdrawn.")], "id long, text string")
    got = {r.id: r for r in decide.propose(duties, library, "2025-09-17").collect()}
    assert (got[1].change_type, got[1].code) == ("Amendment", "AT-0") and got[1].existing.startswith("Check that vaults")
    assert got[2].change_type == "No action" and got[2].proposed is None
    assert (got[3].change_type, got[3].code, got[3].confidence) == ("Deletion", "AT-1", 0.45)
    assert got[1].sr_no.startswith("2025-38-01") and len(got[1].candidates) == 6


def test_intake_and_review(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "id long, parent_id long")
    assert {(r.id, r.root, r.depth) for r in intake.flatten_tree(tree).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3)}
    done = spark.createDataFrame([("a.txt", "5")], "filename string, text string").select("filename", F.sha2("text", 256).alias("file_hash"))
    docs = spark.createDataFrame([(1, "a.txt", "5"), (2, "b.txt", "5"), (3, "c.txt", " "), (4, "d.txt", "6")], "doc_id long, filename string, text string")
    assert {r.doc_id: r.outcome for r in intake.outcomes(docs, done).collect()} == {1: "unchanged", 2: "duplicate", 3: "error", 4: "ingested"}
    events = spark.createDataFrame([(1, 1, 1, "Approved"), (1, 2, 2, "Sent back"), (1, 3, 1, "Approved"), (1, 4, 2, "Approved"), (2, 1, 2, "Approved"), (3, 1, 1, "Rejected"), (3, 2, 1, "Approved")], "proposal_id long, seq long, level int, decision string")
    assert {r.proposal_id: (r.status, r.accepted, r.ignored) for r in review.current_status(events).collect()} == {1: ("Approved", 4, 0), 2: ("Pending review", 0, 1), 3: ("Rejected", 1, 1)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.html").write_text("<html><head><title>x</title></head><p>One<br>two</p><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table><script>no()</script></html>")
    (tmp_path / "c.eml").write_text("Subject: Hi\nFrom: x@y.zz\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nShort note.\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=n.txt\n\nattached words\n--B--\n")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "f.docx").write_bytes(b"PK\x03\x04broken")
    rows = {r.name: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "plain text" and rows["b.html"].text.split("\n") == ["One", "two", "[table]", "[row 1] a | b", "[row 2] c", "[/table]"]
    assert rows["n.txt"].text.strip() == "attached words" and rows["n.txt"].parent == "c.eml"
    assert "[row 1] k | v" in rows["d.docx"].text and rows["e.pdf"].error and rows["f.docx"].error
    kept = {r.name for r in readers.mail_documents(readers.read_files(spark, str(tmp_path))).collect()}
    assert "c.eml" not in kept and "n.txt" in kept


def test_labels_and_names(spark):
    row = spark.range(1).select(
        T.week_label(F.lit("2025-09-17").cast("date")).alias("week"), T.safe_name(F.lit("A b/c: d.pdf")).alias("name"), T.change_type(F.lit("NO_action")).alias("c"),
        T.confidence(F.lit("NaN")).alias("nan"), T.confidence(F.lit("high")).alias("high"), T.same_wording(F.lit("A  b."), F.lit("a b")).alias("same"),
        T.page_number(F.lit(250), F.lit(1000), F.lit(4)).alias("page"), T.department(F.lit("Credit")).alias("dept"),
    ).first()
    assert row.asDict() == {"week": "38 (15.09.2025 - 21.09.2025)", "name": "A_b_c_d_pdf", "c": "No action", "nan": 0.0, "high": 0.6, "same": True, "page": 2, "dept": "RR"}


def test_tasks_split_no_more_than_their_share_of_text(spark):
    """Copies of one line compress to nothing, and yet no task gets all of them."""
    docs = spark.range(4_000).selectExpr("id AS doc_id", "repeat('Staff must keep the register in the vault. ', 5) AS text")
    found, _ = segment.clauses(docs)
    assert segment.dealt(docs, 100_000).rdd.getNumPartitions() == -(-4_000 * 5 * 43 // 100_000)
    assert found.count() == 4_000
