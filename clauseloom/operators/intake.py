"""Intake: content de-duplication, outcomes, reissues and supersession as derived views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.sources.storage import shared_folder


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add file_hash and duplicate_of (the first document with the same content, else null).

    One row per content is combined before the shuffle, so a content that a third of the
    documents share is joined, not sorted in one task.
    """
    hashed = docs.withColumn("file_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    first = hashed.groupBy("file_hash").agg(F.min(id_col).alias("first"))
    out = hashed.join(first, "file_hash")
    return out.withColumn("duplicate_of", F.when(F.col("first") != F.col(id_col), F.col("first"))).drop("first")


def outcomes(docs: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Add outcome: error (blank text), unchanged (same content and name already processed), duplicate or ingested."""
    rows = first_copies(docs)
    if processed is not None:
        done = processed.select("file_hash", "filename").distinct().withColumn("done", F.lit(True))
        rows = rows.join(done, ["file_hash", "filename"], "left")
    else:
        rows = rows.withColumn("done", F.lit(None).cast("boolean"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    outcome = F.when(blank, "error").when(F.col("done"), "unchanged").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("ingested")
    return rows.withColumn("outcome", outcome).drop("done")


def reissues(docs: DataFrame, name_col: str = "filename", id_col: str = "doc_id", eligible: Column | None = None, width: int = 1 << 16) -> DataFrame:
    """Add supersedes and superseded_by: the neighbours by id among the ``eligible`` documents of one name.

    Eligible are usually top-level documents that were ingested to the end; others get nulls and
    are nobody's neighbour.  A name is read by ranges of ``width`` ids (integers), so that one
    that a third of the documents have is no single task's.
    """
    able = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    rows = docs.withColumn("__able__", able).withColumn("__range__", F.when(F.col("__able__"), F.expr(f"`{id_col}` div {width}")))
    ends = rows.where("__able__").groupBy(name_col, "__range__").agg(F.min(id_col).alias("__low__"), F.max(id_col).alias("__high__"))
    by_range = Window.partitionBy(name_col).orderBy("__range__")  # a row for each range
    ends = ends.select(name_col, "__range__", F.lag("__high__").over(by_range).alias("__before__"), F.lead("__low__").over(by_range).alias("__after__"))
    order = Window.partitionBy(name_col, "__range__").orderBy(id_col)
    inner = rows.withColumn("__lag__", F.when(F.col("__able__"), F.lag(id_col).over(order))).withColumn("__lead__", F.when(F.col("__able__"), F.lead(id_col).over(order)))
    out = inner.join(ends, [name_col, "__range__"], "left")
    return out.select(*docs.columns, F.coalesce("__lag__", "__before__").alias("supersedes"), F.coalesce("__lead__", "__after__").alias("superseded_by"))


def flatten_tree(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """Rows (id, root, depth) of a forest (id, parent_id), at most ``depth`` levels below a root."""
    level = nodes.where("parent_id is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        up = level.select(F.col("id").alias("parent_id"), "root")
        level = nodes.select("id", "parent_id").join(up, "parent_id").select("id", "root", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def recorded_tree(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """Rows (id, root, depth, file_hash, duplicate_of) of the documents of a forest that are recorded.

    ``nodes`` has id, parent_id, name and text.  They arrive as one reads a tree: a document, then
    its first child with all below it.  One with the content of a document recorded before it is
    its duplicate, and what lies inside a duplicate is not recorded, at any depth, so it is nobody's
    original either.  A child without text goes by its name.  Each round finds the duplicates among
    what the last one left; the first document on which two rounds differ comes later every time.
    """
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).when(F.col("parent_id").isNotNull(), F.col("name"))
    held = nodes.select("id", "parent_id", F.sha2(F.coalesce(text, F.lit("")), 256).alias("file_hash"))
    level = held.where("parent_id is null").select("id", "file_hash", F.array("id").alias("path"))
    every = level
    for _ in range(depth):
        level = held.join(level.select(F.col("id").alias("parent_id"), "path"), "parent_id").select("id", "file_hash", F.concat("path", F.array("id")).alias("path"))
        every = every.unionByName(level)
    shared_folder(nodes.sparkSession)
    every, gone = every.checkpoint(), None
    while True:
        left = every if gone is None else every.join(gone, "id", "left_anti")
        first = left.groupBy("file_hash").agg(F.min("path").alias("first"))
        found = left.join(first, "file_hash").withColumn("original", F.element_at("first", -1)).where("original <> id").select("id", "original")
        above = every.select("id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("up"))
        now = above.join(found.select(F.col("id").alias("up")), "up", "left_semi").select("id").distinct().checkpoint()
        same = gone is not None and now.join(gone, "id", "left_anti").isEmpty() and gone.join(now, "id", "left_anti").isEmpty()
        gone = now
        if same:
            break
    kept = every.join(gone, "id", "left_anti").join(found, "id", "left")
    return kept.select("id", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "file_hash", F.col("original").alias("duplicate_of"))


def human_touched(documents: DataFrame, clauses: DataFrame, proposals: DataFrame, approvals: DataFrame, revisions: DataFrame) -> DataFrame:
    """Documents that a person has decided on or edited: no rerun may alter them."""
    touched = approvals.select("proposal_id").union(revisions.select("proposal_id")).distinct()
    decided = proposals.join(touched, proposals["id"] == touched["proposal_id"], "left_semi").select("clause_id")
    held = clauses.join(decided, clauses["id"] == decided["clause_id"], "left_semi").select("document_id")
    return documents.join(held, documents["id"] == held["document_id"], "left_semi")


def arrival_order(emails: DataFrame, folder: DataFrame) -> DataFrame:
    """Both sources as one, with ``arrival``: mail first, so that its copy of a content is the original."""
    return emails.withColumn("arrival", F.lit(0)).unionByName(folder.withColumn("arrival", F.lit(1)))


def already_processed(arrivals: DataFrame, documents: DataFrame, completed: DataFrame, touched: DataFrame) -> DataFrame:
    """Add (known_id, action) to ``arrivals`` (filename, file_hash, …).

    An arrival is known by name and content together.  ``completed`` and ``touched`` list
    document ids: a complete one is ``unchanged``, an unfinished one that nobody acted on is
    read again (``reclaim``), any other is ``left`` to a person; unknown ones are ``new``.
    """
    known = documents.groupBy("filename", "file_hash").agg(F.min("id").alias("known_id"))
    done = completed.select(F.col("document_id").alias("known_id")).distinct().withColumn("done", F.lit(True))
    acted = touched.select(F.col("document_id").alias("known_id")).distinct().withColumn("acted", F.lit(True))
    rows = arrivals.join(known, ["filename", "file_hash"], "left").join(done, "known_id", "left").join(acted, "known_id", "left")
    action = F.when(F.col("known_id").isNull(), "new").when(F.col("done"), "unchanged").when(F.col("acted"), "left").otherwise("reclaim")
    return rows.select(*arrivals.columns, "known_id", action.alias("action"))


def supersede(pairs: DataFrame, proposals: DataFrame, approvals: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals with the status after supersession, counts (old_id, new_id, withdrawn, kept)).

    ``pairs`` (old_id, new_id) link a reissued document to its successor.  Waiting changes of
    the old document that nobody has acted on are withdrawn, all others stay as they are.
    """
    acted = approvals.select("proposal_id").union(revisions.select("proposal_id")).distinct().withColumn("acted", F.lit(True))
    rows = proposals.join(pairs, proposals["document_id"] == pairs["old_id"], "left").join(acted, F.col("id") == F.col("proposal_id"), "left")
    waits = F.col("status").isin("Pending review", "Changes requested") & (F.col("change_type") != "No action")
    gone = F.col("old_id").isNotNull() & waits & F.col("acted").isNull()
    rows = rows.withColumn("gone", gone)
    after = rows.select(*[c for c in proposals.columns if c != "status"], F.when(F.col("gone"), "Withdrawn (superseded)").otherwise(F.col("status")).alias("status"))
    live = (F.col("change_type") != "No action") & (F.col("status") != "Withdrawn (superseded)") & ~F.col("gone")
    found = rows.where("old_id is not null").groupBy("old_id").agg(F.count_if("gone").alias("withdrawn"), F.count_if(live).alias("kept"))
    none = F.lit(0).cast("long")
    return after, pairs.join(found, "old_id", "left").select("old_id", "new_id", F.coalesce("withdrawn", none).alias("withdrawn"), F.coalesce("kept", none).alias("kept"))


def rejudge(clauses: DataFrame, verdicts: DataFrame, human: DataFrame) -> DataFrame:
    """Clauses after new verdicts on those a fallback judged; adds ``outcome``.

    ``clauses`` (id, is_actionable, judged_by, …), ``verdicts`` (id, actionable, judge), ``human``
    (clause_id): a person acted on it.  Only clauses with no verdict yet and a fallback judge
    are queued; a verdict by rules leaves them queued, and a person's work is never altered.
    """
    new = verdicts.select(F.col("id").alias("v"), "actionable", "judge")
    held = human.select(F.col("clause_id").alias("h")).distinct()
    rows = clauses.join(new, F.col("id") == F.col("v"), "left").join(held, F.col("id") == F.col("h"), "left")
    queued = F.col("is_actionable").isNull() & F.coalesce(F.col("judged_by").startswith("rules ("), F.lit(False))
    outcome = F.when(queued, F.when(F.col("judge").isNull() | F.col("judge").startswith("rules ("), "still_provisional").when(F.col("h").isNotNull(), "kept_human").otherwise("confirmed"))
    rows = rows.withColumn("outcome", outcome)
    sure = F.col("outcome") == "confirmed"
    return rows.select(
        *[c for c in clauses.columns if c not in ("is_actionable", "judged_by")], F.when(sure, F.col("actionable")).otherwise(F.col("is_actionable")).alias("is_actionable"),
        F.when(sure, F.col("judge")).when(F.col("outcome") == "kept_human", "kept: a person acted on it").otherwise(F.col("judged_by")).alias("judged_by"), "outcome",
    )


def pending_obligations(obligations: DataFrame, clauses: DataFrame, documents: DataFrame, proposals: DataFrame) -> DataFrame:
    """Obligations of ingested documents' clauses, actionable or not yet judged, that have no proposal.

    Adds document_id and ``place``: the order by document, clause and obligation.
    """
    live = clauses.where("coalesce(is_actionable, true)").select(F.col("id").alias("clause_id"), "document_id", F.col("sequence").alias("clause_sequence"))
    whole = documents.where("status = 'ingested'").select(F.col("id").alias("document_id"))
    rows = obligations.join(live, "clause_id").join(whole, "document_id").join(proposals.select(F.col("obligation_id").alias("id")), "id", "left_anti")
    order = Window.partitionBy("document_id").orderBy("clause_sequence", "sequence", "id")
    return rows.withColumn("place", F.row_number().over(order))
