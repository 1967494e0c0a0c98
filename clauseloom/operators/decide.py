"""The decision ladder, withdrawal targets and the grounding gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T

from . import index, retrieve


def ladder(dense: Column, withdraws: Column, has_candidates: Column | None = None) -> Column:
    """Change type by rule: withdrawal, then cosine thresholds; no candidates at all means New."""
    some = F.lit(True) if has_candidates is None else has_candidates
    return (
        F.when(withdraws, "Deletion").when(some & (dense >= L.AMEND_AT), "Amendment").when(~some | (dense >= L.NEW_AT), "New").otherwise("No action")
    )


def ladder_confidence(change: Column, dense: Column) -> Column:
    return (
        F.when(change == "Amendment", F.round(F.least(F.lit(0.92), 0.45 + dense * 0.6), 2)).when(change == "New", F.lit(0.66)).when(change == "No action", F.lit(0.60))
    )


def best_by_cosine(found: DataFrame) -> DataFrame:
    """The candidate with the best cosine of each query; ties by fused rank."""
    return found.groupBy("q").agg(F.max_by(F.struct("test", "dense", "rank"), F.struct("dense", -F.col("rank"))).alias("best")).select("q", "best.test", "best.dense")


def withdrawal_targets(clauses: DataFrame, library: DataFrame) -> DataFrame:
    """Rows (id, tier, reference, target, others, confidence) of clauses (id, text) that withdraw something.

    The first cited reference that has citing active tests gives the target (lowest code).
    """
    asked = clauses.where(F.col("text").rlike(L.SUPERSESSION)).select("id", T.cited_references("text").alias("refs"))
    cited = asked.select("id", F.posexplode("refs").alias("pos", "reference")).withColumn("norm", T.normal_reference("reference"))
    tests = library.where("is_active").select(T.normal_reference("source_reference").alias("norm"), "test_code")
    citing = tests.where("norm <> ''").groupBy("norm").agg(F.min("test_code").alias("target"), F.count("*").alias("n"))  # a row for each reference, not for each test that cites it
    met = cited.join(citing, "norm").groupBy("id", "pos", "reference").agg(F.min("target").alias("target"), F.sum("n").alias("n"))
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("nth = 1").drop("nth", "pos")
    out = asked.join(first, "id", "left")
    tier = F.when(F.col("target").isNotNull(), "source match").when(F.size("refs") > 0, "subject only").otherwise("unnamed")
    sure = F.when(F.col("target").isNotNull(), 0.85).when(F.size("refs") > 0, 0.30).otherwise(0.45)
    return out.select("id", tier.alias("tier"), F.coalesce("reference", F.get("refs", F.lit(0))).alias("reference"), "target", (F.coalesce("n", F.lit(1)) - 1).alias("others"), sure.alias("confidence"))


def ground(decisions: DataFrame, codes: DataFrame) -> DataFrame:
    """Gate decisions (…, change_type, code, existing, proposed, confidence) against known ``codes`` (code).

    Adds ``correction`` (null where nothing was wrong); corrected rows become No action with
    confidence at most 0.5, while a New only loses a stray code.
    """
    known = codes.select(F.upper(F.trim("code")).alias("known")).distinct()
    rows = decisions.join(known, F.upper(F.trim(F.col("code"))) == F.col("known"), "left")
    change, named = T.change_type("change_type"), F.coalesce(F.trim("code"), F.lit("")) != ""
    invented = named & F.col("known").isNull()
    needs = change.isin("Amendment", "Deletion")
    line = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")[0]
    correction = (
        F.when((change == "No action") & (T.flat(F.regexp_replace(F.lower(F.coalesce("change_type", F.lit(""))), "[^a-z ]", " ")) != "no action"), "unknown_type")
        .when(needs & invented, "invented_code")
        .when(needs & ~named, "missing_target")
        .when((change == "Amendment") & T.same_wording(line(F.col("existing")), line(F.col("proposed"))), "empty_change")
    )
    sure = T.confidence("confidence")
    bad = correction.isNotNull() | (change == "No action")
    blank = lambda c: F.when(bad, None).otherwise(F.col(c))
    out = rows.select(
        *[F.col(c) for c in decisions.columns if c not in ("change_type", "code", "existing", "proposed", "confidence")],
        F.when(correction.isNotNull(), "No action").otherwise(change).alias("change_type"),
        F.when(bad | ((change == "New") & invented), None).otherwise(F.col("code")).alias("code"),
        blank("existing").alias("existing"), blank("proposed").alias("proposed"),
        F.when(correction.isNotNull(), F.least(sure, F.lit(0.5))).otherwise(sure).alias("confidence"),
        F.coalesce(correction, F.when((change == "New") & invented, F.lit("stray_code"))).alias("correction"),
    )
    return out


def propose(obligations: DataFrame, library: DataFrame, day: str) -> DataFrame:
    """A proposal row for each obligation (id, text): decision, wording, routing, serial and candidates.

    ``library`` has test_code, test_description, source_reference, strata, department,
    exception_code, is_active, and exception_description if it is to be searched; the test that a
    proposal acts on is shown as it stands now (``existing``, ``before``), and only if it is on the
    shortlist that was weighed.  ``day`` dates the serials, which run within each subject.
    """
    tests = library.where("is_active").select(F.col("test_code").alias("id"), index.searchable(library.columns).alias("text"))
    found = retrieve.search(obligations.select("id", "text"), tests)
    best = best_by_cosine(found)
    shown = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "test", "dense", "sparse", "fused"))).alias("candidates"))
    targets = withdrawal_targets(obligations, library).withColumnRenamed("id", "w")
    rows = obligations.join(best, obligations["id"] == best["q"], "left").drop("q").join(shown, obligations["id"] == shown["q"], "left").join(targets, F.col("id") == F.col("w"), "left")
    change = ladder(F.coalesce("dense", F.lit(0.0)), F.col("w").isNotNull(), F.col("test").isNotNull())
    rows = rows.withColumn("change_type", change).withColumn("code", F.when(change == "Deletion", F.coalesce("target", "test")).when(change == "Amendment", F.col("test")))
    frozen = [c for c in ("exception_code", "exception_description", "strata", "department", "risk_rating", "source_reference") if c in library.columns]
    known = library.groupBy(F.col("test_code").alias("code")).agg(F.max_by(F.struct("test_description", *frozen), F.struct(*frozen, "test_description")).alias("held"))
    rows = rows.join(known, "code", "left").withColumn("held", F.when(F.exists("candidates", lambda c: c["test"] == F.col("code")), F.col("held")))
    owners = library.groupBy(F.col("test_code").alias("test")).agg(F.max("department").alias("owner"))
    rows = rows.join(owners, "test", "left")
    subject = T.strata("text")
    proposed = F.when(F.col("change_type").isin("Amendment", "New"), T.draft_test("text"))
    nth = F.dense_rank().over(Window.partitionBy(subject).orderBy("id"))
    return rows.select(
        "id", T.serial(F.lit(day).cast("date"), nth, subject).alias("sr_no"), "change_type", "code", F.col("held.test_description").alias("existing"), F.col("held.exception_code").alias("exception_code"),
        proposed.alias("proposed"), T.exception_wording(proposed).alias("proposed_exception"), subject.alias("strata"),
        T.department(subject, F.col("owner")).alias("department"), T.risk("text").alias("risk"), T.root_cause("text").alias("root_cause"),
        F.coalesce("confidence", ladder_confidence(F.col("change_type"), F.col("dense"))).alias("confidence"), F.slice("candidates", 1, 6).alias("candidates"),
        F.struct(*(F.col(f"held.{c}").alias(c) for c in frozen)).alias("before"),
    )


def recover(decisions: DataFrame, by_rules: DataFrame) -> DataFrame:
    """Decisions (id, change_type, code, …) with the rules' answer where a model's came to nothing.

    A rules' row (the same columns) takes over only if it proposes a change itself.
    """
    others = [c for c in decisions.columns if c != "id"]
    rules = by_rules.where("change_type <> 'No action'").select(F.col("id").alias("__id__"), F.struct(*others).alias("__rules__"))
    rows = decisions.join(rules, (F.col("id") == F.col("__id__")) & (F.col("change_type") == "No action"), "left")
    taken = F.col("__id__").isNotNull()
    return rows.select("id", *(F.when(taken, F.col(f"__rules__.{c}")).otherwise(F.col(c)).alias(c) for c in others), taken.alias("recovered"))
