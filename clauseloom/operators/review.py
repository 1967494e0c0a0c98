"""Two-level review as an ordered fold of append-only decision events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDITABLE = ("proposed_test_description", "proposed_exception_description", "strata_tag", "risk_rating")


def next_state(status: Column, level: Column, decision: Column) -> Column:
    """The status after one event; an event the status does not accept changes nothing."""
    first = (level == 1) & status.isin("Pending review", "Changes requested")
    second = (level == 2) & (status == "Pending approval")
    after_first = F.when(decision == "Approved", "Pending approval").when(decision == "Rejected", "Rejected").otherwise("Changes requested")
    after_second = F.when(decision == "Approved", "Approved").when(decision == "Rejected", "Rejected").otherwise("Changes requested")
    return F.when(first, after_first).when(second, after_second).otherwise(status)


#: All that a proposal can be, the first of them at the start.
STATUSES = ("Pending review", "Pending approval", "Approved", "Rejected", "Changes requested")


def moves(level: np.ndarray, decision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(to, taken): for each event and each status before it, the status after it and whether it was accepted."""
    waits, second = np.array([0, 4]), 1
    to, taken = np.tile(np.arange(len(STATUSES)), (len(level), 1)), np.zeros((len(level), len(STATUSES)), np.int64)
    yes, no = decision == "Approved", decision == "Rejected"
    for at_level, before, approved in ((1, waits, 1), (2, np.array([second]), 2)):
        rows = np.flatnonzero(level == at_level)
        to[rows[:, None], before] = np.where(yes[rows], approved, np.where(no[rows], 3, 4))[:, None]
        taken[rows[:, None], before] = 1
    return to, taken


def composed(start: np.ndarray, to: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(to, taken) of each run of events as one: runs begin at ``start``, and neighbours are composed in pairs.

    Functions from status to status compose associatively, so a run is halved until one is left.
    """
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(to))))
    while len(run) > len(start):
        begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        nth = np.arange(len(run)) - np.repeat(begin, np.diff(np.append(begin, len(run))))
        first = np.flatnonzero(nth % 2 == 0)
        paired = (first + 1 < len(run)) & (run[np.minimum(first + 1, len(run) - 1)] == run[first])
        f, g = first[paired], first[paired] + 1
        new_to, new_taken = to[first], taken[first]
        new_taken[paired] = taken[f] + np.take_along_axis(taken[g], to[f], axis=1)
        new_to[paired] = np.take_along_axis(to[g], to[f], axis=1)
        run, to, taken = run[first], new_to, new_taken
    return to, taken


def current_status(events: DataFrame) -> DataFrame:
    """Rows (proposal_id, status, accepted, ignored) from events (proposal_id, seq, level, decision).

    Events go to ranges of (proposal, order), so a proposal with very many of them is spread over
    tasks.  Each task makes one function of status to status of a proposal's events there; the few
    functions of a proposal are then applied in turn.  Events of equal order go by level and decision.
    """
    order = ["proposal_id", "seq", "level", "decision"]
    kind = dict(events.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            if not len(pdf):
                continue
            key = pdf["proposal_id"].to_numpy()
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            to, taken = composed(start, *moves(pdf["level"].to_numpy(), pdf["decision"].to_numpy()))
            made = pdf.iloc[start].assign(to=list(to), taken=list(taken), n=np.diff(np.append(start, len(pdf))))
            if held is not None and held["proposal_id"].iloc[0] == key[0]:
                pair = np.stack([held["to"].iloc[0], made["to"].iloc[0]]), np.stack([held["taken"].iloc[0], made["taken"].iloc[0]])
                to, taken = composed(np.array([0]), *pair)
                joined = held.assign(to=list(to), taken=list(taken), n=held["n"] + made["n"].iloc[0])
                made = pd.concat([joined, made.iloc[1:]])
            elif held is not None:
                yield held
            yield made.iloc[:-1]
            held = made.iloc[-1:]
        if held is not None:
            yield held

    ranged = events.select(*order).where("proposal_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranged.mapInPandas(fold, ", ".join(f"{c} {kind[c]}" for c in order) + ", `to` array<int>, taken array<bigint>, n bigint")
    one = F.struct("seq", "level", "decision", "to", "taken", "n")
    log = parts.groupBy("proposal_id").agg(F.array_sort(F.collect_list(one)).alias("log"))  # a row for each task that has the proposal
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("all"))
    step = lambda s, e: F.struct(F.get(e["to"], s["at"]).alias("at"), (s["accepted"] + F.get(e["taken"], s["at"])).alias("accepted"), (s["all"] + e["n"]).alias("all"))
    state = log.select("proposal_id", F.aggregate("log", start, step).alias("s"))
    name = F.get(F.array(*map(F.lit, STATUSES)), F.col("s.at"))
    return state.select("proposal_id", name.alias("status"), F.col("s.accepted").cast("int").alias("accepted"), (F.col("s.all") - F.col("s.accepted")).cast("int").alias("ignored"))


def current_fields(proposals: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows (proposal_id, field, value): the last edit of each editable field (revisions: proposal_id, seq, field, new_value)."""
    edits = revisions.where(F.col("field").isin(*EDITABLE)).groupBy("proposal_id", "field").agg(F.max_by("new_value", "seq").alias("value"))
    return proposals.select(F.col("id").alias("proposal_id")).join(edits, "proposal_id")


def export(proposals: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved live changes with their last level-2 decision, refusals with the reason)."""
    last = approvals.where("level = 2").groupBy("proposal_id").agg(F.max_by(F.struct("decided_by", "decided_at"), "id").alias("final"))
    live = F.col("change_type") != "No action"
    ready = (F.col("status") == "Approved") & live
    out = proposals.where(ready).join(last, F.col("id") == F.col("proposal_id"), "left").select(*proposals.columns, "final.decided_by", "final.decided_at")
    why = F.when(~live, "no change").otherwise(F.concat(F.lit("status is "), "status"))
    return out, proposals.where(~ready | ready.isNull()).withColumn("reason", why)


def edits(proposals: DataFrame, changes: DataFrame) -> DataFrame:
    """Revisions (proposal_id, field, old_value, new_value) that really change an editable field.

    ``proposals`` has a column for each field; ``changes`` (proposal_id, field, new_value).  Text
    that is equal but for white space at its ends is no edit.
    """
    fields = [c for c in EDITABLE if c in proposals.columns]
    held = proposals.select(F.col("id").alias("proposal_id"), F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("old_value")) for c in fields))))
    same = F.trim(F.coalesce("old_value", F.lit(""))) == F.trim(F.coalesce("new_value", F.lit("")))
    return changes.join(held, ["proposal_id", "field"]).where(~same).select("proposal_id", "field", "old_value", F.trim("new_value").alias("new_value"))


def bulk(proposals: DataFrame, chosen: DataFrame, level: int, decision: str) -> DataFrame:
    """Rows (proposal_id, before, after, applied) of one decision on many proposals; each id counts as attempted."""
    rows = chosen.select("proposal_id").join(proposals.select(F.col("id").alias("proposal_id"), F.col("status").alias("before")), "proposal_id")
    after = next_state(F.col("before"), F.lit(level), F.lit(decision))
    takes = F.col("before").isin(*(("Pending review", "Changes requested") if level == 1 else ("Pending approval",)))
    return rows.select("proposal_id", "before", after.alias("after"), takes.alias("applied"))


def history(approvals: DataFrame) -> DataFrame:
    """Approvals with ``place``: oldest first within a proposal."""
    return approvals.withColumn("place", F.row_number().over(Window.partitionBy("proposal_id").orderBy("decided_at", "id")))
