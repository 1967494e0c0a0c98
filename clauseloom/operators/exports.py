"""Export datasets: proposed tests, week report, annexure, vocabularies, notes; no styling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T
from clauseloom.sources.storage import remove, rename

COLUMNS = 78


def _name(doc: str = "") -> Column:
    return F.coalesce(F.when(F.col(f"{doc}title") != "", F.col(f"{doc}title")), F.col(f"{doc}filename"), F.lit(""))


def _kept(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def change_cell(change: Column | str = "change_type", proposed: Column | str = "proposed_test", existing: Column | str = "existing_test") -> Column:
    """What a reviewer is asked to accept: the proposed wording, or the wording that a Deletion removes."""
    gone = F.concat(F.lit("Remove — "), F.coalesce(F.col(existing), F.lit("(test wording not recorded)")))
    return F.when(F.col(change) == "Deletion", gone).otherwise(_kept(proposed))


def note(change: str = "change_type", serial: str = "sr_no", target: str = "target_code") -> Column:
    """The comment beside a clause; a clause without a proposal is Information."""
    c = F.col(change)
    return (
        F.when(c == "New", F.concat(F.lit("New test "), F.col(serial)))
        .when(c == "Amendment", F.concat(F.lit("Covered in "), F.col(target), F.lit(" — amended")))
        .when(c == "Deletion", F.concat(F.lit("Deletion — "), F.coalesce(F.when(F.col(target) != "", F.col(target)), F.lit("affected tests")), F.lit(" withdrawn")))
        .otherwise("Information")
    )


def proposed_tests(proposals: DataFrame, documents: DataFrame, week: Column) -> DataFrame:
    """Rows (id, c01 … c78) of live changes; columns that no rule fills are empty.

    ``documents`` (document_id, title, filename, doc_date) may lack a proposal's document.
    """
    rows = proposals.join(documents, "document_id", "left")
    change = F.col("change_type")
    amended, deleted = change == "Amendment", change == "Deletion"
    given = lambda key, value: F.when(_kept(key) != "", _kept(value)).otherwise("")
    filled = {
        1: week, 2: F.col("sr_no"), 3: F.col("department"), 4: F.col("department"), 5: T.relabel("change_type", L.TEST_TYPES),
        6: F.when(amended, "Amendment in Test ").otherwise(""), 7: F.when(amended, "Approved checklist Implemented in eAudit").otherwise(""),
        9: F.col("strata"), 11: F.when(deleted, _kept("existing_test")).otherwise(_kept("proposed_test")),
        12: given("target_code", "target_code"), 13: given("target_code", "existing_test"),
        14: F.when(deleted, _kept("existing_exception")).otherwise(_kept("proposed_exception")),
        15: given("existing_exception_code", "existing_exception_code"), 16: given("existing_exception_code", "existing_exception"),
        17: T.relabel("risk", L.RISK_LABELS), 22: F.col("root_cause"), 23: F.lit("Yes"), 24: _name(), 25: _name(), 26: _kept("doc_date"), 27: _kept("doc_date"), 64: F.col("rationale"),
    }
    return rows.select("id", *(filled.get(k, F.lit("")).alias(f"c{k:02d}") for k in range(1, COLUMNS + 1)))


def week_report(documents: DataFrame, proposals: DataFrame, week: Column) -> DataFrame:
    """A row for each document, those without a proposal too: number, origin, kind, name, date, outcome.

    Numbers run over all documents by id: the counts of id ranges come first, so that no task
    numbers more than one range.
    """
    counts = proposals.groupBy("document_id").agg(F.count("*").alias("n"))
    rows = documents.join(counts, "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = F.col("n") > 0
    yes = F.when(some, "Yes").otherwise("No")
    return numbered(rows, "document_id").select(
        "number", "document_id", F.when(F.upper("filename").startswith("BPRD"), "SBP").otherwise("ABL").alias("origin"), F.when(some, "INST").otherwise("INF").alias("kind"),
        _name().alias("name"), _kept("doc_date").alias("doc_date"),
        F.when(some, F.format_string("%d test(s) proposed", "n")).otherwise("No change required").alias("outcome"), yes.alias("actionable"), week.alias("week"),
    )


def numbered(rows: DataFrame, key: str, start: int = 1, width: int = 1 << 16) -> DataFrame:
    """Add ``number``: the place by ``key`` (an integer) from ``start`` on, by ranges of ``width`` keys."""
    ranged = rows.withColumn("__range__", F.expr(f"`{key}` div {width}"))
    sizes = ranged.groupBy("__range__").agg(F.count("*").alias("__n__"))
    before = Window.orderBy("__range__").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = sizes.select("__range__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__base__"))
    nth = F.row_number().over(Window.partitionBy("__range__").orderBy(key))
    return ranged.join(base, "__range__").withColumn("number", F.col("__base__") + nth + (start - 1)).drop("__range__", "__base__")


def annexure(proposals: DataFrame) -> DataFrame:
    """A keyed row with empty definitions for each New test of the BA department."""
    new = proposals.where("change_type = 'New' and department = 'BA'")
    return new.select("id", F.col("sr_no").alias("a01"), F.col("sr_no").alias("a02"), T.relabel("change_type", L.TEST_TYPES).alias("a03"), *(F.lit("").alias(f"a{k:02d}") for k in range(4, 14)))


def vocabularies(spark: SparkSession) -> DataFrame:
    """Rows (column, name, place, value) of all vocabularies."""
    lists = F.array(*(F.struct(F.lit(k).alias("column"), F.lit(name).alias("name"), F.array(*map(F.lit, values)).alias("values")) for k, (name, values) in enumerate(L.VOCABULARIES, 1)))
    return spark.range(1).select(F.inline(lists)).select("column", "name", F.posexplode("values").alias("place", "value"))


def _digest() -> list[Column]:
    """Rows, and two sums over hashes of whole rows, whatever their order."""
    row = F.to_json(F.struct(F.col("*")), {"ignoreNullFields": "false"})
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("rows"), F.concat_ws("/", total(1), total(2)).alias("digest")]


_MANIFEST = "sheet string, columns array<string>, rows bigint, digest string"


def write_release(sheets: dict[str, DataFrame], path: str) -> str:
    """Write the sheets to a folder beside ``path`` and what was meant to be written as its manifest; returns the folder.

    Rows and digest are observed in the pass that writes a sheet, not read from its files.
    """
    spark = next(iter(sheets.values())).sparkSession
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    lines = []
    for name, df in sheets.items():
        seen = Observation()
        df.observe(seen, *_digest()).write.parquet(f"{draft}/{name}")
        lines.append((name, df.columns, seen.get["rows"], seen.get["digest"]))
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.parquet(f"{draft}/_manifest")
    return draft


def audit_release(spark: SparkSession, folder: str, expected: dict[str, list[str]]) -> list[str]:
    """What a written release lacks or has wrong, read back from its files; empty if nothing.

    ``expected`` names the columns of each sheet, which must be there in that order.  Files that
    are damaged, missing, twice there or altered show by rows and digest.
    """
    try:
        manifest = {r.sheet: r for r in spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest").collect()}
    except Exception as e:  # a manifest that cannot be read is the finding
        return [f"no manifest: {type(e).__name__}"]
    found = []
    for name, columns in expected.items():
        if name not in manifest:
            found.append(f"{name}: missing")
            continue
        held = manifest[name]
        if held.columns != columns:
            found.append(f"{name}: columns {[c for c in columns if c not in held.columns] or held.columns}")
        try:
            sheet = spark.read.parquet(f"{folder}/{name}")
            if sheet.columns != held.columns:
                found.append(f"{name}: written columns differ")
                continue
            got = sheet.agg(*_digest()).first()
        except Exception as e:  # files that cannot be read are the finding
            found.append(f"{name}: unreadable: {type(e).__name__}")
            continue
        if got.rows != held.rows:
            found.append(f"{name}: {got.rows} rows instead of {held.rows}")
        elif got.digest != held.digest:
            found.append(f"{name}: rows differ")
    return found


def publish_release(sheets: dict[str, DataFrame], path: str, expected: dict[str, list[str]] | None = None) -> list[str]:
    """Write, audit, and move to ``path`` only what passes; returns the problems.

    ``path`` names a release and is never overwritten; a draft that fails is deleted.
    """
    spark = next(iter(sheets.values())).sparkSession
    draft = write_release(sheets, path)
    found = audit_release(spark, draft, expected or {name: df.columns for name, df in sheets.items()})
    if not found and not rename(spark, draft, path):
        found = ["the release exists already"]
    if found:
        remove(spark, draft)
    return found
