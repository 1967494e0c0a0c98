"""Intake, retrieval and decision queries over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import lexicon as L
from clauseloom.functions import text as T
from clauseloom.operators import decide, index, intake, retrieve, segment
from clauseloom.sources import readers, storage

from .registry import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))"
def _terms(lib, lib_id):
    return f"""tt AS (SELECT {lib_id} AS id, term, count(*) AS tf FROM (SELECT {lib_id}, unnest({_TOKENS}) AS term FROM {lib}) GROUP BY ALL),
  nn AS (SELECT count(*) AS n FROM {lib}),
  vocab AS (SELECT term, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tt GROUP BY 1 ORDER BY df DESC, term LIMIT {L.VOCABULARY}), nn)"""


def scores_sql(lib="benchmark", lib_id="item_id", ask="documents", ask_id="doc_id"):
    return f"""{_terms(lib, lib_id)},
  dt AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tt JOIN vocab USING (term)), dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dt GROUP BY 1),
  dense AS (SELECT id, term, w / norm AS wd FROM dt JOIN dn USING (id)),
  i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tt, nn GROUP BY term, n),
  i1 AS (SELECT term, CASE WHEN idf < 0 THEN {L.BM25_FLOOR} * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
  dl AS (SELECT id, sum(tf) AS dl FROM tt GROUP BY 1), av AS (SELECT sum(dl) / max(n) AS avgdl FROM dl, nn),
  sparse AS (SELECT tt.id, term, i1.idf * tf * {L.BM25_K1 + 1} / (tf + {L.BM25_K1} * (1 - {L.BM25_B} + {L.BM25_B} * dl / avgdl)) AS ws FROM tt JOIN i1 USING (term) JOIN dl ON dl.id = tt.id, av),
  qt AS (SELECT {ask_id} AS q, term, count(*) AS tf FROM (SELECT {ask_id}, unnest({_TOKENS}) AS term FROM {ask} WHERE trim(text) <> '') GROUP BY ALL),
  qw AS (SELECT q, term, tf, (1 + ln(tf)) * coalesce(idf, 0) AS w FROM qt LEFT JOIN vocab USING (term)), qn AS (SELECT q, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
  met AS (SELECT qw.q, s.id AS test, sum(qw.w * coalesce(wd, 0)) AS dot, sum(qw.tf * ws) AS sparse FROM qw JOIN sparse s ON s.term = qw.term LEFT JOIN dense d ON d.id = s.id AND d.term = s.term GROUP BY 1, 2),
  found AS (SELECT q, test, CASE WHEN norm > 0 THEN dot / norm ELSE 0 END AS dense, sparse FROM met JOIN qn USING (q)),
  every AS (SELECT {ask_id} AS q, {lib_id} AS test, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse FROM (SELECT {ask_id} FROM {ask} WHERE trim(text) <> '') CROSS JOIN (SELECT {lib_id} FROM {lib}) LEFT JOIN found ON q = {ask_id} AND test = {lib_id}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dense, 9) DESC, test DESC) - 1 AS r1, row_number() OVER (PARTITION BY q ORDER BY round(sparse, 9) DESC, test DESC) - 1 AS r2 FROM every),
  fused AS (SELECT *, 1 / ({L.FUSION} + r1) + 1 / ({L.FUSION} + r2) AS fused FROM ranked),
  top AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(fused, 12) DESC, test) AS rank, test, round(dense, 3) AS dense, round(sparse, 3) AS sparse, round(fused, 5) AS fused FROM fused)"""


_TERMS, _SCORES = _terms("benchmark", "item_id"), scores_sql()


def _search(spark, sf, most=None):
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieve.search(asked, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), most=most)


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, sf):
    items = table(spark, sf, "benchmark")
    counts = retrieve.term_counts(items, "item_id", "text")
    return retrieve.vocabulary(counts, items.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_SCORES} SELECT q, rank, test, dense, sparse, fused FROM top WHERE rank <= {L.TOP_K}")
def rrf_topk(spark, sf):
    return _search(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {scores_sql('documents', 'doc_id', 'benchmark', 'item_id')} SELECT q, rank, test, dense, sparse, fused FROM top WHERE rank <= {L.TOP_K}")
def rrf_topk_large_library(spark, sf):
    """The other way round: every benchmark item against all documents, a library beyond the vocabulary's size."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    found = retrieve.search(items.select(F.col("item_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), "text"))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SCORES} SELECT q, rank, test, dense, sparse, fused FROM top WHERE rank <= {L.TOP_K}")
def stored_index_topk(spark, sf):
    """Every document against the stored index of the benchmark, which is built where it is missing or out of date."""
    library = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    held = index.load(library, f"{storage.shared_folder(spark)}/library-index")
    found = index.search(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), held)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_SCORES}, best AS (SELECT q, arg_max(struct_pack(test := test, dense := dense), dense - rank * 1e-9) AS b FROM top WHERE rank <= {L.TOP_K} GROUP BY 1),
  d AS (SELECT q, b.test AS test, b.dense AS dense, CASE WHEN b.dense >= {L.AMEND_AT} THEN 'Amendment' WHEN b.dense >= {L.NEW_AT} THEN 'New' ELSE 'No action' END AS change_type FROM best)
  SELECT q, test, dense, change_type, CASE change_type WHEN 'Amendment' THEN round(least(0.92, 0.45 + dense * 0.6), 2) WHEN 'New' THEN 0.66 ELSE 0.60 END AS confidence FROM d""")
def decision_ladder(spark, sf, most=None):
    """Every document against the whole library: fused top 8, best cosine, change type."""
    best = decide.best_by_cosine(_search(spark, sf, most))
    change = decide.ladder(F.col("dense"), F.lit(False))
    return best.withColumn("change_type", change).withColumn("confidence", decide.ladder_confidence(F.col("change_type"), F.col("dense")))


@query("""SELECT doc_id, sha256(text) AS file_hash, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)""")
def dedupe_by_hash(spark, sf):
    return intake.first_copies(table(spark, sf, "documents")).select("doc_id", "file_hash", "duplicate_of")


@query("""WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1)
  SELECT d.doc_id, d.source, o.doc_id AS original, o.source AS original_source FROM documents d JOIN f ON f.h = sha256(d.text) JOIN documents o ON o.doc_id = f.first WHERE d.doc_id <> f.first""")
def duplicate_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    copies = intake.first_copies(docs).where("duplicate_of is not null").select("doc_id", "source", F.col("duplicate_of").alias("original"))
    return copies.join(docs.select(F.col("doc_id").alias("original"), F.col("source").alias("original_source")), "original").select("doc_id", "source", "original", "original_source")


@query("""WITH f AS (SELECT *, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)
  SELECT CASE WHEN trim(text) = '' THEN 'error' WHEN first <> doc_id THEN 'duplicate' ELSE 'ingested' END AS outcome, lang, count(*) AS n FROM f GROUP BY ALL""")
def intake_outcome_counts(spark, sf):
    return intake.outcomes(table(spark, sf, "documents")).groupBy("outcome", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, lag(doc_id) OVER w AS supersedes, lead(doc_id) OVER w AS superseded_by FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)")
def reissue_chain(spark, sf):
    named = table(spark, sf, "documents").select("doc_id", "source", F.concat_ws("/", "source", "lang").alias("filename"))
    return intake.reissues(named).select("doc_id", "source", "supersedes", "superseded_by")


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  SELECT doc_id, pos, length(line) AS size, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM x""")
def line_offsets(spark, sf):
    rows = segment.lines(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("size"), "at")


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, string_split(line, ' | ') AS cells FROM x WHERE line LIKE '% | %')
  SELECT doc_id, len(cells) AS cells, len(list_filter(cells, lambda c: len(string_split_regex(trim(c), '\\s+')) > 1)) AS wordy, count(*) AS n FROM p GROUP BY ALL""")
def piped_rows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains(" | "))
    cells = F.split("line", r" \| ", -1)
    wordy = F.size(F.filter(cells, lambda c: F.size(F.split(F.trim(c), r"\s+")) > 1))
    return rows.select("doc_id", F.size(cells).cast("long").alias("cells"), wordy.cast("long").alias("wordy")).groupBy("doc_id", "cells", "wordy").agg(F.count("*").alias("n"))


_CUES = {"informational": "(?i)^licensed under|copyright", "supersession": "(?i)reound|withdrawn", "obligation": "(?i)ention"}


@query("""WITH x AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
  k AS (SELECT doc_id, CASE WHEN regexp_matches(substring(line, 1, 160), '(?i)^licensed under|copyright') THEN 'information' WHEN regexp_matches(line, '(?i)reound|withdrawn') THEN 'supersession'
    WHEN regexp_matches(line, '(?i)ention') THEN 'obligation' ELSE 'none' END AS verdict FROM x) SELECT verdict, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1""")
def classify_lexicon(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    verdict = T.classify("line", **_CUES)
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'tionnd') THEN 'one' WHEN regexp_matches(lower(text), 'ement') THEN 'two' WHEN regexp_matches(lower(text), 'keit') THEN 'three' ELSE 'other' END AS subject FROM documents""")
def strata_first_match(spark, sf):
    hints = (("one", "tionnd"), ("two", "ement"), ("three", "keit"))
    return table(spark, sf, "documents").select("doc_id", T.strata("text", hints, "other").alias("subject"))


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)apache|gnu')")
def text_search(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike("(?i)apache|gnu")).select("doc_id", "lang")


@query()
def clause_split(spark, sf):
    """Clauses of all documents, with offsets into the cleaned text."""
    found, _ = segment.clauses(table(spark, sf, "documents"))
    return found.select("doc_id", "sequence", "clause_ref", F.length("text").alias("size"), "char_start", "char_end", "rung", "verdict")


@query()
def split_quality(spark, sf):
    docs = table(spark, sf, "documents")
    found, _ = segment.clauses(docs)
    return segment.split_warnings(docs, found)


@query()
def html_lines(spark, sf):
    return readers.page_lines(table(spark, sf, "pages")).select("page_id", F.explode(F.split("text", "\n")).alias("line"))
