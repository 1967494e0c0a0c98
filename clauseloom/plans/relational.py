"""Relational queries: joins, aggregates, windows, top-k and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import retrieve, review, segment

from .registry import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def status_histogram(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0""")
def review_grid(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = table(spark, sf, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, last_price FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def correlated_count(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"))
    return table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_price")


@query("SELECT o_orderkey, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS dearest FROM orders")
def correlated_max(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("dearest"))
    return table(spark, sf, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "dearest")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 4)")
def having_multi(spark, sf):
    talk = table(spark, sf, "conversations")
    many = talk.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 4")
    return talk.join(many, "conv_id", "left_semi").select("conv_id", "turn", "role")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def human_touched(spark, sf):
    held = table(spark, sf, "labels").where("toxic = 1 or quality = 0")
    return table(spark, sf, "documents").join(held, "doc_id", "left_semi").select("doc_id")


@query("""SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_event FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def latest_decision(spark, sf):
    rows = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_event"))


@query("""WITH d AS (SELECT DISTINCT c_mktsegment AS segment FROM customer), s AS (SELECT DISTINCT o_orderstatus AS status FROM orders),
  n AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  SELECT CASE WHEN grouping(d.segment) = 1 THEN 'TOTAL' ELSE d.segment END AS segment, CASE WHEN grouping(s.status) = 1 THEN 'TOTAL' ELSE s.status END AS status,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM d CROSS JOIN s LEFT JOIN n ON n.segment = d.segment AND n.status = s.status GROUP BY CUBE (d.segment, s.status)""")
def department_change_crosstab(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    counted = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    cells = customer.select(F.col("c_mktsegment").alias("segment")).distinct().crossJoin(F.broadcast(orders.select(F.col("o_orderstatus").alias("status")).distinct()))  # two short vocabularies
    every = cells.join(counted, ["segment", "status"], "left").cube("segment", "status").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.grouping("segment").alias("g1"), F.grouping("status").alias("g2"))
    total = lambda g, c: F.when(F.col(g) == 1, "TOTAL").otherwise(F.col(c)).alias(c)
    return every.select(total("g1", "segment"), total("g2", "status"), "n")


@query("""SELECT extract(isoyear FROM o_orderdate) AS year, extract(week FROM o_orderdate) AS week,
  printf('%d (%s - %s)', extract(week FROM o_orderdate), strftime(date_trunc('week', o_orderdate), '%d.%m.%Y'), strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%d.%m.%Y')) AS label,
  count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY ALL""")
def week_mis(spark, sf):
    day = F.col("o_orderdate")
    rows = table(spark, sf, "orders").groupBy(F.extract(F.lit("YEAROFWEEK"), day).cast("long").alias("year"), F.extract(F.lit("WEEK"), day).cast("long").alias("week"), T.week_label(day).alias("label"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("""WITH s AS (SELECT l_suppkey AS key, l_shipdate AS a, l_shipdate + INTERVAL 3 DAY AS b FROM lineitem),
  r AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  i AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY a, b) AS island FROM r),
  m AS (SELECT key, min(a) AS a, max(b) AS b FROM i GROUP BY key, island)
  SELECT key, count(*) AS islands, CAST(sum(date_diff('day', a, b)) AS BIGINT) AS covered FROM m GROUP BY key""")
def span_merge(spark, sf):
    spans = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("a"), F.date_add(F.col("l_shipdate").cast("date"), 3).alias("b"))
    merged = segment.merged_spans(spans, "key", "a", "b")
    return merged.groupBy("key").agg(F.count("*").alias("islands"), F.sum(F.datediff("end", "start").cast("long")).alias("covered"))


@query("""WITH x AS (SELECT *, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stem FROM events)
  SELECT event_id, user_id, stem AS error_ts FROM x WHERE event_type <> 'error' AND ts - stem <= INTERVAL 2 DAY""")
def asof_stem(spark, sf):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf, "events").withColumn("error_ts", F.last(F.when(F.col("event_type") == "error", F.col("ts")), ignorenulls=True).over(before))
    return rows.where("event_type <> 'error' and ts - error_ts <= interval 2 days").select("event_id", "user_id", "error_ts")


@query("SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY 1")
def upper_median(spark, sf):
    # a rank per language instead of a list: no language's lengths are gathered in one row
    counted = table(spark, sf, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    upto = F.sum("n").over(w.orderBy("n_chars"))
    rows = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where("upto > floor(all / 2)")
    return rows.groupBy("lang").agg(F.min("n_chars").alias("upper_median"))


@query("""SELECT event_id, field, value FROM (UNPIVOT (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events) ON event_type, user_id INTO NAME field VALUE value)""")
def unpivot_fields(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"))
    return rows.unpivot("event_id", ["event_type", "user_id"], "field", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_props(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.where("k > 50")


@query("""SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def weekly_tumbling(spark, sf):
    week = F.window("ts", "7 days", "7 days", "4 days")["start"]
    return table(spark, sf, "events").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
  y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def sessions(spark, sf):
    s = F.session_window("ts", "1 day")
    return table(spark, sf, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT q, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON vec_id <> q),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) SELECT q, rank, vec_id, score FROM r WHERE rank <= 8""")
def cosine_topk_embeddings(spark, sf):
    """Eight nearest vectors of a stated query set, against all rows."""
    rows = table(spark, sf, "embeddings")
    return retrieve.nearest(rows.where("vec_id % 20 = 0"), rows, 8).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS proposal_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 2 END AS level,
    CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'Approved' WHEN event_type = 'error' THEN 'Rejected' ELSE 'Changes requested' END AS decision FROM events),
  f AS (SELECT proposal_id, 0 AS k, 'Pending review' AS status, 0 AS accepted, 0 AS ignored FROM (SELECT DISTINCT proposal_id FROM e)
    UNION ALL SELECT f.proposal_id, e.k,
      CASE WHEN e.level = 1 AND status IN ('Pending review', 'Changes requested') THEN CASE decision WHEN 'Approved' THEN 'Pending approval' WHEN 'Rejected' THEN 'Rejected' ELSE 'Changes requested' END
           WHEN e.level = 2 AND status = 'Pending approval' THEN CASE decision WHEN 'Approved' THEN 'Approved' WHEN 'Rejected' THEN 'Rejected' ELSE 'Changes requested' END ELSE status END,
      accepted + CASE WHEN (e.level = 1 AND status IN ('Pending review', 'Changes requested')) OR (e.level = 2 AND status = 'Pending approval') THEN 1 ELSE 0 END,
      ignored + CASE WHEN (e.level = 1 AND status IN ('Pending review', 'Changes requested')) OR (e.level = 2 AND status = 'Pending approval') THEN 0 ELSE 1 END
    FROM f JOIN e ON e.proposal_id = f.proposal_id AND e.k = f.k + 1)
  SELECT proposal_id, arg_max(status, k) AS status, arg_max(accepted, k) AS accepted, arg_max(ignored, k) AS ignored FROM f GROUP BY 1""")
def review_state(spark, sf):
    level = F.when(F.col("event_type").isin("click", "view", "signup"), 1).otherwise(2)
    decision = F.when(F.col("event_type").isin("click", "purchase", "view"), "Approved").when(F.col("event_type") == "error", "Rejected").otherwise("Changes requested")
    events = table(spark, sf, "events").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), level.alias("level"), decision.alias("decision"))
    return review.current_status(events)


@query("""SELECT o_orderkey, batch, nth FROM (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS batch,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)""")
def mapping_batches(spark, sf):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", nth.alias("nth")).select("o_orderkey", F.floor((F.col("nth") - 1) / 8).alias("batch"), "nth")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_orderkey) AS n_orders,
  count(*) FILTER (l_tax > 0.04) AS taxed, min(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL""")
def flag_counts(spark, sf):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(revenue, 2).alias("revenue"), F.countDistinct("l_orderkey").alias("n_orders"),
        F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.min("l_shipdate").alias("first_ship"),
    )


@query("""SELECT n_name, sum(cust) AS customers, sum(supp) AS suppliers FROM (SELECT n_name, CAST(1 AS BIGINT) AS cust, CAST(0 AS BIGINT) AS supp FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, 0, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""".replace("sum(cust)", "CAST(sum(cust) AS BIGINT)").replace("sum(supp)", "CAST(sum(supp) AS BIGINT)"))
def union_sources(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    a = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", one.alias("c"), zero.alias("s"))
    b = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", zero.alias("c"), one.alias("s"))
    return a.unionByName(b).groupBy("n_name").agg(F.sum("c").alias("customers"), F.sum("s").alias("suppliers"))


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def top_parts(spark, sf):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long")
    return table(spark, sf, "part").withColumn("rank", rank).where("rank <= 3").select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS verdict FROM labels EXCEPT SELECT doc_id, 'poor' FROM labels WHERE toxic = 1")
def set_difference(spark, sf):
    labels = table(spark, sf, "labels")
    verdict = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return labels.select("doc_id", verdict.alias("verdict")).subtract(labels.where("toxic = 1").select("doc_id", F.lit("poor").alias("verdict")))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT sha256(text)) FROM documents) AS contents, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic,
  (SELECT count(*) FROM conversations WHERE role = 'user') AS user_turns, (SELECT coalesce(CAST(sum(n_chars) AS BIGINT), 0) FROM documents WHERE lang = 'xx') AS none""")
def dashboard_counts(spark, sf):
    docs = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("contents"), F.coalesce(F.sum(F.when(F.col("lang") == "xx", F.col("n_chars"))), F.lit(0)).alias("none"))
    toxic = table(spark, sf, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"))
    turns = table(spark, sf, "conversations").agg(F.count_if(F.col("role") == "user").alias("user_turns"))
    return docs.crossJoin(toxic).crossJoin(turns)  # one row each
