"""Queries over the driver's tables, each through an operator of the library, with their SQL.

Orders, line items and events play documents, facts and edges; each query runs on
whole tables. Scores are compared at six decimals. ``case_queries`` has those of the
texts that the tables lack: they are written from the tables' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import calendar, scores, text
from factloom.operators import corrections, events, extract, graph, linking, provenance, retrieval
from factloom.plans.registry import ORACLE_SQL, QUERIES, lines, orders, query, read, rounded
from factloom.streaming import incremental

__all__ = ["ORACLE_SQL", "QUERIES"]

# ------------------------------------------------------------ events and chronology


@query("""
WITH c AS (SELECT concat_ws('-', l_partkey, l_suppkey) AS cluster, min(CAST(l_shipdate AS DATE)) AS date, count(DISTINCT CAST(l_shipdate AS DATE)) AS dates,
  count(DISTINCT l_orderkey) AS n_docs, count(*) AS n_sources, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END) AS verified,
  string_agg(DISTINCT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d'), ',' ORDER BY strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')) AS listed FROM lineitem GROUP BY ALL)
SELECT cluster, date, n_docs, n_sources, CASE WHEN dates > 1 THEN 'disputed' WHEN n_sources > 1 AND verified > 1 THEN 'agreed' ELSE 'single_source' END AS status,
  CASE WHEN dates > 1 THEN listed END AS disputed FROM c""")
def event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a part by a supplier, told by orders."""
    facts = lines(spark, sf_dir).select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("cluster"), F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("pos"), F.lit("shipment").alias("entity"), F.lit("START").alias("role"),
        F.col("d").alias("date_parsed"), F.date_format("d", "yyyy-MM-dd").alias("value"), F.lit(None).cast("int").alias("duration_days"), F.lit(0.9).alias("confidence"),
        F.lit(True).alias("temporal_content"), (F.col("l_returnflag") != "R").alias("verified"), F.lit(None).cast("string").alias("derivation"),
    )
    listed = F.array_join(F.transform("disputed_values", lambda v: F.date_format(v["date"], "yyyy-MM-dd")), ",")
    return events.classify(facts).select("cluster", "date", "n_docs", "n_sources", "status", listed.alias("disputed"))


@query("SELECT printf('ev%03d', row_number() OVER (ORDER BY o_orderkey)) AS event_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS label FROM orders")
def chronology_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, W02."""
    return events.chronology(orders(spark, sf_dir).select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("cluster"), F.col("d").alias("date"), F.col("o_orderpriority").alias("label"))).select("event_id", "date", "label")


@query("""
WITH s AS (SELECT o_orderpriority AS grp, o_custkey AS doc_id, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY ALL)
SELECT *, CAST(max(hi) OVER (PARTITION BY grp) - min(lo) OVER (PARTITION BY grp) AS INTEGER) AS span_days FROM s""")
def earliest_latest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, A04, A25."""
    return linking.document_spans(orders(spark, sf_dir).select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("doc_id"), F.col("d").alias("date_parsed")))


@query("""
SELECT doc_id, CASE WHEN first_id <> doc_id THEN first_id END AS is_duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)""")
def duplicate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, and what repeats it."""
    own = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return extract.mark_duplicates(own, ["h"], "doc_id", "doc_id").select("doc_id", "is_duplicate_of")


@query("""
SELECT l_partkey AS from_doc, count(*) AS contradictions FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT CAST(l_shipdate AS DATE)) > 1) GROUP BY ALL""")
def date_conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with suppliers whose shipments have several dates."""
    pairs = lines(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("d").alias("n")).where("n > 1")
    links = pairs.select(F.col("l_partkey").alias("from_doc"), F.lit(0).alias("to_doc"), F.lit("contradiction").alias("link_type"))
    return retrieval.contradiction_report(links).select("from_doc", "contradictions")


@query("""
WITH a AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_suppkey = 1 GROUP BY ALL), b AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_suppkey = 2 GROUP BY ALL)
SELECT coalesce(a.l_partkey, b.l_partkey) AS event_id, a.d AS date_a, b.d AS date_b, CASE WHEN b.d IS NULL THEN 'only in A' WHEN a.d IS NULL THEN 'only in B' WHEN a.d = b.d THEN 'same' ELSE 'different' END AS verdict
FROM a FULL JOIN b USING (l_partkey)""")
def document_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, A18."""
    return retrieval.compare_documents(lines(spark, sf_dir).select(F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("doc_id"), F.col("d").alias("date")), 1, 2)


# ------------------------------------------------------------ calendar and deadlines


def _deadlines(spark: SparkSession, sf_dir: str, deadline: Column) -> DataFrame:
    own = orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), "d")
    after = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("d").alias("s")).join(own, "k").where(F.col("s") > F.col("d")).groupBy("k").agg(F.min("s").alias("action_date"))
    joined = own.withColumn("deadline", deadline).join(after, "k", "left")
    over = F.datediff("action_date", "deadline")
    return joined.select(F.col("k").alias("order_key"), "deadline", "action_date", over.alias("days_over"), F.when(over.isNull(), "INDETERMINATE").when(over <= 0, "TIMELY").otherwise("LATE").alias("verdict"))


def _deadline_sql(deadline: str) -> str:
    return f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST({deadline} AS DATE) AS deadline FROM orders),
a AS (SELECT k, min(CAST(l_shipdate AS DATE)) AS action_date FROM lineitem JOIN o ON l_orderkey = k WHERE CAST(l_shipdate AS DATE) > d GROUP BY ALL)
SELECT k AS order_key, deadline, action_date, CAST(action_date - deadline AS INTEGER) AS days_over,
  CASE WHEN action_date IS NULL THEN 'INDETERMINATE' WHEN action_date <= deadline THEN 'TIMELY' ELSE 'LATE' END AS verdict FROM o LEFT JOIN a USING (k)"""


_D = "CAST(o_orderdate AS DATE)"


@query(_deadline_sql(f"{_D} + INTERVAL 3 MONTH - INTERVAL 1 DAY"))
def deadline_months_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three months beginning with the anchor's day."""
    return _deadlines(spark, sf_dir, calendar.apply_offset(F.col("d"), 0, 3, 0, True))


@query(_deadline_sql(f"{_D} + INTERVAL 21 DAY"))
def deadline_days_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deadlines(spark, sf_dir, calendar.apply_offset(F.col("d"), 0, 0, 21))


@query(_deadline_sql(f"CASE WHEN o_orderkey % 40 < 21 THEN greatest({_D} + INTERVAL 21 DAY + (o_orderkey % 30) * INTERVAL 1 DAY, {_D} + (o_orderkey % 40 + o_orderkey % 30) * INTERVAL 1 DAY + INTERVAL 1 MONTH) ELSE {_D} + INTERVAL 21 DAY END"))
def deadline_tolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suspension that starts before the deadline adds its days, with a floor of a month after it."""
    start = F.date_add("d", (F.col("k") % 40).cast("int"))
    end = F.date_add(start, (F.col("k") % 30).cast("int"))
    return _deadlines(spark, sf_dir, calendar.tolled(F.date_add("d", 21), start, end, (0, 1, 0)))


@query(f"WITH v AS ({_deadline_sql(f'{_D} + INTERVAL 21 DAY')}) SELECT verdict, CAST(floor(days_over / 30.0) AS BIGINT) AS bucket, count(*) AS n FROM v GROUP BY ALL")
def deadline_margin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadline_days_exclusive(spark, sf_dir).groupBy("verdict", F.floor(F.col("days_over") / 30).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS order_key, min(CAST(l_shipdate AS DATE)) AS action_date, CAST(min(CAST(l_shipdate AS DATE)) - any_value({_D}) AS INTEGER) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) > {_D} GROUP BY ALL")
def first_action_after_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F06, R09."""
    own = orders(spark, sf_dir).select(F.col("o_orderkey").alias("order_key"), F.col("d").alias("anchor"))
    met = own.join(lines(spark, sf_dir).select(F.col("l_orderkey").alias("order_key"), "d"), "order_key").where(F.col("d") > F.col("anchor"))
    return met.groupBy("order_key").agg(F.min("d").alias("action_date"), F.datediff(F.min("d"), F.first("anchor")).alias("days"))


@query("SELECT p_partkey AS part_key, CAST(p_size % 4 AS INTEGER) AS years, CAST(p_size % 11 AS INTEGER) AS months, CAST(7 * (p_size % 3) + p_size AS INTEGER) AS days FROM part")
def offset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets written in words and read back."""
    size = F.col("p_size")
    written = F.format_string("%d years, %d months and %d weeks plus %d days", size % 4, size % 11, size % 3, size)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), calendar.offset_from_text(written).alias("o")).select("part_key", "o.years", "o.months", "o.days")


@query("SELECT p_partkey AS part_key, CAST(365 * (p_size % 3) + 30 * p_size + 7 * (p_size % 5) AS INTEGER) AS days FROM part")
def iso_duration_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D03, D04."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), calendar.approximate_days(F.format_string("P%dY%dM%dW", size % 3, size, size % 5)).alias("days"))


@query("SELECT o_orderkey AS order_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS lo, last_day(CAST(o_orderdate AS DATE)) AS hi FROM orders")
def partial_date_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D09, D10."""
    span = calendar.value_interval(F.date_format("d", "yyyy-MM"))
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("order_key"), span["lo"].alias("lo"), span["hi"].alias("hi"))


@query("SELECT o_orderkey % 5 AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'relative' ELSE 'none' END AS precision, count(*) AS n FROM orders GROUP BY ALL")
def precision_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D08."""
    kind = F.col("o_orderkey") % 5
    value = F.when(kind == 1, F.date_format("d", "yyyy-MM")).when(kind == 2, F.date_format("d", "yyyy")).when(kind == 3, F.lit("P3M")).when(kind == 4, F.lit("soon"))
    found = calendar.precision(F.when(kind == 0, F.col("d")), value, F.lit(None).cast("int"))
    return orders(spark, sf_dir).groupBy(kind.alias("kind"), found.alias("precision")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) AS e FROM orders),
p AS (SELECT a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT CASE WHEN s1 = s2 AND e1 = e2 THEN 'EQUALS' WHEN e1 < s2 THEN 'BEFORE' WHEN s1 > e2 THEN 'AFTER' WHEN e1 = s2 THEN 'MEETS' WHEN s1 = e2 THEN 'MET_BY'
  WHEN s1 < s2 AND e1 > s2 AND e1 < e2 THEN 'OVERLAPS' WHEN s1 > s2 AND s1 < e2 AND e1 > e2 THEN 'OVERLAPPED_BY' WHEN s1 = s2 AND e1 < e2 THEN 'STARTS' WHEN s1 = s2 AND e1 > e2 THEN 'STARTED_BY'
  WHEN s1 > s2 AND e1 < e2 THEN 'DURING' WHEN s1 < s2 AND e1 > e2 THEN 'CONTAINS' WHEN e1 = e2 AND s1 > s2 THEN 'FINISHES' WHEN e1 = e2 AND s1 < s2 THEN 'FINISHED_BY' ELSE 'UNKNOWN' END AS relation, count(*) AS n FROM p GROUP BY ALL""")
def allen_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a customer's orders."""
    own = orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.col("d").alias("s"), F.date_add("d", (F.col("o_orderkey") % 200).cast("int")).alias("e"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    return pairs.groupBy(calendar.allen(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e")).alias("relation")).agg(F.count("*").alias("n"))


_NEXT_EVENT = """SELECT user_id, event_type, event_id, CAST(ts AS DATE) AS d, lead(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events"""


def _next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.to_date("ts").alias("d"), F.lead(F.to_date("ts")).over(w).alias("e"))


@query("""
WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders),
k AS (SELECT o_custkey AS doc_id, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_orderkey % 2 AS turned FROM orders)
SELECT x.doc_id, x.id AS from_id, y.id AS to_id, CASE WHEN x.d = y.d THEN 'EQUALS' WHEN x.d < y.d THEN 'BEFORE' ELSE 'AFTER' END AS relation,
  strftime(x.d, '%Y-%m-%d') || ' ' || CASE WHEN x.d = y.d THEN 'EQUALS' WHEN x.d < y.d THEN 'BEFORE' ELSE 'AFTER' END || ' ' || strftime(y.d, '%Y-%m-%d') AS derivation
FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.id < y.id WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = x.doc_id AND k.a = x.id AND k.b = y.id)""")
def allen_point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two orders of a customer that no edge joins; an edge joins each to the next, every second one turned round."""
    facts = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("pos"), F.col("d").alias("date_parsed"))
    after = F.lead("fact_id").over(Window.partitionBy("doc_id").orderBy("fact_id"))
    step = facts.select("doc_id", "fact_id", after.alias("next")).where("next IS NOT NULL")
    turned = F.col("fact_id") % 2 == 1
    deps = step.select("doc_id", F.when(turned, F.col("next")).otherwise(F.col("fact_id")).alias("from_id"), F.when(turned, F.col("fact_id")).otherwise(F.col("next")).alias("to_id"))
    return graph.allen_edges(facts, deps)


@query(f"SELECT event_id, round(pow(0.5, (e - d) / 21.0), 6) AS proximity FROM ({_NEXT_EVENT}) WHERE e IS NOT NULL")
def temporal_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14."""
    return _next_events(spark, sf_dir).where(F.col("e").isNotNull()).select("event_id", rounded(calendar.temporal_proximity(F.col("d"), F.col("e"))).alias("proximity"))


@query("""
SELECT doc_id, start, "end", CASE WHEN start IS NULL AND "end" IS NULL THEN 'UNKNOWN' WHEN DATE '1998-06-15' < start THEN 'NO' WHEN DATE '1998-06-15' > "end" THEN 'NO' WHEN start IS NULL THEN 'YES (start unknown)' WHEN "end" IS NULL THEN 'YES (no end found)' ELSE 'YES' END AS holds
FROM (SELECT o_custkey AS doc_id, min(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END) AS start, max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS "end" FROM orders GROUP BY ALL)""")
def active_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15, A19, F12."""
    role = F.when(F.col("o_orderstatus") == "O", "START").when(F.col("o_orderstatus") == "F", "END").otherwise("UNKNOWN")
    facts = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), F.lit("An order").alias("entity"), role.alias("role"), F.col("d").alias("date_parsed"))
    return retrieval.holds_on(facts, "ORDER", "1998-06-15")


@query("""
WITH x AS (SELECT l_orderkey, l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS d, lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey) AS p FROM lineitem)
SELECT l_orderkey AS order_key, count(*) FILTER (abs(d - p) <= 5) AS matching, count(*) FILTER (abs(d - p) > 5) AS apart FROM x GROUP BY ALL""")
def values_match_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey")
    none = F.lit(None)
    pair = lines(spark, sf_dir).select("l_orderkey", "d", F.lag("d").over(w).alias("p")).withColumn("m", calendar.values_match(F.col("p"), F.col("d"), none.cast("int"), none.cast("int"), none.cast("string"), none.cast("string"))["matches"])
    return pair.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count_if("m").alias("matching"), F.count_if(~F.col("m")).alias("apart"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e,
  max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) - min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS span FROM orders)
SELECT o_orderkey AS order_key, coalesce(abs(e - d) > greatest(60.0, 0.25 * span), false) AS incompatible FROM o""")
def gap_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F08."""
    whole = Window.partitionBy("o_custkey")
    own = orders(spark, sf_dir).withColumns({"e": F.lead("d").over(whole.orderBy("o_orderdate", "o_orderkey")), "span": F.datediff(F.max("d").over(whole), F.min("d").over(whole))})
    return own.select(F.col("o_orderkey").alias("order_key"), calendar.gap_incompatible(F.col("d"), F.col("e"), F.col("span")).alias("incompatible"))


# ------------------------------------------------------------ graphs


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order is a document: fact f0 is its date, and each line number's quantity an edge to the next fact."""
    step = lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("delta_days"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    deps = step.withColumn("i", place).select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("i") - 1).alias("from_id"), F.concat(F.lit("f"), F.col("i")).alias("to_id"), F.lit("additive").alias("constraint_type"),
        F.lit("").alias("constraint_expr"), "delta_days", F.col("i").alias("dep_pos"),
    )
    first = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.lit("f0").alias("fact_id"), F.col("d").alias("date_parsed"), F.lit("START").alias("role"))
    rest = deps.select("doc_id", F.col("to_id").alias("fact_id"), F.lit(None).cast("date").alias("date_parsed"), F.lit("END").alias("role"))
    return first.unionByName(rest), deps


_CHAIN_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey AS doc_id, row_number() OVER w AS i, CAST(sum(q) OVER w AS INTEGER) AS total FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
o AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS d, o_orderpriority FROM orders)
"""


@query(_CHAIN_SQL + "SELECT doc_id, 'f0' AS fact_id, d AS date_parsed, false AS derived FROM o UNION ALL SELECT doc_id, 'f' || i, d + total, true FROM c JOIN o USING (doc_id)")
def derive_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    facts, deps = _chains(spark, sf_dir)
    return graph.derive_dates(facts, deps).select("doc_id", "fact_id", "date_parsed", F.col("derivation").isNotNull().alias("derived"))


@query(_CHAIN_SQL + "SELECT doc_id, 'f' || i AS fact_id, d + 30 + total AS \"now\", CAST(i AS INTEGER) AS hop FROM c JOIN o USING (doc_id) WHERE o_orderpriority = '1-URGENT' AND i <= 10")
def whatif_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders move by 30 days."""
    facts, deps = _chains(spark, sf_dir)
    changed = orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"), F.lit("f0").alias("fact_id"), F.date_add("d", 30).alias("date"))
    return graph.what_if(facts, deps, changed).select("doc_id", "fact_id", "now", "hop")


@query(_CHAIN_SQL + """, u AS (SELECT doc_id FROM o WHERE o_orderpriority = '1-URGENT'), n AS (SELECT o_orderkey AS doc_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM orders),
i AS (SELECT doc_id, 'f0' AS fact_id, 0 AS hop FROM u UNION ALL SELECT doc_id, 'f' || i, CAST(i AS INTEGER) FROM c JOIN u USING (doc_id)),
l AS (SELECT doc_id AS a, other AS b FROM n WHERE other IS NOT NULL UNION ALL SELECT other, doc_id FROM n WHERE other IS NOT NULL),
x AS (SELECT DISTINCT b AS doc_id, 'f1' AS fact_id, 99 AS hop FROM l JOIN i ON i.doc_id = a AND fact_id = 'f1')
SELECT doc_id, fact_id, hop FROM i WHERE hop > 0 UNION ALL SELECT * FROM x ANTI JOIN i USING (doc_id, fact_id)""")
def stale_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an urgent order makes stale, and the linked first step of the customer's neighbouring orders."""
    _, deps = _chains(spark, sf_dir)
    changed = orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"), F.lit("f0").alias("fact_id"))
    other = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = orders(spark, sf_dir).select(F.col("o_orderkey").alias("from_doc"), F.lit("f1").alias("from_fact"), other.alias("to_doc"), F.lit("f1").alias("to_fact")).where(F.col("to_doc").isNotNull())
    return graph.stale(changed, deps, links)


@query(_CHAIN_SQL + "SELECT doc_id, 'f0' AS fact_id, delta, d + delta AS new_date, count(*) AS breadth, CAST(max(i) AS INTEGER) AS depth FROM c JOIN o USING (doc_id), unnest([-365, -90, -30, 30, 90, 365]) AS t(delta) GROUP BY ALL")
def edit_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose facts are all dated; undated ones are in scenario_stops."""
    facts, deps = _chains(spark, sf_dir)
    return graph.edit_scenarios(graph.derive_dates(facts, deps), deps)


@query("""
WITH l AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS s, CAST(max(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS doc_id, CAST(s - CAST(o_orderdate AS DATE) AS INTEGER) AS actual, q AS delta_days, CAST(15 + floor(1.5 * q / 365) AS INTEGER) AS tolerance FROM orders JOIN l ON l_orderkey = o_orderkey
WHERE abs(s - CAST(o_orderdate AS DATE) - q) > 15 + floor(1.5 * q / 365)""")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09, M10."""
    per_order = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("d").alias("date_parsed"), F.max("l_quantity").cast("int").alias("delta_days"))
    facts = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.lit("o").alias("fact_id"), F.col("d").alias("date_parsed")).union(per_order.select("doc_id", F.lit("s"), "date_parsed"))
    deps = per_order.select("doc_id", F.lit("o").alias("from_id"), F.lit("s").alias("to_id"), F.lit("additive").alias("constraint_type"), "delta_days")
    return graph.inconsistencies(deps, facts).select("doc_id", "actual", "delta_days", "tolerance")


@query("SELECT 'c' || c_custkey AS key, min('c' || c_custkey) OVER (PARTITION BY n_regionkey) AS first_customer FROM customer JOIN nation ON c_nationkey = n_nationkey")
def matter_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers meet through their nations, and these through their regions."""
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    labels = events.components(customers.union(nations))
    return labels.where(F.col("key").startswith("c")).select("key", F.col("label").alias("first_customer"))


@query("""
WITH e AS (SELECT user_id, event_type || '|' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sig FROM events),
s AS (SELECT user_id, list_sort(list(DISTINCT sig)) AS s FROM e WHERE sig IS NOT NULL GROUP BY ALL), c AS (SELECT s, min(user_id) AS c, count(*) AS n FROM s GROUP BY ALL)
SELECT x.c AS a, y.c AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS similarity, CAST(CASE WHEN x.c = y.c THEN x.n * (x.n - 1) / 2 ELSE x.n * y.n END AS BIGINT) AS pairs
FROM c x JOIN c y ON x.c <= y.c WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.2 AND (x.c < y.c OR x.n > 1)""")
def structural_analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the kinds of steps between their events; pairs of classes of equal sets, with the user pairs they stand for."""
    return linking.signature_classes(_step_signatures(spark, sf_dir), 0.2)[1].select("a", "b", rounded(F.col("similarity")).alias("similarity"), "pairs")


@query("""
WITH e AS (SELECT user_id, event_type || '|' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sig FROM events),
s AS (SELECT user_id, list_sort(list(DISTINCT sig)) AS s FROM e WHERE sig IS NOT NULL GROUP BY ALL) SELECT user_id AS doc_id, min(user_id) OVER (PARTITION BY s) AS class FROM s""")
def structural_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's class."""
    return linking.signature_classes(_step_signatures(spark, sf_dir), 0.2)[0]


def _step_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.concat("event_type", F.lit("|"), after).alias("sig")).where(F.col("sig").isNotNull())


@query()
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers by traded quantity within each return flag; greedy, so tested against a loop."""
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    return linking.one_to_one(pairs, ["l_returnflag"], "l_suppkey", "l_partkey")


# ------------------------------------------------------------ provenance and text


_FLAT = "trim(regexp_replace({}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


@query(f"""
WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN substr(text, 11, 40) ELSE reverse(substr(text, 11, 40)) END AS quote FROM documents)
SELECT doc_id, CASE WHEN length({_FLAT.format('text')}) >= 12 THEN length({_FLAT.format('quote')}) >= 12 AND contains({_FLAT.format('text')}, {_FLAT.format('quote')}) END AS verified FROM q""")
def quote_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14, J10."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"))
    cut = F.substring("source_text", 11, 40)
    facts = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, cut).otherwise(F.reverse(cut)).alias("sentence"), F.lit("").alias("raw_text"))
    return provenance.check_facts(facts, docs).select("doc_id", "verified")


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN CASE doc_id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'text-only' END ELSE CASE WHEN doc_id % 3 < 2 THEN 'hash-only' ELSE 'neither' END END AS verdict, sha256(text) AS hash FROM documents")
def hash_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P04, S19."""
    own = F.sha2("text", 256)
    stated = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, F.sha2(F.lit("x"), 256))
    return read(spark, sf_dir, "documents").select("doc_id", provenance.hash_verdict(F.col("text"), stated).alias("verdict"), own.alias("hash"))


_TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_STATS = f"""
WITH t AS (SELECT lang AS grp, doc_id, {_TOKENS.format('text')} AS w FROM documents), n AS (SELECT grp, count(DISTINCT doc_id) AS n FROM t GROUP BY ALL),
df AS (SELECT grp, token, count(DISTINCT doc_id) AS df FROM (SELECT grp, doc_id, unnest(list_distinct(w)) AS token FROM t) GROUP BY ALL),
st AS (SELECT grp, token, df, n, ln((n + 1) / (df + 1)) + 1 AS idf FROM df JOIN n USING (grp))
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), "doc_id", "text")


@query(_STATS + "SELECT grp, token, df, n, round(idf, 6) AS idf, df >= n AS universal FROM st")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, M01, M04."""
    return linking.token_statistics(_texts(spark, sf_dir)).select("grp", "token", "df", "n", rounded(F.col("idf")).alias("idf"), "universal")


@query(_STATS + """, p AS (SELECT grp, doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM t),
c AS (SELECT grp, doc_id, token, count(*) AS tf, min(place) AS first FROM p GROUP BY ALL),
r AS (SELECT grp, doc_id, token, tf, idf * (1 + ln(tf)) AS score, row_number() OVER (PARTITION BY grp, doc_id ORDER BY idf * (1 + ln(tf)) DESC, first) AS rank FROM c JOIN st USING (grp, token) WHERE df < n)
SELECT grp, doc_id, token, tf, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def discriminative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02, T02."""
    own = _texts(spark, sf_dir)
    return linking.discriminative_tokens(own, linking.token_statistics(own)).withColumn("score", rounded(F.col("score")))


@query(f"""
WITH p AS (SELECT p_partkey AS k, list_distinct({_TOKENS.format("p_name || ' ' || p_type")}) AS w FROM part), m AS (SELECT count(*) AS n FROM p),
i AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM (SELECT unnest(w) AS token FROM p) GROUP BY ALL), m),
x AS (SELECT a.k, unnest(list_distinct(list_concat(a.w, b.w))) AS token, a.w AS aw, b.w AS bw FROM p a JOIN p b ON b.k = a.k + 1),
s AS (SELECT k, sum(idf) FILTER (list_contains(aw, token) AND list_contains(bw, token)) AS both_, sum(idf) AS all_, sum(idf) FILTER (list_contains(aw, token)) AS wa, sum(idf) FILTER (list_contains(bw, token)) AS wb FROM x JOIN i USING (token) GROUP BY ALL)
SELECT k AS part_key, round(coalesce(both_, 0) / all_, 6) AS jaccard, round((coalesce(both_, 0) / wa + coalesce(both_, 0) / wb) / 2, 6) AS containment FROM s""")
def weighted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts by the weight of their names' words."""
    parts = read(spark, sf_dir, "part").select(F.lit("all").alias("grp"), F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return linking.weighted_pairs(parts, parts.select("doc_id", (F.col("doc_id") + 1).alias("other"))).select(F.col("doc_id").alias("part_key"), rounded(F.col("jaccard")).alias("jaccard"), rounded(F.col("containment")).alias("containment"))


@query("""
WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> '' AND x NOT IN ('a','an','and','for','in','of','on','or','the','to'))) AS a,
  list_distinct(list_filter(string_split_regex(lower(p_type || ' ' || p_name), '\\s+'), lambda x: x <> '' AND x NOT IN ('a','an','and','for','in','of','on','or','the','to'))) AS b FROM part)
SELECT p_partkey AS part_key, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM w""")
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X04, X05."""
    overlap = text.text_overlap(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"), text.STOP_SHORT)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), rounded(overlap).alias("overlap"))


@query(f"SELECT c_custkey AS cust_key, array_to_string(list_sort(list_filter(list_distinct({_TOKENS.format(chr(39) + 'Dr. ' + chr(39) + ' || c_mktsegment || ' + chr(39) + ' and ' + chr(39) + ' || c_name || ' + chr(39) + ' Ltd' + chr(39))}), lambda t: length(t) > 1 AND t NOT IN ('dr', 'and', 'ltd') AND NOT regexp_full_match(t, '[0-9]+'))), ' ') AS party_key FROM customer")
def party_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08."""
    name = F.concat(F.lit("Dr. "), "c_mktsegment", F.lit(" and "), "c_name", F.lit(" Ltd"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key"), F.array_join(text.party_key(name), " ").alias("party_key"))


_NAMES = "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)"


@query(f"""
SELECT doc_id, regexp_matches(low, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') OR regexp_matches(low, '\\b\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2,4}}\\b') OR regexp_matches(low, '\\b\\d{{1,2}}(st|nd|rd|th)?\\s+(of\\s+)?{_NAMES}\\b')
  OR regexp_matches(low, '\\b{_NAMES}\\s+(\\d{{1,2}}|\\d{{4}})\\b') OR regexp_matches(low, '\\b(19|20)\\d\\d\\b') OR regexp_matches(low, '\\b\\d+\\s+(hour|day|week|month|year)s?\\b')
  OR regexp_matches(low, '\\b(yesterday|today|tomorrow|forthwith|immediately)\\b') AS dated FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, F22."""
    return read(spark, sf_dir, "documents").select("doc_id", text.has_date_like(F.col("text")).alias("dated"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, strftime(CAST(o_orderdate AS DATE), '%-d %B %Y') AS said, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS value FROM orders)
SELECT doc_id, value, CAST(length('The order was placed on ') AS INTEGER) AS start, 'The order was placed on ' || said || ' and ships within ' || CAST(doc_id % 90 + 1 AS VARCHAR) || ' days.' AS sentence FROM o WHERE doc_id % 2 = 1""")
def recall_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates said in text; every second document has the fact."""
    said = F.concat(F.lit("The order was placed on "), F.date_format("d", "d MMMM yyyy"), F.lit(" and ships within "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" days."))
    docs = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), said.alias("source_text"), "d")
    facts = docs.where(F.col("doc_id") % 2 == 0).select("doc_id", F.lit(None).cast("string").alias("value"), F.col("d").alias("date_parsed"))
    return retrieval.missed_dates(extract.timexes(docs), facts).select("doc_id", "value", "start", "sentence")


@query("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'START' ELSE 'END' END AS role, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS value,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Not Specified' ELSE o_orderpriority[3:3] || lower(o_orderpriority[4:]) END AS entity FROM orders""")
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of sentences written from orders."""
    name = F.initcap(F.lower(F.substring("o_orderpriority", 3, 20)))
    said = F.concat(name, F.lit(" staff work "), F.when(F.col("o_orderkey") % 2 == 0, "from ").otherwise("until "), F.date_format("d", "d MMMM yyyy"), F.lit("."))
    docs = orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), said.alias("source_text"), F.lit("letter").alias("document_type"))
    return extract.extract_facts(docs).select("doc_id", "role", "value", "entity")


@query()
def passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best sentences for a question; RE2 has no lookbehind, so tested on fixtures."""
    return retrieval.passages(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text")), "Who was called worthless, an idiot or a clown?")


@query("SELECT event_id, CAST(ts AS DATE) AS date, event_type AS label FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND event_type IN ('click', 'view')")
def context_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04, Q01."""
    own = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"), F.col("event_type").alias("label"))
    return retrieval.select_events(own, about="Click or VIEW", since="2024-01-05", until="2024-01-12")


@query("""
SELECT a.vec_id, round(CASE WHEN sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0 THEN
  list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) ELSE 0 END, 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next."""
    own = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return own.join(after, "vec_id").select("vec_id", rounded(scores.cosine(F.col("embedding"), F.col("other"))).alias("similarity"))


@query("""
WITH l AS (SELECT event_id AS pos, user_id, event_type, event_id % 4 AS k FROM events), x AS (SELECT user_id, event_type, CASE WHEN k < 2 THEN 'state' WHEN k = 2 THEN 'date' ELSE 'label' END AS class, k, pos FROM l)
SELECT user_id AS doc_id, event_type AS fact_id, class, ['accept', 'reject', 'edit_date', 'edit_label'][CAST(arg_max(k, pos) AS INTEGER) + 1] AS op, max(pos) AS pos FROM x GROUP BY ALL""")
def corrections_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a log of corrections."""
    ops = F.array(*map(F.lit, ("accept", "reject", "edit_date", "edit_label")))
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("fact_id"), F.element_at(ops, (F.col("event_id") % 4 + 1).cast("int")).alias("op"))
    return corrections.last_of_each(log).select("doc_id", "fact_id", "class", "op", "pos")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental mode's counts, over the whole table."""
    return incremental.windowed_counts(read(spark, sf_dir, "events"))


from factloom.plans import case_queries  # noqa: E402, F401
