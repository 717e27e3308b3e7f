"""Queries: selection, evaluation, graph and trace analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.contain import containing
from ..operators.running import latest_before as latest_before_of
from ..sources.tables import load
from ..streaming import events as E
from ..streaming.deadlines import batch_deadlines
from .search import BATCH, bm25_ranked


def convergence_votes(spark, d):
    """Parts that the most distinct suppliers ship; at least two votes."""
    v = load(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("votes"))
    return v.where("votes >= 2").orderBy(F.desc("votes"), "l_partkey").select(F.col("l_partkey").alias("target"), "votes").limit(20)


def _oracle(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "key")
    items = load(spark, d, "benchmark", "item_id", "text").withColumnsRenamed({"item_id": "id", "text": "needle"})
    return containing(docs, items).withColumnsRenamed({"id": "item_id", "key": "doc_id"})


def oracle_overlap(spark, d):
    """Of each item: documents that hold it, how many of its first ten hits do, and how many are missed."""
    o, r = _oracle(spark, d), bm25_ranked(spark, d).select("item_id", "doc_id", "rank")
    j = o.join(r, ["item_id", "doc_id"], "left")
    return j.groupBy("item_id").agg(F.count(F.lit(1)).alias("oracle"), F.count("rank").alias("overlap"), F.sum(F.when(F.col("rank").isNull(), 1).otherwise(0)).cast("long").alias("missed"))


def found_at_k(spark, d):
    o, r = _oracle(spark, d), bm25_ranked(spark, d, 20).select("item_id", "doc_id", "rank")
    best = o.join(r, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").cast("long").alias("best"))
    return best.select("item_id", "best", (F.col("best") <= 5).alias("found5"), (F.col("best") <= 10).alias("found10"), (F.col("best") <= 20).alias("found20"))


def coverage_gate(spark, d):
    """Per market segment whether its customers' orders cover all priorities, some or none."""
    j = load(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey").join(load(spark, d, "orders", "o_custkey", "o_orderpriority"), F.col("c_custkey") == F.col("o_custkey"), "left")
    c = j.groupBy("c_mktsegment", "c_nationkey").agg(F.countDistinct("o_orderpriority").alias("k"))
    return c.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.when(F.col("k") == 0, "missing").when(F.col("k") >= 5, "strong").otherwise("partial").alias("status"))


def _edges(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = load(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    o = load(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return n.unionByName(c).unionByName(o)


def reach_components(spark, d):
    """Nodes that each region reaches in three hops, with their depth."""
    roots = load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return G.bounded_reach(_edges(spark, d), roots, 3).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("nodes"))


def one_hop(spark, d):
    """Customers and the distinct parts of their orders: the busiest fifty."""
    j = load(spark, d, "orders", "o_orderkey", "o_custkey").join(load(spark, d, "lineitem", "l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("parts")).orderBy(F.desc("parts"), "o_custkey").limit(50)


def unordered_pairs(spark, d):
    """Nations that trade, each pair once, with the line items between them."""
    c = load(spark, d, "customer", "c_custkey", "c_nationkey").join(load(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    j = c.join(load(spark, d, "lineitem", "l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("a <> b")


def minimal_forest(spark, d):
    """Trade edges between nations that close no cycle, heaviest first, per region."""
    n = load(spark, d, "nation", "n_nationkey", "n_regionkey")
    p = unordered_pairs(spark, d).join(n, F.col("a") == F.col("n_nationkey"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("n"), "a", "b")
    e = p.select(F.col("n_regionkey").cast("string").alias("grp"), F.row_number().over(w).alias("ord"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.minimal_forest(e)


def round_robin_select(spark, d):
    """Evidence per nation: segments take turns in offering their richest customers."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    h = load(spark, d, "customer").withColumn("ord", F.row_number().over(w)).where("ord <= 12")
    return G.round_robin(h.select(F.col("c_nationkey").cast("string").alias("grp"), F.col("c_mktsegment").alias("role"), "ord", F.col("c_custkey").alias("ref")))


def diverse_select(spark, d):
    """Four parts per brand that differ in type and container family."""
    return G.diverse(load(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("ref"), F.regexp_replace("p_type", " ", "/").alias("path"), (F.col("p_retailprice") / 1000.0).alias("score")))


def _events(spark, d):
    return load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def token_usage(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.sum("k").alias("tokens"), F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("value"))


def stage_median(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))


def stage_elapsed(spark, d):
    """Seconds since the user's previous event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _events(spark, d).select("event_id", "user_id", t.alias("t"), "ts").withColumn("p", F.lag("t").over(w)).where("p IS NOT NULL")
    return e.select("event_id", F.round((F.col("t") - F.col("p")) / 1000000.0, 3).alias("elapsed_s"))


def progress_fold(spark, d):
    """The last event of each user: last write wins."""
    best = _events(spark, d).groupBy("user_id").agg(F.max_by(F.struct("event_type", "k"), F.struct("ts", "event_id")).alias("x"))
    return best.select("user_id", "x.event_type", "x.k")


def latest_before(spark, d):
    """For each order the customer's latest earlier one: an as-of lookup by a window."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("previous", F.lag("o_orderkey").over(w))
    return o.where("previous IS NOT NULL").select("o_orderkey", "previous")


def interval_merge(spark, d):
    """Overlapping two-hour windows around each user's events, merged."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = _events(spark, d).select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = t.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= 7200 * 1000000, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return g.groupBy("user_id", "g").agg((F.min("t") - 3600 * 1000000).alias("start_us"), (F.max("t") + 3600 * 1000000).alias("end_us"), F.count(F.lit(1)).alias("n")).drop("g")


def containment_sweep(spark, d):
    """Orders' line spans of quantities that no earlier span of the order contains."""
    s = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("a"), (F.col("l_linenumber") + F.col("l_quantity")).alias("b"))
    w = Window.partitionBy("l_orderkey").orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("m", F.coalesce(F.max("b").over(w), F.lit(-1.0))).where("b > m").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def union_last_wins(spark, d):
    """Two candidate lists by source: the later list's score wins, the earlier list's place stays."""
    docs = load(spark, d, "documents", "source", "doc_id", "n_chars")
    one = docs.groupBy("source").agg(F.min("doc_id").alias("ord"), F.max("n_chars").alias("score")).withColumn("list", F.lit(1))
    two = docs.where("lang = 'en'").groupBy("source").agg(F.max("doc_id").alias("ord"), F.min("n_chars").alias("score")).withColumn("list", F.lit(2))
    return one.unionByName(two).groupBy("source").agg(F.min_by("ord", "list").alias("ord"), F.max_by("score", "list").alias("score"))


def set_comparison(spark, d):
    """Customers that ordered and suppliers' nations: in both, only in one."""
    a = load(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).withColumn("b", F.lit(1))
    j = a.join(b, "k", "full")
    return j.groupBy(F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both").alias("part")).agg(F.count(F.lit(1)).alias("n"))


def batch_summary(spark, d):
    """Orders by status: how many, how many urgent, and the mean price."""
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


def record_fields(spark, d):
    """First usable scalar of an event's JSON, and maps merged with the later winning."""
    k = F.get_json_object("props", "$.k")
    return load(spark, d, "events", "event_id", "props", "event_type").select("event_id", F.coalesce(F.nullif(F.trim(F.get_json_object("props", "$.title")), F.lit("")), k, F.col("event_type")).alias("label"))


def sessions_stream(spark, d):
    """Sessions of the event log; the streaming form of the same function gives the same rows."""
    s = E.sessions(load(spark, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


QUERIES = {f.__name__: f for f in (convergence_votes, oracle_overlap, found_at_k, coverage_gate, reach_components, one_hop, unordered_pairs, minimal_forest, round_robin_select, diverse_select, token_usage, stage_median, stage_elapsed, progress_fold, latest_before, interval_merge, containment_sweep, union_last_wins, set_comparison, batch_summary, record_fields, sessions_stream)}
_O = "o AS (SELECT item_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, trim(b.text)))"
_GAPS = """
SELECT user_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g
  FROM (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) {} THEN 0 ELSE 1 END AS n
  FROM events)"""
ORACLES = {
    "convergence_votes": "SELECT l_partkey AS target, count(DISTINCT l_suppkey) AS votes FROM lineitem GROUP BY l_partkey HAVING votes >= 2 ORDER BY votes DESC, target LIMIT 20",
    "oracle_overlap": f"""
{BATCH}, {_O} SELECT item_id, count(*) AS oracle, count(rank) AS overlap, CAST(sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missed
  FROM o
  LEFT JOIN (SELECT query, doc_id, rank
  FROM r
  WHERE rank <= 10) AS h ON o.item_id = h.query AND o.doc_id = h.doc_id
  GROUP BY item_id""",
    "found_at_k": f"""
{BATCH}, {_O} SELECT item_id, min(rank) AS best, min(rank) <= 5 AS found5, min(rank) <= 10 AS found10, min(rank) <= 20 AS found20
  FROM o JOIN r ON o.item_id = r.query AND o.doc_id = r.doc_id
  WHERE rank <= 20
  GROUP BY item_id""",
    "coverage_gate": """
SELECT c_mktsegment AS segment, c_nationkey AS nation, CASE WHEN count(DISTINCT o_orderpriority) = 0 THEN 'missing' WHEN count(DISTINCT o_orderpriority) >= 5 THEN 'strong' ELSE 'partial' END AS status
  FROM customer
  LEFT JOIN orders ON c_custkey = o_custkey
  GROUP BY ALL""",
    "reach_components": """
SELECT root, depth, count(*) AS nodes
  FROM (SELECT 'r' || r_regionkey AS root, 0 AS depth
  FROM region
  UNION ALL SELECT 'r' || n_regionkey, 1
  FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 2
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'r' || n_regionkey, 3
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
  GROUP BY ALL""",
    "one_hop": "SELECT o_custkey, count(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey ORDER BY parts DESC, o_custkey LIMIT 50",
    "unordered_pairs": """
SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey
  GROUP BY ALL""",
    "token_usage": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS requests, round(sum(value), 4) AS value FROM events GROUP BY event_type",
    "stage_median": "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type",
    "stage_elapsed": """
SELECT event_id, round((epoch_us(ts) - p) / 1000000e0, 3) AS elapsed_s
  FROM (SELECT event_id, ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM events)
  WHERE p IS NOT NULL""",
    "progress_fold": """
SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events)
  WHERE r = 1""",
    "latest_before": "SELECT o_orderkey, previous FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE previous IS NOT NULL",
    "interval_merge": f"SELECT user_id, min(t) - 3600000000 AS start_us, max(t) + 3600000000 AS end_us, count(*) AS n FROM ({_GAPS.format('<= 7200000000')}) GROUP BY user_id, g",
    "containment_sweep": """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
  FROM (SELECT *, coalesce(max(l_linenumber + l_quantity) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_linenumber + l_quantity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS m
  FROM lineitem)
  WHERE l_linenumber + l_quantity > m""",
    "union_last_wins": """
WITH u AS (SELECT source, min(doc_id) AS ord, max(n_chars) AS score, 1 AS l
  FROM documents
  GROUP BY source
  UNION ALL SELECT source, max(doc_id), min(n_chars), 2
  FROM documents
  WHERE lang = 'en'
  GROUP BY source) SELECT source, arg_min(ord, l) AS ord, arg_max(score, l) AS score
  FROM u
  GROUP BY source""",
    "set_comparison": """
SELECT CASE WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' ELSE 'both' END AS part, count(*) AS n
  FROM (SELECT DISTINCT o_custkey AS k, 1 AS a
  FROM orders) FULL JOIN (SELECT c_custkey AS k, 1 AS b
  FROM customer
  WHERE c_acctbal > 0) USING (k)
  GROUP BY part""",
    "batch_summary": "SELECT o_orderstatus, count(*) AS n, count_if(o_orderpriority = '1-URGENT') AS urgent, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY o_orderstatus",
    "record_fields": "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.title')), ''), json_extract_string(props, '$.k'), event_type) AS label FROM events",
    "sessions_stream": f"SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM ({_GAPS.format('< 1800000000')}) GROUP BY user_id, g",
}


def order_events(spark, d):
    """What each order's customer last did before its date (users are customers by number, dates fall into the events' weeks), else what that user did first."""
    orders = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).cast("long").alias("user_id"), F.expr("timestamp'2023-12-28 00:00:00' + make_dt_interval(datediff(o_orderdate, date'1995-01-01') % 40)").alias("ts"))
    events = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", F.lpad("event_id", 12, "0"), "event_type").alias("event"))
    return latest_before_of(orders, events, "user_id", "ts", "event").select("o_orderkey", "event", "found")


QUERIES["order_events"] = order_events
ORACLES["order_events"] = """
WITH o AS (
  SELECT o_orderkey, CAST(o_custkey % 200 AS BIGINT) AS user_id, TIMESTAMP '2023-12-28' + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 40 AS INT)) AS ts FROM orders
), e AS (
  SELECT user_id, ts, max(lpad(CAST(event_id AS VARCHAR), 12, '0') || ' ' || event_type) AS event FROM events GROUP BY ALL
), f AS (
  SELECT user_id, arg_min(event, ts) AS head FROM e GROUP BY user_id
)
SELECT o.o_orderkey, coalesce(e.event, f.head) AS event, CASE WHEN e.event IS NOT NULL THEN 'before' WHEN f.head IS NOT NULL THEN 'first' ELSE 'none' END AS found
FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.ts >= e.ts LEFT JOIN f ON f.user_id = o.user_id"""


def source_deadlines(spark, d):
    """Users of a day as sources with six hours: results in time and whether a purchase finished them; the streaming form of the
    same rows is :func:`..streaming.deadlines.with_deadlines`."""
    e = load(spark, d, "events", "user_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    s = batch_deadlines(e, "purchase", 360)
    return s.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("deadline").alias("deadline_us"), "results", F.unix_micros("last").alias("last_us"), "status")


QUERIES["source_deadlines"] = source_deadlines
ORACLES["source_deadlines"] = """
WITH b AS (
  SELECT *, min(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS started FROM events
)
SELECT user_id, epoch_us(started) AS started_us, epoch_us(started + INTERVAL 6 HOURS) AS deadline_us, count(*) AS results, epoch_us(max(ts)) AS last_us,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'complete' ELSE 'failed' END AS status
FROM b WHERE ts <= started + INTERVAL 6 HOURS AND started + INTERVAL 6 HOURS < (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id, started"""


def _diverse_sql(take: int) -> str:
    """The picks one after another, each against those before it."""
    steps = ["c AS (SELECT p_brand AS grp, p_partkey AS ref, replace(p_type, ' ', '/') AS path, p_retailprice / 1000e0 AS score FROM part)"]
    for k in range(1, take + 1):
        less = "".join(f" - CASE WHEN p{j}.path = c.path THEN 2.5e0 ELSE 0e0 END - CASE WHEN split_part(p{j}.path, '/', 1) = split_part(c.path, '/', 1) THEN 0.7e0 ELSE 0e0 END" for j in range(1, k))
        joins = "".join(f" JOIN p{j} ON p{j}.grp = c.grp" for j in range(1, k))
        apart = "".join(f" AND c.ref <> p{j}.ref" for j in range(1, k))
        steps.append(f"p{k} AS (SELECT c.grp, c.ref, c.path, {k} AS rank FROM c{joins} WHERE true{apart} QUALIFY row_number() OVER (PARTITION BY c.grp ORDER BY round(c.score{less}, 6) DESC, c.score DESC, c.ref) = 1)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT grp, rank, ref FROM p{k}" for k in range(1, take + 1))


ORACLES["diverse_select"] = _diverse_sql(4)
