"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand for the lead pipeline's: customers are companies, orders are outreach messages, line items
their deliveries, suppliers their sources, events the job events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline import operators as op
from leadline.plans.registry import ORACLE, QUERIES, query
from leadline.sources import content_hash, table, union_tabs

@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_custkey LIMIT 50 OFFSET 10""")
def list_companies(spark: SparkSession, d: str) -> DataFrame:
    """OP-F01, J05, L01: filter, semi-join on a source, one page."""
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where(F.col("c_mktsegment").ilike("%build%")).join(seen, "c_custkey", "left_semi").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").offset(10).limit(50)


@query("""SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS companies, count(o_orderkey) AS sent, count(o_orderkey) FILTER (o_orderstatus = 'F') AS delivered, CASE WHEN count(o_orderkey) = 0 THEN 0.0 ELSE round(100.0 * count(o_orderkey) FILTER (o_orderstatus = 'F') / count(o_orderkey), 2) END AS delivery_rate FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def campaign_performance(spark: SparkSession, d: str) -> DataFrame:
    """OP-A03, A04, A08: campaigns without messages appear; rates guard against none."""
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("c_custkey").alias("companies"), F.count("o_orderkey").alias("sent"), F.count_if(F.col("o_orderstatus") == "F").alias("delivered"))
    return out.withColumn("delivery_rate", fn.rate(F.col("delivered"), F.col("sent")))


@query("""WITH t AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus <> 'P') AS b, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders), u AS (SELECT 1 AS pos, 'queued' AS stage, a AS n, a FROM t UNION ALL SELECT 2, 'sent', b, a FROM t UNION ALL SELECT 3, 'delivered', c, a FROM t) SELECT pos, stage, n, CASE WHEN a = 0 THEN 0.0 ELSE round(100.0 * n / a, 2) END AS of_top FROM u""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """OP-A06, A24: one aggregate, unpivoted in a fixed order, with the share of the top."""
    s = F.col("o_orderstatus")
    one = table(spark, d, "orders").agg(F.count("*").alias("a"), F.count_if(s != "P").alias("b"), F.count_if(s == "F").alias("c"))
    rows = one.select("a", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("stage"), F.col(c).alias("n")) for i, (n, c) in enumerate((("queued", "a"), ("sent", "b"), ("delivered", "c")), 1)])).alias("x"))
    return rows.select("x.pos", "x.stage", "x.n", fn.rate(F.col("x.n"), F.col("a")).alias("of_top"))


@query("""SELECT event_type AS source, count(*) AS runs, count(*) FILTER (value > 50) AS imported, count(DISTINCT user_id) AS users, min(ts) AS started, max(ts) AS completed, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1""")
def source_performance(spark: SparkSession, d: str) -> DataFrame:
    """OP-A07, A09, A10, W08: filtered counts, extremes and the latest row by source."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("imported"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("started"), F.max("ts").alias("completed"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 15""")
def best_contacts(spark: SparkSession, d: str) -> DataFrame:
    """OP-W01 to W04: the best 15 of each company by a rank key."""
    relevance = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return op.top_by(table(spark, d, "orders"), ["o_custkey"], [relevance.desc(), F.desc("o_totalprice"), F.col("o_orderkey")], 15).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


SIGHTINGS = """SELECT 'domain:' || lower(split_part(n_name, ' ', 1)) || '.example.com' AS key, s_suppkey AS seq, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance, 's' || (s_suppkey % 7) AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query(f"""SELECT key, arg_min(name, seq) AS name, arg_min(balance, seq) FILTER (balance IS NOT NULL) AS balance, string_agg(DISTINCT source, ',' ORDER BY source) AS source, count(*) AS sightings, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'unique' END AS dedupe_status FROM ({SIGHTINGS}) GROUP BY key""")
def merge_companies(spark: SparkSession, d: str) -> DataFrame:
    """OP-M02, S01, S04, A15, A18: sightings to companies by a normalised key, filling only what is missing."""
    url = F.concat(F.lit("https://www."), F.substring_index("n_name", " ", 1), F.lit(".example.com/team?x=1"))
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(fn.company_key(url, F.col("s_name"), F.lit(None).cast("string")).alias("key"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.concat(F.lit("s"), F.col("s_suppkey") % 7).alias("source"))
    return op.merge_by_key(rows, "key", "seq", ["name", "balance"], "source")


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'append' WHEN b.k IS NULL THEN 'delete' WHEN a.v <> b.v THEN 'update' ELSE 'skip' END AS action FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS v FROM part WHERE p_partkey % 7 <> 0) b ON a.k = b.k) GROUP BY action""")
def sheet_diff(spark: SparkSession, d: str) -> DataFrame:
    """OP-M08, J13, U05, S62: content hashes of two snapshots decide append, update, skip and delete."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    old = part.where("p_partkey % 5 <> 0").withColumn("digest", content_hash("p_name"))
    new = part.where("p_partkey % 7 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).withColumn("digest", content_hash("p_name"))
    return op.snapshot_diff(old, new, "p_partkey", "digest").groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey, (rn // 11) AS day, 540 + (rn % 11) * 48 AS minute FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM orders)""")
def schedule(spark: SparkSession, d: str) -> DataFrame:
    """OP-W09, M14, S64: the k-th message of a campaign gets the k-th slot of the daily window."""
    return op.slots(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 540, 1020, 48).drop("o_orderdate")


CHECKS = """SELECT o_orderkey AS id, o_custkey % 50 = 0 AS suppressed, o_orderkey % 41 <> 0 AS syntax_ok, o_orderkey % 37 = 0 AS disposable, o_orderkey % 31 = 0 AS role_based, CASE WHEN o_orderkey % 29 = 0 THEN 'fail' ELSE 'pass' END AS mx_status, (o_orderkey % 23) / 22.0 AS llm_score, CASE o_orderkey % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'catch_all' WHEN 3 THEN 'risk' WHEN 4 THEN 'odd' END AS mv_status FROM orders"""


@query(f"""SELECT final_status, count(*) AS n FROM (SELECT CASE WHEN suppressed THEN 'SUPPRESSED' WHEN NOT syntax_ok THEN 'INVALID_SYNTAX' WHEN disposable THEN 'DISPOSABLE_REJECTED' WHEN role_based THEN 'ROLE_BASED_REJECTED' WHEN mx_status = 'fail' THEN 'MX_FAILED' WHEN llm_score < 0.2 THEN 'LLM_LOW_CONFIDENCE' WHEN mv_status IS NULL OR mv_status = 'valid' THEN 'VERIFIED' WHEN mv_status = 'invalid' THEN 'PROVIDER_INVALID' WHEN mv_status = 'catch_all' THEN 'CATCH_ALL_REVIEW' WHEN mv_status = 'risk' THEN 'RISK_REVIEW' ELSE 'UNKNOWN_RETRY' END AS final_status FROM ({CHECKS})) GROUP BY 1""")
def validation(spark: SparkSession, d: str) -> DataFrame:
    """OP-M05, S41, A05: the first rule that holds decides; a histogram of the outcomes."""
    k = F.col("o_orderkey")
    checks = {"suppressed": F.col("o_custkey") % 50 == 0, "syntax_ok": k % 41 != 0, "disposable": k % 37 == 0, "role_based": k % 31 == 0, "mx_status": F.when(k % 29 == 0, "fail").otherwise("pass"), "llm_score": (k % 23) / 22.0, "llm_threshold": F.lit(0.2), "mv_status": F.element_at(F.array(*map(F.lit, ("valid", "invalid", "catch_all", "risk", "odd", None))), (k % 6 + 1).cast("int"))}
    return table(spark, d, "orders").select(fn.decide(checks).alias("final_status")).groupBy("final_status").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+'))) AS email FROM documents""")
def emails_on_pages(spark: SparkSession, d: str) -> DataFrame:
    """OP-S18: distinct addresses of each text."""
    found = F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:[.][a-z0-9-]+)+', 0)"))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("email"))


@query("""SELECT c_custkey, (c_custkey % 10 = 0 OR n_name IN ('FRANCE', 'GERMANY')) AS suppressed FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def suppression(spark: SparkSession, d: str) -> DataFrame:
    """OP-J07, M16: by address or by domain, without a disjunctive join."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.concat(F.lit("U"), "c_custkey", F.lit("@"), F.regexp_replace("n_name", " ", "-")).alias("email"))
    emails = rows.where("c_custkey % 10 = 0").select(F.lower("email").alias("email"))
    domains = spark.createDataFrame([("france",), ("germany",)], "domain string")
    return op.suppressed(rows, emails, domains).select("c_custkey", "suppressed")


@query("""SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS message FROM events a LEFT JOIN events b ON b.event_type = 'view' AND a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 3 DAY WHERE a.event_type = 'purchase' GROUP BY 1""")
def match_bounces(spark: SparkSession, d: str) -> DataFrame:
    """OP-J10: each bounce's newest message to the same address in the three days before."""
    e = table(spark, d, "events")
    asks = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    facts = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("sent"), F.col("event_id").alias("message"))
    return op.latest_before(asks, facts, "user_id", "ts", "sent", 3, "message").select("event_id", "message")


@query("""SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians((s_suppkey % 90)::DOUBLE - 10) / 2), 2) + cos(radians(10.0)) * cos(radians((s_suppkey % 90)::DOUBLE)) * pow(sin(radians((s_suppkey % 180)::DOUBLE - 20) / 2), 2), 1.0))), 4) AS km FROM supplier""")
def distances(spark: SparkSession, d: str) -> DataFrame:
    """OP-S58, I03: great-circle distance from a centre."""
    at = lambda n: (F.col("s_suppkey") % n).cast("double")
    return table(spark, d, "supplier").select("s_suppkey", F.round(fn.haversine_km(F.lit(10.0), F.lit(20.0), at(90), at(180)), 4).alias("km"))


@query("""SELECT 'region' AS _tab, r_regionkey::VARCHAR AS id, r_name AS name, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation""")
def export_tabs(spark: SparkSession, d: str) -> DataFrame:
    """OP-K02, U03: several tabs under one united header."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return union_tabs({"region": region, "nation": nation})


from leadline.plans import access, checks, feeds, leads, listings, mail, outreach, pages, payloads, sheets, sites, stores, tabs, web  # noqa: E402, F401  (they register their own queries)

__all__ = ["ORACLE", "QUERIES"]
