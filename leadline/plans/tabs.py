"""Queries on sources, sites, listings, tabs and the state of contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline import operators as op
from leadline.functions import web
from leadline.model import frame, sql
from leadline.plans.outreach import MESSAGES, messages
from leadline.plans.registry import query
from leadline.plans.web import pick, sql_list, sql_pick
from leadline.sources import content_hash, table

SOCIAL = ("https://www.LinkedIn.com/company/acme", "http://linkedin.com/in/bo", "https://facebook.com/acme", "https://facebook.com/sharer/x", "facebook.com/", "https://acme.org/facebook")


@query(f"""SELECT page_id, ['linkedin', 'linkedin_person', 'facebook', NULL, NULL, NULL][(page_id % 6) + 1] AS kind FROM pages""")
def social_links(spark: SparkSession, d: str) -> DataFrame:
    """OP-S14: links by network."""
    return table(spark, d, "pages").select("page_id", web.social_kind(pick(SOCIAL, "page_id")).alias("kind"))


VISIBLE = r"length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))"


@query(f"""SELECT page_id, {VISIBLE} AS n, {VISIBLE} < 400 OR ({VISIBLE} < 1200 AND regexp_matches(lower(html), '{"|".join(web.SPA_MARKERS)}')) AS browser FROM pages""")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    """OP-S35: visible characters of a page and whether it needs a browser."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", web.visible_length(h).alias("n"), web.needs_browser(h).alias("browser"))


@query(f"""SELECT n_nationkey AS source, {sql_pick(('green', 'amber', 'red'), 'n_nationkey')} AS posture, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'not_enabled' WHEN n_nationkey % 5 = 0 THEN 'not_signed_off' WHEN n_nationkey % 7 = 0 THEN 'flag_off' END AS reason, CASE WHEN n_nationkey % 3 <> 0 AND (n_nationkey % 2 = 0 OR n_nationkey % 5 = 0 OR n_nationkey % 7 = 0) THEN 'skipped' ELSE 'run' END AS status FROM nation""")
def source_gates(spark: SparkSession, d: str) -> DataFrame:
    """OP-I25, M25: sources that may run, and the others as skipped runs with the reason."""
    k, posture = F.col("n_nationkey"), pick(("green", "amber", "red"), "n_nationkey")
    reason = web.gate(posture, k % 2 != 0, k % 5 != 0, k % 7 != 0)
    return table(spark, d, "nation").select(k.alias("source"), posture.alias("posture"), reason.alias("reason"), F.when(reason.isNull(), "run").otherwise("skipped").alias("status"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'not_needed' WHEN s_suppkey IS NULL THEN 'no_result' WHEN s_acctbal < 0 THEN 'pending' ELSE 'enriched' END AS state, CASE WHEN c_custkey % 4 <> 0 AND s_acctbal >= 0 THEN greatest(0.3, round(s_acctbal / 10000, 3)) ELSE 0.3 END AS confidence FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3""")
def enrichment_state(spark: SparkSession, d: str) -> DataFrame:
    """OP-M06: what captured lookups did for contacts without an address; the higher confidence stays."""
    found = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"), "s_acctbal")
    needed, hit = F.col("c_custkey") % 4 != 0, F.col("s_acctbal")
    rows = table(spark, d, "customer").join(found, F.col("c_custkey") == F.col("k"), "left")
    state = F.when(~needed, "not_needed").when(F.col("k").isNull(), "no_result").when(hit < 0, "pending").otherwise("enriched")
    return rows.select(F.col("c_custkey").alias("id"), state.alias("state"), F.when(needed & (hit >= 0), F.greatest(F.lit(0.3), fn.rounded(hit / 10000, 3))).otherwise(F.lit(0.3)).alias("confidence"))


@query("""SELECT l_orderkey AS site, l_returnflag AS contact, max(l_discount) AS confidence, arg_max(l_partkey, (l_discount, -l_linenumber, l_partkey)) AS page, arg_min(l_shipdate, (l_linenumber, l_shipdate)) FILTER (l_linenumber % 2 = 0) AS filled FROM lineitem GROUP BY 1, 2""")
def extraction_merge(spark: SparkSession, d: str) -> DataFrame:
    """OP-M09: contacts of a site's pages: the surest sighting gives the page, others fill what is missing."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("site"), F.col("l_returnflag").alias("contact")).agg(F.max("l_discount").alias("confidence"), F.max_by("l_partkey", F.struct("l_discount", -F.col("l_linenumber"), "l_partkey")).alias("page"), F.min_by("l_shipdate", F.when(F.col("l_linenumber") % 2 == 0, F.struct("l_linenumber", "l_shipdate"))).alias("filled"))


@query("""SELECT l_orderkey, l_linestatus, title, min(l_linenumber) AS first FROM (SELECT l_orderkey, l_linestatus, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS title FROM lineitem) GROUP BY 1, 2, 3""")
def signals_once(spark: SparkSession, d: str) -> DataFrame:
    """OP-M11, M12, Q17: signals by company, source and title, an absent title being one like any other."""
    title = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("title")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus", title).agg(F.min("l_linenumber").alias("first"))


@query("""SELECT s_suppkey, round(lat - degrees(r / 6371.0), 6) AS south, round(lng + degrees(r / (6371.0 * cos(radians(lat)))), 6) AS east FROM (SELECT s_suppkey, (s_suppkey % 60)::DOUBLE AS lat, (s_suppkey % 170)::DOUBLE AS lng, greatest(0.1, least(100.0, (s_suppkey % 150)::DOUBLE)) AS r FROM supplier)""")
def boxes(spark: SparkSession, d: str) -> DataFrame:
    """OP-S60: rectangles around search circles."""
    at = lambda n: (F.col("s_suppkey") % n).cast("double")
    b = web.box(at(60), at(170), at(150))
    return table(spark, d, "supplier").select("s_suppkey", F.round(b["south"], 6).alias("south"), F.round(b["east"], 6).alias("east"))


@query(sql("""SELECT validation_id FROM checks WHERE final_status = 'UNKNOWN_RETRY' AND retry_count < 3 AND verified_at <= TIMESTAMP '1997-01-01' - INTERVAL 6 HOUR ORDER BY verified_at, validation_id LIMIT 200"""))
def retry_batch(spark: SparkSession, d: str) -> DataFrame:
    """OP-M21, L02: the oldest 200 checks that are old enough and have tries left (the bound is the feature)."""
    old = F.col("verified_at") <= F.expr("timestamp_ntz '1997-01-01 00:00:00' - interval 6 hours")
    return frame(spark, d, "checks").where((F.col("final_status") == "UNKNOWN_RETRY") & old & (F.col("retry_count") < 3)).orderBy("verified_at", "validation_id").limit(200).select("validation_id")


@query(f"""SELECT id::VARCHAR AS "Message ID", coalesce(campaign, '') AS "Campaign", strftime(sent_at, '%Y-%m-%dT%H:%M:%S') AS "Sent At", CASE WHEN status IN ('bounced', 'blocked') THEN 'bounced' ELSE '' END AS "Bounce Status", sha256('{{"id":' || id || ',"status":"' || status || '"}}') AS row_hash FROM ({MESSAGES})""")
def outreach_tab(spark: SparkSession, d: str) -> DataFrame:
    """OP-P01 to P03, P09, S62: a tab of strings with headers, blanks for nulls, ISO times, and the hash of a row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss")
    return messages(spark, d).select(text("id").alias("Message ID"), text("campaign").alias("Campaign"), F.coalesce(when, F.lit("")).alias("Sent At"), F.when(F.col("status").isin("bounced", "blocked"), "bounced").otherwise("").alias("Bounce Status"), content_hash("id", "status").alias("row_hash"))


@query("""SELECT event_id, coalesce(c_name, '') AS who, event_type FROM events LEFT JOIN customer ON user_id = c_custkey WHERE contains(lower(event_type), 'c') ORDER BY ts DESC, event_id LIMIT 100""")
def audit_list(spark: SparkSession, d: str) -> DataFrame:
    """OP-F04, J04, L01: the newest entries that match, with the name of who did it."""
    rows = table(spark, d, "events").where(F.lower("event_type").contains("c"))
    rows = rows.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    return rows.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", F.coalesce("c_name", F.lit("")).alias("who"), "event_type")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN coalesce(latest, 'verified') ELSE 'suppressed' END AS status FROM customer LEFT JOIN (SELECT contact, arg_max(status, (sent_at, id)) AS latest FROM ({MESSAGES}) GROUP BY 1) ON c_custkey = contact""")
def suppression_reset(spark: SparkSession, d: str) -> DataFrame:
    """OP-M29: contacts go back to the state of their latest check."""
    latest = messages(spark, d).groupBy("contact").agg(F.max_by("status", F.struct("sent_at", "id")).alias("latest"))
    rows = table(spark, d, "customer").join(latest, F.col("c_custkey") == F.col("contact"), "left")
    return rows.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.coalesce("latest", F.lit("verified"))).otherwise("suppressed").alias("status"))


@query(f"""SELECT id, CASE WHEN up <= 3 THEN 'replied' WHEN up <= 50 THEN 'opened' WHEN down <= 5 THEN 'bounced' ELSE 'delivered' END AS outcome FROM (SELECT id, row_number() OVER (PARTITION BY campaign ORDER BY price DESC, id) AS up, row_number() OVER (PARTITION BY campaign ORDER BY price, id DESC) AS down FROM ({MESSAGES}))""")
def ranked_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The dearest of a campaign and the cheapest: only the first fifty and the last five of each are ranked (a limit that Spark takes before the shuffle), the rest joins them."""
    rows = messages(spark, d).select("id", "campaign", "price")
    up = op.top_by(rows, ["campaign"], [F.desc("price"), F.col("id")], 50).select("id", F.col("rank").alias("up"))
    down = op.top_by(rows, ["campaign"], [F.col("price"), F.desc("id")], 5).select("id", F.col("rank").alias("down"))
    named = F.when(F.col("up") <= 3, "replied").when(F.col("up").isNotNull(), "opened").when(F.col("down").isNotNull(), "bounced").otherwise("delivered")
    return rows.select("id").join(up, "id", "left").join(down, "id", "left").select("id", named.alias("outcome"))


@query(f"""SELECT CASE WHEN status IN ({sql_list(('delivered', 'opened', 'clicked', 'replied'))}) THEN 'verified' WHEN status IN ('bounced', 'blocked') THEN 'invalid' WHEN status IN ('sent', 'unsubscribed') THEN 'review' END AS bucket, count(*) AS n FROM ({MESSAGES}) GROUP BY 1""")
def status_buckets(spark: SparkSession, d: str) -> DataFrame:
    """OP-A02: three buckets of states; a state in none has none."""
    s = F.col("status")
    bucket = F.when(s.isin("delivered", "opened", "clicked", "replied"), "verified").when(s.isin("bounced", "blocked"), "invalid").when(s.isin("sent", "unsubscribed"), "review")
    return messages(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 10 = 0 THEN 'curated' END, p_name) AS p_name, p_size FROM part""")
def patched_companies(spark: SparkSession, d: str) -> DataFrame:
    """OP-M26: curated fields over the mined ones."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    patch = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit("curated").alias("new_name"))
    return part.join(patch, "p_partkey", "left").select("p_partkey", F.coalesce("new_name", "p_name").alias("p_name"), "p_size")


@query("""SELECT 'unique_keys' AS name, count(*) = count(DISTINCT o_orderkey) AS ok FROM orders UNION ALL SELECT 'lines_have_orders', count(*) = 0 FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'funnel_falls', count(*) >= count(*) FILTER (o_orderstatus <> 'P') FROM orders""")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """OP-M28: checks as rows."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    check = lambda df, name, ok: df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), "ok")
    lost = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return check(o, "unique_keys", F.count("*") == F.count_distinct("o_orderkey")).union(check(lost, "lines_have_orders", F.count("*") == 0)).union(check(o, "funnel_falls", F.count("*") >= F.count_if(F.col("o_orderstatus") != "P")))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of a user with gaps under an hour."""
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("w")
