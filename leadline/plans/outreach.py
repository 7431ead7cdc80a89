"""Queries on contacts, messages, bounces, replies, jobs and reports.

Orders stand for messages: the campaign is the priority, the state one of nine by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline import operators as op
from leadline.functions import web
from leadline.operators.ordered import ranked_in
from leadline.plans.registry import query
from leadline.plans.web import TITLES, pick, sql_case, sql_list, sql_pick
from leadline.sources import table

STATES = ("queued", "sent", "delivered", "opened", "clicked", "replied", "bounced", "blocked", "unsubscribed")
MESSAGES = f"SELECT o_orderkey AS id, o_orderpriority AS campaign, o_custkey AS contact, 'C' || o_custkey || '@h' || (o_custkey % 7) || '.org' AS email, o_orderdate AS sent_at, o_totalprice AS price, {sql_pick(STATES, 'o_orderkey')} AS status FROM orders"


def messages(spark: SparkSession, d: str) -> DataFrame:
    email = F.concat(F.lit("C"), "o_custkey", F.lit("@h"), F.col("o_custkey") % 7, F.lit(".org"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("campaign"), F.col("o_custkey").alias("contact"), email.alias("email"), F.col("o_orderdate").alias("sent_at"), F.col("o_totalprice").alias("price"), pick(STATES, "o_orderkey").alias("status"))


SENT, DELIVERED, BOUNCED = STATES[1:6], STATES[2:6], ("bounced", "blocked")


@query(f"""SELECT campaign, count(*) AS messages, count(*) FILTER (status IN {SENT}) AS sent, count(*) FILTER (status IN {DELIVERED}) AS delivered, count(*) FILTER (status IN {BOUNCED}) AS bounced, CASE WHEN count(*) FILTER (status IN {SENT}) = 0 THEN 0.0 ELSE round(100.0 * count(*) FILTER (status = 'replied') / count(*) FILTER (status IN {SENT}), 2) END AS reply_rate FROM ({MESSAGES}) GROUP BY 1""")
def campaign_stats(spark: SparkSession, d: str) -> DataFrame:
    """OP-A12: states to buckets by campaign."""
    s = F.col("status")
    rows = messages(spark, d).groupBy("campaign").agg(F.count("*").alias("messages"), F.count_if(s.isin(*SENT)).alias("sent"), F.count_if(s.isin(*DELIVERED)).alias("delivered"), F.count_if(s.isin(*BOUNCED)).alias("bounced"), F.count_if(s == "replied").alias("_r"))
    return rows.withColumn("reply_rate", fn.rate(F.col("_r"), F.col("sent"))).drop("_r")


@query(f"""SELECT campaign, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM ({MESSAGES}) GROUP BY 1""")
def shares(spark: SparkSession, d: str) -> DataFrame:
    """OP-A25: the share of the total of each slice; the total is a scalar subquery, added up in every task."""
    rows = messages(spark, d)
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy("campaign").agg(F.count("*").alias("n")).select("campaign", "n", fn.rounded(100.0 * F.col("n") / total, 2).alias("share"))


@query("""SELECT (SELECT count(*) FROM nation) AS companies, (SELECT count(*) FROM customer) AS contacts, count(*) AS messages, count(*) FILTER (o_orderstatus = 'F') AS delivered, round(coalesce(sum(o_totalprice), 0), 2) AS cost FROM orders""")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    """OP-A01, A20: one row of totals; each part is an aggregate of one row."""
    one = lambda t, name: table(spark, d, t).agg(F.count("*").alias(name))
    sums = table(spark, d, "orders").agg(F.count("*").alias("messages"), F.count_if(F.col("o_orderstatus") == "F").alias("delivered"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("cost"))
    on = lambda df: df.withColumn("_k", F.lit(1))
    return on(one("nation", "companies")).join(on(one("customer", "contacts")), "_k").join(on(sums), "_k").drop("_k")


@query("""SELECT user_id AS source, arg_max('error ' || event_id, (ts, event_id)) AS error FROM events WHERE event_type = 'error' GROUP BY 1""")
def latest_error(spark: SparkSession, d: str) -> DataFrame:
    """OP-A10: the newest error of each source."""
    rows = table(spark, d, "events").where("event_type = 'error'")
    return rows.groupBy(F.col("user_id").alias("source")).agg(F.max_by(F.concat(F.lit("error "), "event_id"), F.struct("ts", "event_id")).alias("error"))


@query("""SELECT user_id % 5 AS tenant, event_type AS provider, count(*) AS request_count, round(sum(value), 4) AS cost, max(ts) AS last_at FROM events GROUP BY 1, 2""")
def api_usage(spark: SparkSession, d: str) -> DataFrame:
    """OP-K09, A20: metered use by tenant and provider."""
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("tenant"), F.col("event_type").alias("provider")).agg(F.count("*").alias("request_count"), F.round(F.sum("value"), 4).alias("cost"), F.max("ts").alias("last_at"))


POSTURES = ("green", "amber", "red")


@query(f"""SELECT n_regionkey AS company, {sql_pick(POSTURES, 'max(n_nationkey % 3)')} AS posture, string_agg(DISTINCT 's' || (n_nationkey % 4), ', ' ORDER BY 's' || (n_nationkey % 4)) AS source_summary FROM nation GROUP BY 1""")
def worst_posture(spark: SparkSession, d: str) -> DataFrame:
    """OP-A18, A19: the worst posture and the sources of each company."""
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("company")).agg(F.max(F.col("n_nationkey") % 3).alias("worst"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("n_nationkey") % 4))), ", ").alias("source_summary"))
    return rows.select("company", pick(POSTURES, "worst").alias("posture"), "source_summary")


DIAGNOSTICS = ("5.1.1|no such user", "4.2.2|over quota", "5.1.2|host unknown", "5.7.1|rejected as SPAM", "4.4.1|connection refused", "4.7.28|slow down", "4.3.0|try later", "2.0.0|fine")
BOUNCE = "SELECT l_orderkey AS message, l_linenumber AS line, l_suppkey AS recipient, l_shipdate AS seen_at, " + sql_pick(DIAGNOSTICS, "(l_partkey + l_linenumber)") + " AS raw FROM lineitem WHERE l_returnflag = 'R'"
KIND = sql_case([("regexp_matches(lower(raw), '" + "|".join(w.replace(".", "[.]") for w in ws) + "')", f"'{k}'") for k, ws in web.BOUNCES] + [("raw LIKE '5%'", "'hard'"), ("raw LIKE '4%'", "'soft'")], "'unknown'")


def bounces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumn("k", F.col("l_partkey") + F.col("l_linenumber"))
    rows = rows.select(F.col("l_orderkey").alias("message"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("recipient"), F.col("l_shipdate").alias("seen_at"), pick(DIAGNOSTICS, "k").alias("raw"))
    return rows.withColumn("kind", web.classify_bounce(F.substring_index("raw", "|", 1), F.substring_index("raw", "|", -1))).drop("raw")


@query(f"""SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind FROM ({BOUNCE})) GROUP BY 1""")
def bounce_classify(spark: SparkSession, d: str) -> DataFrame:
    """OP-S50: kinds of bounces."""
    return bounces(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


ACTION = "CASE WHEN kind = 'spam_rejected' THEN 'suppressed_spam' WHEN kind IN ('hard', 'invalid_domain', 'mailbox_full') THEN 'suppressed_hard' WHEN kind = 'blocked' THEN 'suppressed_blocked' WHEN soft >= 3 THEN 'suppressed_soft_exhausted' ELSE 'soft_retry (' || soft || '/3)' END"
BECOMES = "CASE WHEN kind = 'spam_rejected' THEN 'spam_complaint' WHEN kind IN ('hard', 'invalid_domain', 'mailbox_full') THEN 'hard_bounce' WHEN kind = 'blocked' THEN 'blocked' ELSE 'soft_bounce' END"


@query(f"""SELECT message, line, kind, {ACTION} AS action, {BECOMES} AS message_status FROM (SELECT message, line, kind, count(*) FILTER (kind = 'soft') OVER (PARTITION BY recipient ORDER BY seen_at, message, line ROWS UNBOUNDED PRECEDING) AS soft FROM (SELECT *, {KIND} AS kind FROM ({BOUNCE})))""")
def bounce_actions(spark: SparkSession, d: str) -> DataFrame:
    """OP-M15, A16: what a bounce leads to: spam, hard ones and blocks suppress at once, every other one once the recipient has had three soft ones."""
    return op.bounce_actions(bounces(spark, d), "recipient", ["seen_at", "message", "line"]).select("message", "line", "kind", "action", "message_status")


@query(f"""SELECT id, CASE WHEN status = 'sent' AND sent_at <= TIMESTAMP '1997-01-01' - INTERVAL 3 HOUR AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'delivered' ELSE status END AS status FROM ({MESSAGES})""")
def delivery_classify(spark: SparkSession, d: str) -> DataFrame:
    """OP-M19, T05: sent three hours ago or longer and not bounced is delivered."""
    bounced = bounces(spark, d).select(F.col("message").alias("id")).distinct().withColumn("_b", F.lit(True))
    old = F.col("sent_at") <= F.expr("timestamp_ntz '1997-01-01 00:00:00' - interval 3 hours")
    rows = messages(spark, d).join(bounced, "id", "left")
    return rows.select("id", F.when((F.col("status") == "sent") & old & F.col("_b").isNull(), "delivered").otherwise(F.col("status")).alias("status"))


@query(f"""SELECT campaign, CASE WHEN count(*) FILTER (status = 'queued') = 0 THEN 'completed' ELSE 'sending' END AS state FROM ({MESSAGES}) GROUP BY 1""")
def campaign_complete(spark: SparkSession, d: str) -> DataFrame:
    """OP-M20: nothing queued is complete."""
    return messages(spark, d).groupBy("campaign").agg(F.when(F.count_if(F.col("status") == "queued") == 0, "completed").otherwise("sending").alias("state"))


@query(f"""SELECT id, campaign FROM ({MESSAGES}) WHERE status = 'queued' AND sent_at <= TIMESTAMP '1997-01-01' AND campaign LIKE '1%'""")
def due_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """OP-F13: queued messages of active campaigns whose time has come."""
    return messages(spark, d).where((F.col("status") == "queued") & (F.col("sent_at") <= F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("campaign").startswith("1")).select("id", "campaign")


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_id > 500""")
def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """OP-F12, T01: events after a cursor."""
    from leadline.streaming import replay

    return replay(table(spark, d, "events"), 500).select("event_id", "user_id", "event_type")


TERMINAL = "CASE WHEN status IN ('bounced', 'blocked') THEN 'already_bounced' WHEN status = 'unsubscribed' THEN 'already_unsubscribed' WHEN status = 'replied' THEN 'already_replied' END"
PLAN = f"""WITH m AS (SELECT lower(email) AS email, min(CASE {TERMINAL} WHEN 'already_bounced' THEN 0 WHEN 'already_unsubscribed' THEN 1 WHEN 'already_replied' THEN 2 END) AS t FROM ({MESSAGES}) GROUP BY 1), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'c' || (c_custkey - c_custkey % 19 % 2) || '@h' || ((c_custkey - c_custkey % 19 % 2) % 7) || '.org' END AS email, c_custkey % 6 <> 0 AS verified, c_custkey % 23 = 0 AS suppressed FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS seen FROM c) SELECT id, CASE WHEN f.email IS NULL THEN 'no_email' WHEN seen > 1 THEN 'duplicate' WHEN NOT verified THEN 'not_verified' WHEN suppressed THEN 'suppressed' WHEN t = 0 THEN 'already_bounced' WHEN t = 1 THEN 'already_unsubscribed' WHEN t = 2 THEN 'already_replied' ELSE 'eligible' END AS reason FROM f LEFT JOIN m ON f.email = m.email"""


@query(PLAN)
def recipient_plan(spark: SparkSession, d: str) -> DataFrame:
    """OP-J08, W07, Q5: why each contact is or isn't written to, without keywords and roles, which `outreach_plan` (OP-M13) has."""
    k = F.col("c_custkey")
    base = k - k % 19 % 2
    email = F.when(k % 17 != 0, F.concat(F.lit("c"), base, F.lit("@h"), base % 7, F.lit(".org")))
    contacts = table(spark, d, "customer").select(k.alias("id"), email.alias("email"), (k % 6 != 0).alias("verified"), (k % 23 == 0).alias("suppressed"))
    return op.plan_recipients(contacts, messages(spark, d)).select("id", "reason")


@query(f"SELECT reason, count(*) AS n FROM ({PLAN}) GROUP BY 1")
def eligibility_summary(spark: SparkSession, d: str) -> DataFrame:
    """OP-A13: contacts by reason."""
    return recipient_plan(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


EXCLUDE, INCLUDE = ("worker", "consultant"), ("founder", "partner", "head", "chief", "cto", "owner", "president", "director")
OUTREACH = f"""WITH m AS (SELECT lower(email) AS email, min(CASE {TERMINAL} WHEN 'already_bounced' THEN 0 WHEN 'already_unsubscribed' THEN 1 WHEN 'already_replied' THEN 2 END) AS t FROM ({MESSAGES}) GROUP BY 1), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'c' || (c_custkey - c_custkey % 19 % 2) || '@h' || ((c_custkey - c_custkey % 19 % 2) % 7) || '.org' END AS email, c_custkey % 6 <> 0 AS verified, c_custkey % 23 = 0 AS suppressed, lower({sql_pick(TITLES, 'c_custkey')}) AS title FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS seen FROM c) SELECT id, CASE WHEN f.email IS NULL THEN 'no_email' WHEN seen > 1 THEN 'duplicate' WHEN NOT verified THEN 'not_verified' WHEN suppressed THEN 'suppressed' WHEN t = 0 THEN 'already_bounced' WHEN t = 1 THEN 'already_unsubscribed' WHEN t = 2 THEN 'already_replied' WHEN list_bool_or(list_transform([{sql_list(EXCLUDE)}], lambda x: contains(title, x))) THEN 'excluded_keyword' WHEN NOT list_bool_or(list_transform([{sql_list(INCLUDE)}], lambda x: contains(title, x))) THEN 'role_filtered' ELSE 'eligible' END AS reason FROM f LEFT JOIN m ON f.email = m.email"""


@query(OUTREACH)
def outreach_plan(spark: SparkSession, d: str) -> DataFrame:
    """OP-M13: why each contact is or isn't written to, with keywords and roles, by the outcomes of all messages."""
    k = F.col("c_custkey")
    base = k - k % 19 % 2
    email = F.when(k % 17 != 0, F.concat(F.lit("c"), base, F.lit("@h"), base % 7, F.lit(".org")))
    contacts = table(spark, d, "customer").select(k.alias("id"), email.alias("email"), (k % 6 != 0).alias("verified"), (k % 23 == 0).alias("suppressed"), pick(TITLES, "c_custkey").alias("title"))
    return op.plan_recipients(contacts, messages(spark, d), ["title"], list(EXCLUDE), list(INCLUDE)).select("id", "reason")


@query(f"SELECT reason, count(*) AS n FROM ({OUTREACH}) GROUP BY 1")
def outreach_summary(spark: SparkSession, d: str) -> DataFrame:
    """OP-A13: contacts by reason, of outreach_plan."""
    return outreach_plan(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


TEMPLATES = ("Dear {{FullName}} of {{Company}}, {{ City }}?", "Hi {{FirstName}}", "{{Nonsense}} {{FullName}}", "{{Services}} for you")


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dear ' || c_name || ' of ' || n_name || ', $' || n_name || '?' END AS text, CASE c_custkey % 4 WHEN 1 THEN 'missing:FirstName' WHEN 2 THEN 'unknown:Nonsense' WHEN 3 THEN 'missing:Services' END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    """OP-S47, S48: strict templates; an error instead of a text where a variable is unknown or empty."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = web.render(pick(TEMPLATES, "c_custkey"), {"FullName": F.col("c_name"), "Company": F.col("n_name"), "City": F.concat(F.lit("$"), "n_name"), "FirstName": F.lit("")})
    return rows.select("c_custkey", out["text"].alias("text"), out["error"].alias("error"))


LEADS = "SELECT c_custkey AS id, c_nationkey AS company, round(abs(c_acctbal) / 10000, 3) AS confidence, c_custkey % 5 <> 0 AS now_ok, c_custkey % 3 = 0 AS was FROM customer"


@query(f"""SELECT id, CASE WHEN now_ok THEN 'materialised' ELSE 'tombstoned' END AS state, CASE WHEN now_ok THEN (row_number() OVER (PARTITION BY company ORDER BY NOT now_ok, confidence DESC, id))::INT END AS rank FROM ({LEADS}) WHERE now_ok OR was""")
def sales_ready(spark: SparkSession, d: str) -> DataFrame:
    """OP-M07, W01, W03, S43: eligible contacts with their rank; those that were and no longer are become tombstones."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("company"), fn.rounded(F.abs("c_acctbal") / 10000, 3).alias("confidence"), (k % 5 != 0).alias("now_ok"), (k % 3 == 0).alias("was")).where("now_ok or was")
    ranked = ranked_in(rows, ["company"], ~F.col("now_ok"), F.desc("confidence"), "id", name="r")
    return ranked.select("id", F.when(F.col("now_ok"), "materialised").otherwise("tombstoned").alias("state"), F.when(F.col("now_ok"), F.col("r")).cast("int").alias("rank"))


@query("""SELECT o_custkey AS id, max(o_totalprice) AS confidence, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS title, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS candidates FROM orders GROUP BY 1""")
def contact_merge(spark: SparkSession, d: str) -> DataFrame:
    """OP-M03, M04, S06: the highest confidence, the first value that isn't empty, all candidates."""
    title = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("confidence"), F.min_by("o_orderstatus", title).alias("title"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("candidates"))


@query("""SELECT p_partkey, in_other, CASE WHEN in_dir AND NOT in_other THEN 'purge' WHEN in_dir THEN 'strip' ELSE 'keep' END AS action FROM (SELECT l_partkey AS p_partkey, bool_or(l_linenumber = 1) AS in_dir, bool_or(l_linenumber <> 1) AS in_other FROM lineitem GROUP BY 1)""")
def source_purge(spark: SparkSession, d: str) -> DataFrame:
    """OP-J06, M10, A22, U06: companies seen in one source only go; others lose that source's evidence."""
    one = F.col("l_linenumber") == 1
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(one).alias("in_dir"), F.bool_or(~one).alias("in_other"))
    return rows.select("p_partkey", "in_other", F.when(F.col("in_dir") & ~F.col("in_other"), "purge").when(F.col("in_dir"), "strip").otherwise("keep").alias("action"))


@query("""SELECT s.conv_id, s.turn AS sent, arg_min(t.turn, t.turn) AS turn FROM (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1) s JOIN conversations t ON s.conv_id = t.conv_id WHERE t.turn <> s.turn AND t.role <> 'user' AND NOT regexp_matches(lower(coalesce(t.text, '')), 'delivery status notification|mail delivery|undelivered') GROUP BY 1, 2""")
def reply_hits(spark: SparkSession, d: str) -> DataFrame:
    """OP-J12, M18, S52: a sent message's first answer in its thread: not itself, none of one's own, no delivery notice."""
    c = table(spark, d, "conversations")
    sent = c.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("sent"))
    hits = c.where((F.col("role") != "user") & ~web.is_notice(F.col("text"))).select("conv_id", "turn")
    return sent.join(hits, "conv_id").where("turn <> sent").groupBy("conv_id", "sent").agg(F.min("turn").alias("turn"))


@query("""SELECT job, companies, trunc(companies * 85 / 100)::BIGINT AS low, trunc(companies * 110 / 100)::BIGINT AS high, greatest(20, trunc(companies * 4 / 10)::BIGINT) AS runtime, round(CASE WHEN maps THEN searches * 3 * 0.032 + 0.005 ELSE 0 END + trunc(companies * 5 / 2) * 0.10 * 0.18 + trunc(companies * 5 / 2) * 0.0008 + trunc(companies * 5 / 2) * 0.0002, 2)::DOUBLE AS cost FROM (SELECT n_nationkey AS job, maps, least(v * t, 40) AS searches, CASE WHEN maps AND dirs THEN trunc((m + 160) * 78 / 100) WHEN maps THEN m WHEN dirs THEN 160 ELSE 0 END AS companies FROM (SELECT *, trunc(60 * (100 + 35 * (v - 1)) / 100 * CASE WHEN t = 7 THEN 2.5 ELSE 1 END) AS m FROM (SELECT n_nationkey, n_nationkey % 3 <> 0 AS maps, n_nationkey % 4 <> 1 AS dirs, greatest(1, least(6, n_nationkey)) AS v, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 1 END AS t FROM nation)))""")
def job_estimate(spark: SparkSession, d: str) -> DataFrame:
    """OP-A23, I03: companies, cost and running time that a job may take, from its sources, query variants and tiles."""
    k = F.col("n_nationkey")
    jobs = table(spark, d, "nation").select(k.alias("job"), (k % 3 != 0).alias("maps"), (k % 4 != 1).alias("dirs"), F.greatest(F.lit(1), F.least(F.lit(6), k)).alias("v"), F.when(k % 2 == 0, 7).otherwise(1).alias("t"))
    return fn.estimate(jobs, "job", "maps", "dirs", "v", "t")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Extension: hourly windows over events, as the stream counts them."""
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM lineitem WHERE l_quantity > 17) GROUP BY l_orderkey, island""")
def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    """OP-S63, M08: runs of neighbouring rows, so that one write covers each."""
    rows = table(spark, d, "lineitem").where("l_quantity > 17").select("l_orderkey", "l_linenumber")
    rows = rows.withColumn("island", F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return rows.groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")).drop("island")
