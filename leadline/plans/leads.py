"""Contacts into leads and messages: merging, ranking, materialising, scheduling, and taking back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline import operators as op
from leadline.functions import people, web
from leadline.model import frame, frames, sql
from leadline.operators.ordered import ranked_in
from leadline.plans.checks import DECIDED, RULES, STAGED, staged
from leadline.plans.registry import query
from leadline.plans.sites import ANCHORS
from leadline.sources import links, table

REASONS = ("SUPPRESSED", "INVALID_SYNTAX", "DISPOSABLE_REJECTED", "ROLE_BASED_REJECTED", "MX_FAILED", "LLM_LOW_CONFIDENCE", "PROVIDER_INVALID", "RISK_REVIEW", "UNKNOWN_RETRY")


@query(sql("SELECT " + ", ".join(f"count(*) FILTER (s = '{r}') AS {r.lower()}" for r in REASONS) + f", count(*) AS candidates FROM (SELECT {DECIDED} AS s FROM ({STAGED}))"))
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    """OP-A05: of all candidates those that each stage turned away, in one pass."""
    rows = staged(spark, d).withColumn("llm_threshold", F.lit(RULES["llm_threshold"]))
    names = ("suppressed", "syntax_ok", "disposable", "role_based", "mx_status", "llm_score", "llm_threshold", "mv_status")
    s = fn.decide({n: F.col(n) for n in names}, RULES["allow_role_based"], RULES["llm_mode"] == "hard", RULES["catch_all_policy"] == "allow", RULES["risk_policy"] == "reject")
    return rows.select(s.alias("s")).agg(*[F.count_if(F.col("s") == r).alias(r.lower()) for r in REASONS], F.count("*").alias("candidates"))


NEW = """SELECT contact_id, company_id, lower(trim(coalesce(email, ''))) AS email, full_name, designation, phone, confidence, created_at, CASE WHEN coalesce(email, '') <> '' THEN 'email:' || lower(email) ELSE 'name:' || company_id || ':' || lower(replace(full_name, ' ', '-')) END AS key FROM contacts WHERE NOT lower(concat_ws(' ', full_name, designation, role_category, split_part(email, '@', 1))) LIKE '%intern%'"""


@query(sql(f"""SELECT company_id, key, contact, full_name, designation, phone, confidence, r = 1 AS primary_contact FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY full_name IS NOT NULL DESC, confidence DESC, contact) AS r FROM (SELECT company_id, key, min(contact_id) AS contact, arg_min(full_name, contact_id) FILTER (full_name IS NOT NULL) AS full_name, arg_min(designation, contact_id) FILTER (designation IS NOT NULL) AS designation, arg_min(phone, contact_id) FILTER (phone IS NOT NULL) AS phone, max(confidence) AS confidence FROM ({NEW}) WHERE key IS NOT NULL GROUP BY 1, 2)) WHERE r <= 15"""))
def contact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """OP-M04, S05, W03: contacts without the excluded words, merged by key (what is missing is filled, the surest confidence stays), the best fifteen of a company, its first one primary."""
    c = frame(spark, d, "contacts").where(~fn.holds_keyword(["intern"], F.col("full_name"), F.col("designation"), F.col("role_category"), F.substring_index("email", "@", 1)))
    c = c.withColumn("key", people.contact_key(F.col("email"), F.col("company_id"), F.col("full_name"))).where("key is not null")
    fill = [F.min_by(x, F.when(F.col(x).isNotNull(), F.col("contact_id"))).alias(x) for x in ("full_name", "designation", "phone")]
    merged = c.groupBy("company_id", "key").agg(F.min("contact_id").alias("contact"), *fill, F.max("confidence").alias("confidence"))
    best = op.top_by(merged, ["company_id"], [F.col("full_name").isNotNull().desc(), F.desc("confidence"), F.col("contact")], 15)
    return best.select("company_id", "key", "contact", "full_name", "designation", "phone", "confidence", (F.col("rank") == 1).alias("primary_contact"))


@query(sql("""SELECT coalesce(n.contact_id, o.contact_id) AS contact_id, n.contact_id IS NULL AS tombstoned, n.rank, n.phone, n.source_summary FROM (SELECT contact_id, row_number() OVER (PARTITION BY c.job_id ORDER BY primary_contact DESC, confidence DESC, contact_id) AS rank, coalesce(c.phone, k.phone) AS phone, coalesce(sn, '') AS source_summary FROM contacts c JOIN companies k ON c.company_id = k.company_id LEFT JOIN (SELECT company_id, string_agg(DISTINCT source_name, ', ' ORDER BY source_name) AS sn FROM sightings GROUP BY 1) s ON c.company_id = s.company_id WHERE final_email_status = 'VERIFIED' AND contact_id % 29 <> 0) n FULL JOIN (SELECT contact_id FROM contacts WHERE sales_ready) o ON n.contact_id = o.contact_id"""))
def sales_leads(spark: SparkSession, d: str) -> DataFrame:
    """OP-M07: who is eligible now, ranked in its job, with the company's phone where it has none; who was a lead and isn't any more is tombstoned."""
    seen = frame(spark, d, "sightings").groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("source_summary"))
    companies = frame(spark, d, "companies").select("company_id", F.col("phone").alias("company_phone"))
    lost = frame(spark, d, "suppressions").select(F.col("suppression_id").alias("contact_id"))
    now = frame(spark, d, "contacts").where("final_email_status = 'VERIFIED'").join(lost, "contact_id", "left_anti").join(companies, "company_id").join(seen, "company_id", "left")
    now = ranked_in(now, ["job_id"], F.desc("primary_contact"), F.desc("confidence"), "contact_id", name="rank")
    now = now.select("contact_id", "rank", F.coalesce("phone", "company_phone").alias("phone"), F.coalesce("source_summary", F.lit("")).alias("source_summary"), F.lit(True).alias("_now"))
    was = frame(spark, d, "contacts").where("sales_ready").select("contact_id")
    return now.join(was, "contact_id", "full_outer").select("contact_id", F.col("_now").isNull().alias("tombstoned"), "rank", "phone", "source_summary")


@query(sql("""SELECT company_id, CASE WHEN not_view = 0 THEN 'purged' WHEN n > not_view THEN 'stripped' ELSE 'kept' END AS fate, left_sources, CASE WHEN not_view = 0 THEN coalesce(t, 0) ELSE 0 END AS contacts_gone FROM (SELECT company_id, count(*) AS n, count(*) FILTER (source_name <> 'view') AS not_view, coalesce(string_agg(DISTINCT source_name, ',' ORDER BY source_name) FILTER (source_name <> 'view'), '') AS left_sources FROM sightings GROUP BY 1) LEFT JOIN (SELECT company_id, count(*) AS t FROM contacts GROUP BY 1) USING (company_id)"""))
def source_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """OP-M10, A22: companies that one source alone knows go with their contacts, its evidence is stripped from the others, and what is left is recomputed."""
    other = F.col("source_name") != "view"
    s = frame(spark, d, "sightings").groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(other).alias("o"), F.array_join(F.array_sort(F.collect_set(F.when(other, F.col("source_name")))), ",").alias("left_sources"))
    t = frame(spark, d, "contacts").groupBy("company_id").agg(F.count("*").alias("t"))
    fate = F.when(F.col("o") == 0, "purged").when(F.col("n") > F.col("o"), "stripped").otherwise("kept")
    return s.join(t, "company_id", "left").select("company_id", fate.alias("fate"), "left_sources", F.when(F.col("o") == 0, F.coalesce("t", F.lit(0))).otherwise(0).cast("long").alias("contacts_gone"))


@query(sql("""WITH_ q AS (SELECT m.campaign_id, contact_id, message_id, row_number() OVER (PARTITION BY m.campaign_id ORDER BY message_id) - 1 AS k, full_name, company_name, k.city FROM messages m JOIN contacts USING (contact_id) JOIN companies k USING (company_id) WHERE m.status = 'queued') SELECT campaign_id, message_id, (k // 41)::BIGINT AS day, (540 + k % 41 * 12)::BIGINT AS minute, CASE WHEN full_name IS NOT NULL THEN 'Dear ' || full_name || ' of ' || company_name || '!' END AS body, full_name IS NULL AS render_failed FROM q""").replace(" WITH_ q AS", ", q AS"))
def campaign_schedule(spark: SparkSession, d: str) -> DataFrame:
    """OP-M14, S47, S48: eligible messages on their campaign's slots with their texts; one whose text can't be made is dropped from sending, its slot stays spent."""
    m = frame(spark, d, "messages").where("status = 'queued'").select("campaign_id", "contact_id", "message_id")
    c = frame(spark, d, "contacts").select("contact_id", "company_id", "full_name")
    k = frame(spark, d, "companies").select("company_id", "company_name")
    rows = op.slots(m.join(c, "contact_id").join(k, "company_id"), "campaign_id", [F.col("message_id")], 540, 1020, 12)
    body = F.concat(F.lit("Dear "), F.nullif(F.trim("full_name"), F.lit("")), F.lit(" of "), "company_name", F.lit("!"))
    return rows.select("campaign_id", "message_id", "day", "minute", body.alias("body"), body.isNull().alias("render_failed"))


@query(sql("""SELECT campaign_id, count(*) AS messages, count(*) FILTER (full_name IS NULL) AS render_failed, max((k // 41) * 1440 + 540 + k % 41 * 12)::BIGINT AS last_minute FROM (SELECT m.campaign_id, full_name, row_number() OVER (PARTITION BY m.campaign_id ORDER BY message_id) - 1 AS k FROM messages m JOIN contacts USING (contact_id) WHERE m.status = 'queued') GROUP BY 1"""))
def schedule_summary(spark: SparkSession, d: str) -> DataFrame:
    """OP-M14: of each campaign its messages, those that can't be written, and when the last one goes."""
    return campaign_schedule(spark, d).groupBy("campaign_id").agg(F.count("*").alias("messages"), F.count_if("render_failed").alias("render_failed"), F.max(F.col("day") * 1440 + F.col("minute")).alias("last_minute"))


#: What each bounce of an address leads to, after the rules for bounces: softs counts its soft bounces until then.
OUTCOME = """SELECT bounce_id, detected_at, lower(email) AS email, CASE WHEN bounce_type = 'spam_rejected' THEN 'Spam rejection' WHEN bounce_type IN ('hard', 'mailbox_full', 'invalid_domain') THEN 'Hard bounce' WHEN bounce_type = 'blocked' THEN 'Blocked by recipient server' WHEN softs >= 3 THEN 'Repeated soft bounces (3)' END AS lost, softs FROM (SELECT *, count(*) FILTER (bounce_type = 'soft') OVER (PARTITION BY lower(email) ORDER BY detected_at, bounce_id ROWS UNBOUNDED PRECEDING) AS softs FROM bounces)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every bounce with what it leads to, by the address in lower case."""
    b = frame(spark, d, "bounces").select("bounce_id", F.col("bounce_type").alias("kind"), F.lower("email").alias("email"), "detected_at")
    return op.bounce_actions(b, "email", ["detected_at", "bounce_id"])


@query(sql(f"""SELECT bounce_id, lost IS NOT NULL AS suppressed, CASE WHEN lost IS NULL THEN softs END AS softs FROM ({OUTCOME})"""))
def bounce_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """OP-M15, A16: whether a bounce loses its address, and if not how many soft ones it has had."""
    lost = F.col("action").startswith("suppressed")
    return outcomes(spark, d).select("bounce_id", lost.alias("suppressed"), F.when(~lost, F.regexp_extract("action", r"(\d+)/", 1).cast("long")).alias("softs"))


@query(sql(f"""SELECT coalesce(s.email, n.email) AS email, coalesce(s.reason, n.reason) AS reason, n.email IS NOT NULL OR s.permanent AS permanent FROM (SELECT lower(email) AS email, arg_min(reason, suppression_id) AS reason, bool_or(permanent) AS permanent FROM suppressions WHERE email IS NOT NULL GROUP BY 1) s FULL JOIN (SELECT email, arg_min(lost, (detected_at, bounce_id)) AS reason FROM ({OUTCOME}) WHERE lost IS NOT NULL GROUP BY 1) n ON s.email = n.email"""))
def suppression_upsert(spark: SparkSession, d: str) -> DataFrame:
    """OP-M16: the suppression list after all bounces: spam, hard bounces, blocks and a spent budget add an address for good, or make a known one permanent."""
    there = frame(spark, d, "suppressions").select(F.col("suppression_id").alias("id"), "email", "reason", "permanent")
    return op.upsert_suppressions(there, op.suppressed_by_bounce(outcomes(spark, d), "email", ["detected_at", "bounce_id"]))


@query(sql(f"""SELECT lead_id, tombstoned OR b.email IS NOT NULL AS tombstoned, CASE WHEN b.email IS NOT NULL THEN 'bounced' ELSE 'none' END AS campaign_status FROM leads l LEFT JOIN (SELECT DISTINCT email FROM ({OUTCOME}) WHERE lost IS NOT NULL) b ON lower(l.email) = b.email"""))
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """OP-M17: leads whose address any bounce lost are tombstoned, whatever the case of its letters."""
    lost = op.suppressed_by_bounce(outcomes(spark, d), "email", ["detected_at", "bounce_id"]).select(F.col("email").alias("lost"))
    out = frame(spark, d, "leads").join(lost, F.lower("email") == F.col("lost"), "left")
    return out.select("lead_id", (F.col("tombstoned") | F.col("lost").isNotNull()).alias("tombstoned"), F.when(F.col("lost").isNotNull(), "bounced").otherwise("none").alias("campaign_status"))


@query(sql("""SELECT audit, actor, what FROM (SELECT e.event_id AS audit, user_name AS actor, event_type AS what, ts FROM events e LEFT JOIN users u ON e.user_id = u.user_id WHERE lower(event_type) LIKE '%log%' OR lower(coalesce(props, '')) LIKE '%"k": 7%' OR lower(coalesce(event_id::VARCHAR, '')) LIKE '%99%') ORDER BY ts DESC, audit LIMIT 500"""))
def audit_search(spark: SparkSession, d: str) -> DataFrame:
    """OP-F04, J04: text in any of three columns, with the actor's name where there is one, newest first."""
    e = frame(spark, d, "events")
    has = lambda c, x: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(x)
    some = e.where(has("event_type", "log") | has("props", '"k": 7') | has("event_id", "99"))
    u = frame(spark, d, "users").select("user_id", F.col("user_name").alias("actor"))
    return some.join(u, "user_id", "left").orderBy(F.desc("ts"), "event_id").limit(500).select(F.col("event_id").alias("audit"), "actor", F.col("event_type").alias("what"))


CHECKS_SQL = [
    ("companies_unique", "SELECT count(*) = count(DISTINCT company_id) FROM companies"),
    ("contacts_have_companies", "SELECT count(*) = 0 FROM contacts WHERE company_id NOT IN (SELECT company_id FROM companies)"),
    ("leads_verified", "SELECT count(*) = 0 FROM leads WHERE validation_status IS DISTINCT FROM 'VERIFIED'"),
    ("leads_not_suppressed", "SELECT count(*) = 0 FROM leads WHERE NOT tombstoned AND lower(email) IN (SELECT lower(email) FROM suppressions WHERE email IS NOT NULL)"),
    ("funnel_falls", "SELECT count(sent_at) >= count(delivered_at) AND count(delivered_at) >= count(opened_at) AND count(opened_at) >= count(clicked_at) FROM messages"),
    ("messages_have_campaigns", "SELECT count(*) = 0 FROM messages WHERE campaign_id NOT IN (SELECT campaign_id FROM campaigns)"),
    ("bounces_have_times", "SELECT count(*) = 0 FROM bounces WHERE detected_at IS NULL"),
    ("every_company_seen", "SELECT count(*) = 0 FROM companies WHERE company_id NOT IN (SELECT company_id FROM sightings)"),
    ("stages_ran", "SELECT count(DISTINCT final_status) >= 4 FROM checks"),
    ("skips_are_logged", "SELECT count(*) > 0 FROM runs WHERE status = 'skipped'"),
]


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS name, ({q}) AS ok" for n, q in CHECKS_SQL)))
def acceptance_checks(spark: SparkSession, d: str) -> DataFrame:
    """OP-M28: ten statements about the tables, each a row with its answer."""
    t = frames(spark, d, ["companies", "contacts", "leads", "suppressions", "messages", "campaigns", "bounces", "sightings", "checks", "runs"], ["companies", "contacts", "messages"])
    none = F.count("*") == 0
    held = t["suppressions"].where("email is not null").select(F.lower("email").alias("_e"))
    said = {
        "companies_unique": (t["companies"], F.count("*") == F.count_distinct("company_id")),
        "contacts_have_companies": (t["contacts"].join(t["companies"], "company_id", "left_anti"), none),
        "leads_verified": (t["leads"].where(~F.col("validation_status").eqNullSafe("VERIFIED")), none),
        "leads_not_suppressed": (t["leads"].where("not tombstoned").join(held, F.lower("email") == F.col("_e"), "left_semi"), none),
        "funnel_falls": (t["messages"], (F.count("sent_at") >= F.count("delivered_at")) & (F.count("delivered_at") >= F.count("opened_at")) & (F.count("opened_at") >= F.count("clicked_at"))),
        "messages_have_campaigns": (t["messages"].join(t["campaigns"], "campaign_id", "left_anti"), none),
        "bounces_have_times": (t["bounces"].where("detected_at is null"), none),
        "every_company_seen": (t["companies"].join(t["sightings"], "company_id", "left_anti"), none),
        "stages_ran": (t["checks"], F.count_distinct("final_status") >= 4),
        "skips_are_logged": (t["runs"].where("status = 'skipped'"), F.count("*") > 0),
    }
    out = None
    for name, (df, ok) in said.items():
        row = df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), "ok")
        out = row if out is None else out.union(row)
    return out


#: Every path that a page links to, in order, and the rules of its site by rule: the first link is closed but for what begins with its name and 'a', the second is closed with a
#: slash behind it, the third open.
PATHS = f"SELECT page_id, href AS path, row_number() OVER (PARTITION BY page_id ORDER BY footer, place) AS i FROM ({ANCHORS}) WHERE regexp_matches(href, '^/[^#]+$')"


@query(f"""SELECT DISTINCT page_id, path, greatest(CASE WHEN starts_with(path, a || 'a') THEN length(a) + 1 ELSE -1 END, CASE WHEN starts_with(path, c) THEN length(c) ELSE -1 END, -1) >= greatest(CASE WHEN starts_with(path, a) THEN length(a) ELSE -1 END, CASE WHEN starts_with(path, b || '/') THEN length(b) + 1 ELSE -1 END, -1) AS allowed FROM (SELECT page_id, unnest([path, path || 'a', path || '/x']) AS path, a, b, c FROM ({PATHS}) p JOIN (SELECT page_id, max(path) FILTER (i = 1) AS a, max(path) FILTER (i = 2) AS b, max(path) FILTER (i = 3) AS c FROM ({PATHS}) GROUP BY 1 HAVING count(*) >= 3) r USING (page_id))""")
def crawlable(spark: SparkSession, d: str) -> DataFrame:
    """OP-I15: the paths that each page links to, and some below them, against rules made of its own links: the longest rule that fits decides, an allowing one of
    equal length first; what no rule names is allowed."""
    found = links.anchors(table(spark, d, "pages")).where(F.col("href").rlike("^/[^#]+$"))
    listed = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("footer", "place", "href"))).alias("l")).where("size(l) >= 3")
    nth = lambda i: F.col("l")[i]["href"]
    rules = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: "), nth(0), F.lit(" # closed\nAllow: "), nth(0), F.lit("a\nDisallow: "), nth(1), F.lit("/\nAllow: "), nth(2), F.lit("\nDisallow:\n"))
    paths = F.flatten(F.transform("l", lambda x: F.array(x["href"], F.concat(x["href"], F.lit("a")), F.concat(x["href"], F.lit("/x")))))
    rows = listed.select("page_id", rules.alias("rules"), F.explode(F.array_distinct(paths)).alias("path"))
    return rows.select("page_id", "path", web.crawl_allowed(F.col("rules"), F.col("path")).alias("allowed"))
