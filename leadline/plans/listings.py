"""Lists, details, joins and dashboard figures over the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline import operators as op
from leadline.model import frame, sql
from leadline.plans.registry import query


def any_ilike(pattern: str, *columns: str) -> Column:
    """Some column holds the pattern, whatever the case; null columns don't."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


@query(sql("""SELECT company_id, company_name, domain, city, website_status FROM companies WHERE city ILIKE '%ion_1%' AND website_status <> 'unreachable' AND (company_name ILIKE '%1%' OR domain ILIKE '%1%' OR city ILIKE '%1%') AND company_id IN (SELECT company_id FROM sightings WHERE source_name = 'click') ORDER BY created_on, company_id LIMIT 100 OFFSET 2"""))
def companies_list(spark: SparkSession, d: str) -> DataFrame:
    """OP-F01, J05: city, status, text over three columns, and a semi-join on the source of a sighting."""
    c = frame(spark, d, "companies").where(F.col("city").ilike("%ion_1%") & (F.col("website_status") != "unreachable") & any_ilike("%1%", "company_name", "domain", "city"))
    seen = frame(spark, d, "sightings").where("source_name = 'click'").select("company_id")
    return c.join(seen, "company_id", "left_semi").orderBy("created_on", "company_id").offset(2).limit(100).select("company_id", "company_name", "domain", "city", "website_status")


@query(sql("""SELECT contact_id, full_name, designation, email, final_email_status FROM contacts WHERE role_category ILIKE '%sal%' AND final_email_status = 'VERIFIED' AND sales_ready AND (full_name ILIKE '%a%' OR email ILIKE '%a%' OR designation ILIKE '%a%') ORDER BY created_at DESC, contact_id LIMIT 200"""))
def contacts_list(spark: SparkSession, d: str) -> DataFrame:
    """OP-F02: contacts by role, status and readiness, with text over name, address and designation."""
    c = frame(spark, d, "contacts").where(F.col("role_category").ilike("%sal%") & (F.col("final_email_status") == "VERIFIED") & F.col("sales_ready") & any_ilike("%a%", "full_name", "email", "designation"))
    return c.orderBy(F.desc("created_at"), "contact_id").limit(200).select("contact_id", "full_name", "designation", "email", "final_email_status")


@query(sql("""SELECT job_id, job_name, status, selected_sources FROM jobs WHERE list_contains(string_split(selected_sources, ','), 'view') AND created_on BETWEEN DATE '2024-01-05' AND DATE '2024-02-05' AND (city ILIKE '%brand%' OR country ILIKE '%brand%') AND status <> 'FAILED' ORDER BY created_on DESC, job_id"""))
def jobs_list(spark: SparkSession, d: str) -> DataFrame:
    """OP-F03: jobs whose array of sources holds one, in a range of days, with a place in any of two columns."""
    j = frame(spark, d, "jobs").where(F.array_contains(F.split("selected_sources", ","), "view") & F.col("created_on").between("2024-01-05", "2024-02-05") & any_ilike("%brand%", "city", "country") & (F.col("status") != "FAILED"))
    return j.orderBy(F.desc("created_on"), "job_id").select("job_id", "job_name", "status", "selected_sources")


@query(sql("""SELECT bounce_id, b.email, bounce_type, campaign_name, detected_at FROM bounces b JOIN messages m USING (message_id) JOIN campaigns c USING (campaign_id) WHERE bounce_type <> 'unknown' ORDER BY detected_at DESC, bounce_id LIMIT 300"""))
def bounces_list(spark: SparkSession, d: str) -> DataFrame:
    """OP-F05, J03: bounces with message and campaign, newest first."""
    b = frame(spark, d, "bounces").where("bounce_type <> 'unknown'").select("bounce_id", "message_id", "email", "bounce_type", "detected_at")
    m = frame(spark, d, "messages").select("message_id", "campaign_id")
    c = frame(spark, d, "campaigns").select("campaign_id", "campaign_name")
    return b.join(m, "message_id").join(c, "campaign_id").orderBy(F.desc("detected_at"), "bounce_id").limit(300).select("bounce_id", "email", "bounce_type", "campaign_name", "detected_at")


@query(sql("""SELECT suppression_id, email, domain, reason FROM suppressions WHERE lower(email) LIKE '%ada%' OR lower(domain) LIKE '%7.ex%' ORDER BY created_at DESC, suppression_id"""))
def suppressions_search(spark: SparkSession, d: str) -> DataFrame:
    """OP-F06: text in the address or the domain, whatever the case."""
    hit = F.coalesce(F.lower("email").contains("ada"), F.lit(False)) | F.coalesce(F.lower("domain").contains("7.ex"), F.lit(False))
    return frame(spark, d, "suppressions").where(hit).orderBy(F.desc("created_at"), "suppression_id").select("suppression_id", "email", "domain", "reason")


@query(sql("""SELECT validation_id, v.contact_id, k.email, final_status, row_number() OVER (PARTITION BY v.contact_id ORDER BY verified_at DESC, validation_id DESC) AS age FROM checks v JOIN candidates k USING (candidate_id)"""))
def validation_history(spark: SparkSession, d: str) -> DataFrame:
    """OP-F07, J01: the checks of all jobs with their addresses, and each one's place in its contact's history."""
    v = frame(spark, d, "checks").join(frame(spark, d, "candidates").select("candidate_id", "email"), "candidate_id")
    return op.ranked(v, ["contact_id"], [F.desc("verified_at"), F.desc("validation_id")], "age").select("validation_id", "contact_id", "email", "final_status", "age")


@query(sql("""SELECT candidate_id FROM candidates WHERE candidate_id IN (2, 14, 66, 999999999) UNION SELECT candidate_id FROM candidates WHERE contact_id % 50 = 7"""))
def validation_targets(spark: SparkSession, d: str) -> DataFrame:
    """OP-F08: candidates named outright, and those of named contacts; each once."""
    c = frame(spark, d, "candidates")
    return c.where(F.col("candidate_id").isin(2, 14, 66, 999999999)).select("candidate_id").union(c.where("contact_id % 50 = 7").select("candidate_id")).distinct()


@query(sql("""SELECT company_id, coalesce(s, '') AS sources, coalesce(t, '') AS contacts, coalesce(h, '') AS signals FROM companies LEFT JOIN (SELECT company_id, string_agg(source_name || ':' || sighting_id, ',' ORDER BY sighting_id) AS s FROM sightings GROUP BY 1) USING (company_id) LEFT JOIN (SELECT company_id, string_agg(contact_id::VARCHAR, ',' ORDER BY contact_id) AS t FROM contacts GROUP BY 1) USING (company_id) LEFT JOIN (SELECT company_id, string_agg(coalesce(title, source), ',' ORDER BY signal_id) AS h FROM signals GROUP BY 1) USING (company_id)"""))
def company_detail(spark: SparkSession, d: str) -> DataFrame:
    """OP-F09: every company with its three collections, each gathered on its own before it is joined."""

    def gathered(name: str, order: str, value: Column, out: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        return frame(spark, d, name).groupBy("company_id").agg(F.array_join(F.transform(held, lambda x: x["v"]), ",").alias(out))

    out = frame(spark, d, "companies").select("company_id")
    out = out.join(gathered("sightings", "sighting_id", F.concat("source_name", F.lit(":"), "sighting_id"), "sources"), "company_id", "left")
    out = out.join(gathered("contacts", "contact_id", F.col("contact_id").cast("string"), "contacts"), "company_id", "left")
    out = out.join(gathered("signals", "signal_id", F.coalesce("title", "source"), "signals"), "company_id", "left")
    return out.select("company_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("sources", "contacts", "signals")])


@query(sql("""SELECT job_id, 'company' AS kind, company_id AS id, company_name AS label, (row_number() OVER (PARTITION BY job_id ORDER BY created_on, company_id) + 19) // 20 AS page FROM companies UNION ALL SELECT job_id, 'contact', contact_id, coalesce(full_name, email, ''), (row_number() OVER (PARTITION BY job_id ORDER BY created_at, contact_id) + 19) // 20 FROM contacts"""))
def job_results(spark: SparkSession, d: str) -> DataFrame:
    """OP-F10: every job's companies and contacts, in pages of twenty."""
    c = frame(spark, d, "companies").select("job_id", F.lit("company").alias("kind"), F.col("company_id").alias("id"), F.col("company_name").alias("label"), F.col("created_on").cast("timestamp_ntz").alias("at"))
    p = frame(spark, d, "contacts").select("job_id", F.lit("contact").alias("kind"), F.col("contact_id").alias("id"), F.coalesce("full_name", "email", F.lit("")).alias("label"), F.col("created_at").cast("timestamp_ntz").alias("at"))
    placed = op.ranked(c.unionByName(p), ["job_id", "kind"], [F.col("at"), F.col("id")], "place")
    return placed.select("job_id", "kind", "id", "label", F.floor((F.col("place") + 19) / 20).alias("page"))


@query(sql("""SELECT campaign_id, campaign_name, status, user_name AS owner FROM campaigns LEFT JOIN users ON campaign_id % 10 + 1 = user_id WHERE status IN ('sending', 'paused') ORDER BY created_on DESC, campaign_id LIMIT 50"""))
def campaigns_list(spark: SparkSession, d: str) -> DataFrame:
    """OP-F11: campaigns of two states with their owners, newest first."""
    c = frame(spark, d, "campaigns").where(F.col("status").isin("sending", "paused"))
    u = frame(spark, d, "users").select("user_id", F.col("user_name").alias("owner"))
    return c.join(u.where("user_id <= 10"), F.col("campaign_id") % 10 + 1 == F.col("user_id"), "left").orderBy(F.desc("created_on"), "campaign_id").limit(50).select("campaign_id", "campaign_name", "status", "owner")


@query(sql("""SELECT message_id, to_email FROM messages JOIN campaigns c USING (campaign_id) WHERE messages.status = 'queued' AND scheduled_at <= TIMESTAMP '1998-01-01 12:00:00' AND c.status = 'sending'"""))
def due_messages(spark: SparkSession, d: str) -> DataFrame:
    """OP-F13: queued messages due by a given time, of campaigns that send."""
    m = frame(spark, d, "messages").where("status = 'queued' and scheduled_at <= TIMESTAMP_NTZ '1998-01-01 12:00:00'")
    c = frame(spark, d, "campaigns").where("status = 'sending'").select("campaign_id")
    return m.join(c, "campaign_id").select("message_id", "to_email")


@query(sql("""SELECT contact_id FROM contacts WHERE NOT (lower(concat_ws(' ', full_name, designation, role_category, split_part(email, '@', 1))) LIKE '%intern%' OR lower(concat_ws(' ', full_name, designation, role_category, split_part(email, '@', 1))) LIKE '%grace%')"""))
def not_excluded(spark: SparkSession, d: str) -> DataFrame:
    """OP-F14: contacts without any of the keywords in name, designation, role or local part."""
    return frame(spark, d, "contacts").where(~fn.holds_keyword([" Intern", "GRACE ", ""], F.col("full_name"), F.col("designation"), F.col("role_category"), F.substring_index("email", "@", 1))).select("contact_id")


@query(sql("""SELECT job_id, string_agg(s, ',' ORDER BY s) AS unknown FROM (SELECT job_id, unnest(string_split(selected_sources, ',')) AS s FROM jobs) WHERE s NOT IN ('view', 'purchase') GROUP BY job_id"""))
def unknown_sources(spark: SparkSession, d: str) -> DataFrame:
    """OP-F15, U07: jobs that name a source which is not there, and which."""
    left = F.array_sort(F.array_except(F.split("selected_sources", ","), F.array(F.lit("view"), F.lit("purchase"))))
    return frame(spark, d, "jobs").select("job_id", F.array_join(left, ",").alias("unknown")).where("unknown <> ''")


@query(sql("""SELECT contact_id, company_name, k.city, final_email_status FROM contacts c LEFT JOIN companies k USING (company_id) WHERE c.final_email_status IN ('VERIFIED', 'CATCH_ALL_REVIEW') AND k.city = 'NATION_1' AND (lower(company_name) LIKE '%00%' OR lower(coalesce(full_name, '')) LIKE '%ada%') AND confidence >= 0.25"""))
def result_grid(spark: SparkSession, d: str) -> DataFrame:
    """OP-F17: contacts with their companies, by status, city, text and a bound on a figure."""
    k = frame(spark, d, "companies").select("company_id", "company_name", "city")
    c = frame(spark, d, "contacts").where(F.col("final_email_status").isin("VERIFIED", "CATCH_ALL_REVIEW") & (F.col("confidence") >= 0.25))
    text = F.lower("company_name").contains("00") | F.lower(F.coalesce("full_name", F.lit(""))).contains("ada")
    return c.join(k, "company_id", "left").where((F.col("city") == "NATION_1") & text).select("contact_id", "company_name", "city", "final_email_status")


@query(sql("""SELECT c.campaign_id, from_account, count(*) AS messages, count(sent_at) AS sent FROM messages m JOIN campaigns c USING (campaign_id) GROUP BY 1, 2"""))
def campaign_messages(spark: SparkSession, d: str) -> DataFrame:
    """OP-J02: messages with their campaigns; counted before the join."""
    m = frame(spark, d, "messages").groupBy("campaign_id").agg(F.count("*").alias("messages"), F.count("sent_at").alias("sent"))
    return m.join(frame(spark, d, "campaigns").select("campaign_id", "from_account"), "campaign_id")


@query(sql("""SELECT campaign_name, count(*) AS replies, min(received_at) AS first_reply FROM replies JOIN messages USING (message_id) JOIN campaigns USING (campaign_id) GROUP BY 1"""))
def replies_by_campaign(spark: SparkSession, d: str) -> DataFrame:
    """OP-J03: replies with message and campaign."""
    r = frame(spark, d, "replies").join(frame(spark, d, "messages").select("message_id", "campaign_id"), "message_id").groupBy("campaign_id").agg(F.count("*").alias("replies"), F.min("received_at").alias("first_reply"))
    return r.join(frame(spark, d, "campaigns"), "campaign_id").select("campaign_name", "replies", "first_reply")


@query(sql("""SELECT contact_id, company_name, title, source FROM contacts JOIN companies USING (company_id) LEFT JOIN (SELECT company_id, arg_min(coalesce(title, ''), signal_id) AS title, arg_min(source, signal_id) AS source FROM signals GROUP BY 1) USING (company_id)"""))
def first_signal(spark: SparkSession, d: str) -> DataFrame:
    """OP-J09: each contact's company and that company's first hiring signal by id."""
    first = frame(spark, d, "signals").groupBy("company_id").agg(F.min_by(F.struct(F.coalesce("title", F.lit("")).alias("title"), "source"), "signal_id").alias("x")).select("company_id", "x.title", "x.source")
    return frame(spark, d, "contacts").select("contact_id", "company_id").join(frame(spark, d, "companies").select("company_id", "company_name"), "company_id").join(first, "company_id", "left").select("contact_id", "company_name", "title", "source")


#: The employer that a posting names: by turns the company's own name with words around it, its first part, another company's, or none.
EMPLOYER = "CASE signal_id % 5 WHEN 0 THEN '  The ' || upper(company_name) || ' Group' WHEN 1 THEN company_name WHEN 2 THEN replace(company_name, '#', '  # ') WHEN 3 THEN 'Customer' ELSE NULL END"


@query(sql(rf"""SELECT signal_id, company_id FROM (SELECT signal_id, company_id, lower(trim(regexp_replace({EMPLOYER}, '\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(company_name, '\s+', ' ', 'g'))) AS b FROM signals JOIN companies USING (company_id)) WHERE a IS NOT NULL AND b <> '' AND (contains(a, b) OR contains(b, a))"""))
def posting_matches(spark: SparkSession, d: str) -> DataFrame:
    """OP-J11: postings kept for a company whose employer's name holds the company's or is held by it, case and white space aside."""
    k = frame(spark, d, "companies").select("company_id", "company_name")
    rows = frame(spark, d, "signals").join(k, "company_id").withColumn("employer", F.expr(EMPLOYER))
    return rows.where(fn.same_firm(F.col("employer"), F.col("company_name"))).select("signal_id", "company_id")


@query(sql("""SELECT job_id, s AS source_name, coalesce(enabled, s = 'view') AS enabled, coalesce(posture, 'unknown') AS posture FROM (SELECT job_id, unnest(string_split(selected_sources, ',')) AS s FROM jobs) LEFT JOIN (SELECT source_name, min(posture) AS posture, count(*) > 2000 AS enabled FROM runs WHERE source_name <> 'signup' GROUP BY 1) ON s = source_name"""))
def source_settings(spark: SparkSession, d: str) -> DataFrame:
    """OP-J16, I30: selected sources with their settings, which go before the defaults of the source's card."""
    j = frame(spark, d, "jobs").select("job_id", F.explode(F.split("selected_sources", ",")).alias("source_name"))
    settings = frame(spark, d, "runs").where("source_name <> 'signup'").groupBy("source_name").agg(F.min("posture").alias("posture"), (F.count("*") > 2000).alias("enabled"))
    return j.join(settings, "source_name", "left").select("job_id", "source_name", F.coalesce("enabled", F.col("source_name") == "view").alias("enabled"), F.coalesce("posture", F.lit("unknown")).alias("posture"))


@query(sql("""SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM contacts) AS contacts, (SELECT count(*) FROM candidates) AS emails, count(*) FILTER (final_email_status = 'VERIFIED') AS verified, count(*) FILTER (final_email_status IN ('INVALID_SYNTAX', 'PROVIDER_INVALID')) AS invalid, count(*) FILTER (final_email_status IN ('CATCH_ALL_REVIEW', 'UNKNOWN_RETRY')) AS review, count(*) FILTER (sales_ready) AS sales_ready, (SELECT count(sent_at) FROM messages) AS sent, (SELECT count(delivered_at) FROM messages) AS delivered, (SELECT count(opened_at) FROM messages) AS opened, (SELECT count(clicked_at) FROM messages) AS clicked, (SELECT count(replied_at) FROM messages) AS replied, (SELECT count(bounced_at) FROM messages) AS bounced, (SELECT CASE WHEN count(delivered_at) > 0 THEN round(100.0 * count(opened_at) / count(delivered_at), 2) WHEN count(sent_at) > 0 THEN round(100.0 * count(opened_at) / count(sent_at), 2) ELSE 0.0 END FROM messages) AS open_rate, (SELECT count(*) FILTER (status IN ('RUNNING', 'QUEUED')) FROM jobs) AS active_jobs, (SELECT count(*) FILTER (status = 'FAILED') FROM jobs) AS failed_jobs FROM contacts"""))
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """OP-A01, A04: the summary's figures: one aggregate a table, joined as single rows; rates of delivered, else of sent messages."""
    s = F.col("final_email_status")
    contacts = frame(spark, d, "contacts").agg(F.count("*").alias("contacts"), F.count_if(s == "VERIFIED").alias("verified"), F.count_if(s.isin("INVALID_SYNTAX", "PROVIDER_INVALID")).alias("invalid"), F.count_if(s.isin("CATCH_ALL_REVIEW", "UNKNOWN_RETRY")).alias("review"), F.count_if("sales_ready").alias("sales_ready"))
    messages = frame(spark, d, "messages").agg(*[F.count(f"{k}_at").alias(k) for k in ("sent", "delivered", "opened", "clicked", "replied", "bounced")])
    jobs = frame(spark, d, "jobs").agg(F.count_if(F.col("status").isin("RUNNING", "QUEUED")).alias("active_jobs"), F.count_if(F.col("status") == "FAILED").alias("failed_jobs"))
    one = contacts
    for other in (frame(spark, d, "companies").agg(F.count("*").alias("companies")), frame(spark, d, "candidates").agg(F.count("*").alias("emails")), messages, jobs):
        one = one.crossJoin(F.broadcast(other))  # single rows
    return one.withColumn("open_rate", fn.rate(F.col("opened"), F.when(F.col("delivered") > 0, F.col("delivered")).otherwise(F.col("sent"))))


@query(sql("""WITH n AS (SELECT (SELECT count(*) FROM companies) AS a, (SELECT count(*) FROM contacts) AS b, (SELECT count(*) FROM contacts WHERE final_email_status = 'VERIFIED') AS c, (SELECT count(*) FROM contacts WHERE sales_ready) AS d, (SELECT count(sent_at) FROM messages) AS e, (SELECT count(delivered_at) FROM messages) AS f, (SELECT count(*) FROM replies JOIN messages USING (message_id) JOIN campaigns USING (campaign_id)) AS g) SELECT pos, stage, n FROM (SELECT 1 AS pos, 'companies' AS stage, a AS n FROM n UNION ALL SELECT 2, 'contacts', b FROM n UNION ALL SELECT 3, 'verified', c FROM n UNION ALL SELECT 4, 'sales_ready', d FROM n UNION ALL SELECT 5, 'sent', e FROM n UNION ALL SELECT 6, 'delivered', f FROM n UNION ALL SELECT 7, 'replied', g FROM n)""").replace("WITH n AS", "n AS", 1).replace(") n AS (SELECT (", "), n AS (SELECT (", 1))
def full_funnel(spark: SparkSession, d: str) -> DataFrame:
    """OP-A06: all seven stages in their order."""
    contacts = frame(spark, d, "contacts").agg(F.count("*").alias("contacts"), F.count_if(F.col("final_email_status") == "VERIFIED").alias("verified"), F.count_if("sales_ready").alias("sales_ready"))
    messages = frame(spark, d, "messages").agg(F.count("sent_at").alias("sent"), F.count("delivered_at").alias("delivered"))
    replied = frame(spark, d, "replies").join(frame(spark, d, "messages").select("message_id", "campaign_id"), "message_id").join(frame(spark, d, "campaigns").select("campaign_id"), "campaign_id").agg(F.count("*").alias("replied"))
    one = contacts
    for other in (frame(spark, d, "companies").agg(F.count("*").alias("companies")), messages, replied):
        one = one.crossJoin(F.broadcast(other))  # single rows
    stages = ("companies", "contacts", "verified", "sales_ready", "sent", "delivered", "replied")
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("stage"), F.col(s).alias("n")) for i, s in enumerate(stages, 1)])).alias("x")).select("x.*")


@query(sql("""SELECT source_name, posture, count(*) AS runs, sum(found) AS found, sum(imported) AS imported, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1, 2"""))
def source_table(spark: SparkSession, d: str) -> DataFrame:
    """OP-A07: by source and posture."""
    s = F.col("status")
    return frame(spark, d, "runs").groupBy("source_name", "posture").agg(F.count("*").alias("runs"), F.sum("found").alias("found"), F.sum("imported").alias("imported"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"))


@query(sql("""SELECT job_id, source_name, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'skipped') AS skipped, sum(found) AS found, sum(imported) AS imported, sum(found - imported) AS dropped, min(started_at) AS started, max(completed_at) AS completed_at FROM runs GROUP BY 1, 2"""))
def job_activity(spark: SparkSession, d: str) -> DataFrame:
    """OP-A09: of each job and source four counts, three sums, the first start and the last end."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running", "skipped")]
    return frame(spark, d, "runs").groupBy("job_id", "source_name").agg(*counts, F.sum("found").alias("found"), F.sum("imported").alias("imported"), F.sum(F.col("found") - F.col("imported")).alias("dropped"), F.min("started_at").alias("started"), F.max("completed_at").alias("completed_at"))


@query(sql("""SELECT job_id, coalesce(c, 0) AS total_companies, coalesce(t, 0) AS total_contacts, coalesce(v, 0) AS verified_emails, 'kept' AS note FROM jobs LEFT JOIN (SELECT job_id, count(*) AS c FROM companies GROUP BY 1) USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS t, count(*) FILTER (final_email_status = 'VERIFIED') AS v FROM contacts GROUP BY 1) USING (job_id)"""))
def job_totals(spark: SparkSession, d: str) -> DataFrame:
    """OP-A11, S66: a job's new totals merged into its old ones: new keys win, keys that aren't counted stay."""
    c = frame(spark, d, "companies").groupBy("job_id").agg(F.count("*").alias("total_companies"))
    t = frame(spark, d, "contacts").groupBy("job_id").agg(F.count("*").alias("total_contacts"), F.count_if(F.col("final_email_status") == "VERIFIED").alias("verified_emails"))
    joined = frame(spark, d, "jobs").select("job_id").join(c, "job_id", "left").join(t, "job_id", "left")
    names = ("total_companies", "total_contacts", "verified_emails")
    new = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(n, F.lit(0)).cast("string"))])
    old = F.create_map(F.lit("note"), F.lit("kept"), F.lit("total_companies"), F.lit("-1"))
    merged = fn.merge_maps(old, new)
    return joined.select("job_id", *[merged[n].cast("long").alias(n) for n in names], merged["note"].alias("note"))


@query(sql("""SELECT campaign_id, count(*) FILTER (status IN ('sent', 'delivered', 'opened', 'clicked', 'replied')) AS sent, count(*) FILTER (status IN ('delivered', 'opened', 'clicked', 'replied')) AS delivered, count(*) FILTER (status IN ('bounced', 'blocked', 'failed', 'spam')) AS bounced FROM messages GROUP BY 1"""))
def campaign_states(spark: SparkSession, d: str) -> DataFrame:
    """OP-A12: campaign figures from the states of messages; a state counts for all before it."""
    among = lambda *names: F.count_if(F.col("status").isin(*names))
    return frame(spark, d, "messages").groupBy("campaign_id").agg(among("sent", "delivered", "opened", "clicked", "replied").alias("sent"), among("delivered", "opened", "clicked", "replied").alias("delivered"), among("bounced", "blocked", "failed", "spam").alias("bounced"))


@query(sql("""SELECT source_name AS tab, count(*) AS rows, max(completed_at) AS synced_at, count(*) FILTER (completed_at IS NULL) AS pending, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1 UNION ALL SELECT '(all)', count(*), max(completed_at), count(*) FILTER (completed_at IS NULL), count(*) FILTER (status = 'failed') FROM runs"""))
def mirror_status(spark: SparkSession, d: str) -> DataFrame:
    """OP-A14: rows, last sync, pending and failed of each tab, and of all, in one pass by grouping sets."""
    r = frame(spark, d, "runs").rollup("source_name").agg(F.grouping("source_name").alias("g"), F.count("*").alias("rows"), F.max("completed_at").alias("synced_at"), F.count_if(F.col("completed_at").isNull()).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    return r.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("source_name")).alias("tab"), "rows", "synced_at", "pending", "failed")


@query(sql("""SELECT DISTINCT from_account FROM campaigns WHERE status IN ('sending', 'completed')"""))
def active_senders(spark: SparkSession, d: str) -> DataFrame:
    """OP-A17: the accounts that campaigns send from."""
    return frame(spark, d, "campaigns").where(F.col("status").isin("sending", "completed")).select("from_account").distinct()


@query(sql("""SELECT job_id, coalesce(round(avg(latitude), 6), 20.0) AS lat, coalesce(round(avg(longitude), 6), 0.0) AS lng FROM jobs LEFT JOIN companies USING (job_id) GROUP BY 1"""))
def map_centres(spark: SparkSession, d: str) -> DataFrame:
    """OP-A26: the mean place of each job's plotted companies, a fixed one where none is plotted."""
    mean = lambda c, x: F.coalesce(F.round(F.avg(c), 6), F.lit(x)).alias(c[:3])
    out = frame(spark, d, "jobs").select("job_id").join(frame(spark, d, "companies").select("job_id", "latitude", "longitude"), "job_id", "left").groupBy("job_id").agg(mean("latitude", 20.0), mean("longitude", 0.0))
    return out.select("job_id", "lat", F.col("lon").alias("lng"))


@query(sql("""SELECT job_id, created_on AS started, progress, CASE WHEN progress > 0 AND progress < 100 THEN round(3600.0 * (job_id + 1) / (progress / 100.0) - 3600.0 * (job_id + 1), 3) END AS eta_seconds FROM jobs"""))
def job_eta(spark: SparkSession, d: str) -> DataFrame:
    """OP-A27: what is left at the pace so far; null before the start and after the end."""
    elapsed = F.lit(3600.0) * (F.col("job_id") + 1)
    return frame(spark, d, "jobs").select("job_id", F.col("created_on").alias("started"), "progress", fn.remaining(elapsed, F.col("progress")).alias("eta_seconds"))


@query(sql("""SELECT job_id, (count(*) FILTER (email IS NULL) + count(*) FILTER (email IS NOT NULL AND final_email_status = 'INVALID_SYNTAX') + count(*) FILTER (email IS NOT NULL AND final_email_status = 'PROVIDER_INVALID'))::BIGINT AS excluded FROM contacts GROUP BY 1"""))
def excluded_total(spark: SparkSession, d: str) -> DataFrame:
    """OP-A28: the sum over a map of reasons and their counts."""
    reason = F.when(F.col("email").isNull(), "no_email").when(F.col("final_email_status") == "INVALID_SYNTAX", "syntax").when(F.col("final_email_status") == "PROVIDER_INVALID", "provider")
    counted = frame(spark, d, "contacts").select("job_id", reason.alias("reason")).groupBy("job_id", "reason").agg(F.count("*").alias("n"))
    held = counted.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("m"))
    return held.select("job_id", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("excluded"))


@query(sql("""SELECT job_id, string_agg(DISTINCT city, ',' ORDER BY city) AS cities, string_agg(DISTINCT CASE WHEN domain LIKE '%nation-1%' THEN 'website' WHEN domain IS NULL THEN 'directory' ELSE 'maps' END, ',' ORDER BY CASE WHEN domain LIKE '%nation-1%' THEN 'website' WHEN domain IS NULL THEN 'directory' ELSE 'maps' END) AS sources FROM companies GROUP BY 1"""))
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    """OP-A29: the distinct cities and coarse sources that a job's results can be filtered by."""
    source = F.when(F.col("domain").contains("nation-1"), "website").when(F.col("domain").isNull(), "directory").otherwise("maps")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return frame(spark, d, "companies").groupBy("job_id").agg(listed("city").alias("cities"), listed(source).alias("sources"))


@query(sql("""SELECT company_id, contact_id, rank FROM (SELECT company_id, contact_id, row_number() OVER (PARTITION BY company_id ORDER BY primary_contact DESC, confidence DESC, CASE role_category WHEN 'hr' THEN 3 WHEN 'technology' THEN 2 WHEN 'sales' THEN 1 ELSE 0 END DESC, company_fit DESC, source_confidence DESC, created_at DESC, contact_id) AS rank FROM contacts LEFT JOIN (SELECT company_id, CASE WHEN industry IS NULL THEN 0 ELSE 1 END AS company_fit FROM companies) USING (company_id) LEFT JOIN (SELECT company_id, count(*) AS source_confidence FROM sightings GROUP BY 1) USING (company_id)) WHERE rank <= 15"""))
def lead_ranks(spark: SparkSession, d: str) -> DataFrame:
    """OP-W01, W03: all six parts of the rank key, each descending, and the best fifteen of each company."""
    relevance = F.when(F.col("role_category") == "hr", 3).when(F.col("role_category") == "technology", 2).when(F.col("role_category") == "sales", 1).otherwise(0)
    fit = frame(spark, d, "companies").select("company_id", F.when(F.col("industry").isNull(), 0).otherwise(1).alias("company_fit"))
    seen = frame(spark, d, "sightings").groupBy("company_id").agg(F.count("*").alias("source_confidence"))
    rows = frame(spark, d, "contacts").join(fit, "company_id", "left").join(seen, "company_id", "left")
    order = [F.desc("primary_contact"), F.desc("confidence"), relevance.desc(), F.desc("company_fit"), F.desc_nulls_first("source_confidence"), F.desc("created_at"), F.col("contact_id")]
    return op.top_by(rows, ["company_id"], order, 15).select("company_id", "contact_id", F.col("rank").cast("long").alias("rank"))


@query(sql("""SELECT company_id, contact_id FROM (SELECT c.company_id, contact_id, coalesce(held, 0) AS held, row_number() OVER (PARTITION BY c.company_id ORDER BY full_name IS NOT NULL DESC, confidence DESC, contact_id) AS r FROM contacts c LEFT JOIN (SELECT company_id, count(*) AS held FROM contacts WHERE contact_id % 2 = 0 GROUP BY 1) h ON c.company_id = h.company_id WHERE contact_id % 2 = 1) WHERE r <= 15 - held"""))
def capped_contacts(spark: SparkSession, d: str) -> DataFrame:
    """OP-W04: of the new contacts of a company as many of the best as its cap leaves beside those it has."""
    every = frame(spark, d, "contacts")
    held = every.where("contact_id % 2 = 0").groupBy("company_id").agg(F.count("*").alias("held"))
    new = op.ranked(every.where("contact_id % 2 = 1").join(held, "company_id", "left"), ["company_id"], [F.col("full_name").isNotNull().desc(), F.desc("confidence"), F.col("contact_id")], "r")
    return new.where(F.col("r") <= 15 - F.coalesce("held", F.lit(0))).select("company_id", "contact_id")


@query(sql("""SELECT campaign_id, campaign_name, created_on FROM campaigns ORDER BY created_on, campaign_id"""))
def campaign_order(spark: SparkSession, d: str) -> DataFrame:
    """OP-W10: campaigns in the order of their making."""
    return frame(spark, d, "campaigns").orderBy("created_on", "campaign_id").select("campaign_id", "campaign_name", "created_on")


@query(sql("""SELECT company_id, recovered FROM (SELECT company_id, domain IS NOT NULL AS recovered FROM companies WHERE website_status = 'unreachable' ORDER BY company_id LIMIT 60)"""))
def second_pass(spark: SparkSession, d: str) -> DataFrame:
    """OP-L03, M24: the unreachable companies that a second crawl tries, sixty at most, and which it recovers."""
    return frame(spark, d, "companies").where("website_status = 'unreachable'").orderBy("company_id").limit(60).select("company_id", F.col("domain").isNotNull().alias("recovered"))


@query(sql("""WITH_ n AS (SELECT bounce_id AS notice_id, CASE WHEN message_id % 3 = 0 THEN message_id WHEN message_id % 3 = 2 AND message_id % 5 = 0 THEN -message_id END AS ref, CASE WHEN message_id % 3 = 1 THEN 'g' || message_id END AS gmail, upper(email) AS email, detected_at AS seen_at FROM bounces), m AS (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'g' || message_id END AS gmail_id, lower(to_email) AS t, sent_at FROM messages), r AS (SELECT n.*, (SELECT max(message_id) FROM m WHERE m.message_id = n.ref) AS a, (SELECT max(message_id) FROM m WHERE gmail_id = n.gmail) AS b FROM n), k AS (SELECT r.notice_id, arg_max(m.message_id, (m.sent_at, m.message_id)) AS c FROM r JOIN m ON m.t = lower(r.email) AND m.sent_at <= r.seen_at AND m.sent_at > r.seen_at - INTERVAL 3 DAY GROUP BY 1) SELECT notice_id, coalesce(a, b, c) AS message_id, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS tier FROM r LEFT JOIN k USING (notice_id)""").replace(" WITH_ n AS", ", n AS"))
def notice_matches(spark: SparkSession, d: str) -> DataFrame:
    """OP-J10: the message of each notice by reference, by the mail system's id, or by address and time, in this order."""
    k = F.col("message_id")
    notices = frame(spark, d, "bounces").select(F.col("bounce_id").alias("notice_id"), F.when(k % 3 == 0, k).when((k % 3 == 2) & (k % 5 == 0), -k).alias("ref"), F.when(k % 3 == 1, F.concat(F.lit("g"), k)).alias("gmail"), F.upper("email").alias("email"), F.col("detected_at").alias("seen_at"))
    messages = frame(spark, d, "messages").select("message_id", F.when(k % 2 == 0, F.concat(F.lit("g"), k)).alias("gmail_id"), "to_email", "sent_at")
    return op.match_notices(notices, messages)


@query(sql("""SELECT key, seen, source_name, coalesce(urls, '') AS urls, CASE level WHEN 2 THEN 'red' WHEN 1 THEN 'amber' ELSE 'green' END AS posture, sightings, CASE WHEN sightings > 1 THEN 'merged' ELSE 'unique' END AS dedupe_status FROM (SELECT coalesce('k' || key, 'r' || sighting_id) AS g, any_value(key) AS key, min(sighting_id) AS seen, arg_min(source_name, sighting_id) AS source_name, max(CASE posture WHEN 'red' THEN 2 WHEN 'amber' THEN 1 ELSE 0 END) AS level, count(*) AS sightings FROM (SELECT *, CASE WHEN company_id % 10 <> 0 THEN 'id:' || company_id END AS key FROM sightings) GROUP BY 1) LEFT JOIN (SELECT g, string_agg(source_url, ',' ORDER BY o) AS urls FROM (SELECT CASE WHEN company_id % 10 <> 0 THEN 'kid:' || company_id ELSE 'r' || sighting_id END AS g, source_url, min(sighting_id) AS o FROM sightings WHERE source_url IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (g)"""))
def company_upsert(spark: SparkSession, d: str) -> DataFrame:
    """OP-M01, U01, U02, A15, A19: the sightings of all sources merged; the first one's values stay, addresses keep the order they were seen in."""
    s = frame(spark, d, "sightings")
    by_source = [s.where(F.col("source_name") == n) for n in ("view", "click", "purchase")] + [s.where(~F.col("source_name").isin("view", "click", "purchase"))]
    every = by_source[0]
    for other in by_source[1:]:
        every = every.unionByName(other)
    rows = every.select(F.when(F.col("company_id") % 10 != 0, F.concat(F.lit("id:"), "company_id")).alias("key"), F.col("sighting_id").alias("seen"), "source_name", "source_url", "posture")
    return op.upsert(rows, "key", "seen", ["source_name"], "source_url", "posture")
