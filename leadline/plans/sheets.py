"""The tabs of the mirrored sheet, each a projection of the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.model import frame, sql
from leadline.plans.registry import query
from leadline.sources import sheets
from leadline.sources.sheets import Tab


def text(e: str) -> str:
    """SQL of a whole number, a word or a truth value as a cell."""
    return f"coalesce(cast({e} AS VARCHAR), '')"


def moment(e: str) -> str:
    return f"coalesce(strftime({e}, '%Y-%m-%dT%H:%M:%S'), '')"


def real(e: str) -> str:
    return f"coalesce(CASE WHEN {e} = floor({e}) THEN cast(cast({e} AS BIGINT) AS VARCHAR) ELSE cast({e} AS VARCHAR) END, '')"


def oracle(tab: str, cells: dict[str, str], source: str) -> str:
    """SELECT of a tab's columns: those given, '' for the others."""
    return sql("SELECT " + ", ".join(f"{cells.get(c, chr(39) * 2)} AS {c}" for c in Tab(tab).columns) + f" FROM {source}")


COUNTS = "LEFT JOIN (SELECT job_id, count(*) AS tc FROM companies GROUP BY 1) USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS tt, count(*) FILTER (final_email_status = 'VERIFIED') AS tv FROM contacts GROUP BY 1) USING (job_id)"


@query(oracle("Mining_Jobs", {**{c: text(c) for c in ("job_id", "job_name", "created_by", "status", "company_type", "country", "city")}, "created_at": text("created_on"), "radius_km": real("radius_km"), "company_size": "CASE WHEN size_min IS NULL AND size_max IS NULL THEN '' ELSE coalesce(size_min::VARCHAR, '') || '-' || coalesce(size_max::VARCHAR, '') END", "selected_sources": "array_to_string(list_sort(string_split(selected_sources, ',')), ', ')", "total_companies": "coalesce(tc, 0)::VARCHAR", "total_contacts": "coalesce(tt, 0)::VARCHAR", "verified_emails": "coalesce(tv, 0)::VARCHAR", "invalid_emails": "'0'", "review_emails": "'0'", "sales_ready_count": "'0'"}, f"jobs {COUNTS}"))
def tab_jobs(spark: SparkSession, d: str) -> DataFrame:
    """OP-P04: sizes as a range if either end is set, totals with 0 where a job has none."""
    c = frame(spark, d, "companies").groupBy("job_id").agg(F.count("*").alias("total_companies"))
    t = frame(spark, d, "contacts").groupBy("job_id").agg(F.count("*").alias("total_contacts"), F.count_if(F.col("final_email_status") == "VERIFIED").alias("verified_emails"))
    j = frame(spark, d, "jobs").withColumnRenamed("created_on", "created_at").join(c, "job_id", "left").join(t, "job_id", "left")
    end = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    size = F.when(F.col("size_min").isNotNull() | F.col("size_max").isNotNull(), F.concat(end("size_min"), F.lit("-"), end("size_max")))
    zeros = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("total_companies", "total_contacts", "verified_emails")} | {n: F.lit(0) for n in ("invalid_emails", "review_emails", "sales_ready_count")}
    return Tab("Mining_Jobs").cells(j.withColumns({"company_size": size, "selected_sources": F.array_sort(F.split("selected_sources", ",")), **zeros}))


@query(oracle("Companies", {**{c: text(c) for c in ("company_id", "job_id", "company_name", "domain", "phone", "city", "industry", "website_status")}, "website": text("'https://' || domain"), "latitude": real("latitude"), "longitude": real("longitude"), "source_names": "coalesce(sn, '')", "source_urls": "coalesce(su, '')", "compliance_posture": text("posture"), "last_refreshed_at": moment("last_seen")}, "companies LEFT JOIN (SELECT company_id, string_agg(DISTINCT source_name, ', ' ORDER BY source_name) AS sn, string_agg(DISTINCT source_url, ', ' ORDER BY source_url) AS su, max(seen_at) AS last_seen FROM sightings GROUP BY 1) USING (company_id)"))
def tab_companies(spark: SparkSession, d: str) -> DataFrame:
    """OP-P05: with the sorted distinct names and the addresses of a company's sightings."""
    s = frame(spark, d, "sightings").groupBy("company_id").agg(F.array_sort(F.collect_set("source_name")).alias("source_names"), F.array_sort(F.collect_set("source_url")).alias("source_urls"), F.max("seen_at").alias("last_refreshed_at"))
    c = frame(spark, d, "companies").join(s, "company_id", "left").withColumnRenamed("posture", "compliance_posture")
    return Tab("Companies").cells(c.withColumn("website", F.concat(F.lit("https://"), "domain")))


@query(oracle("Contacts", {**{c: text(c) for c in ("contact_id", "company_id", "job_id", "first_name", "last_name", "designation", "seniority", "role_category", "email", "phone", "primary_contact", "final_email_status", "sales_ready")}, "contact_name": text("full_name"), "confidence_score": real("confidence"), "last_verified_at": moment("created_at")}, "contacts"))
def tab_contacts(spark: SparkSession, d: str) -> DataFrame:
    """OP-P06, P01, P03: every column of the tab as cells."""
    return Tab("Contacts").cells(frame(spark, d, "contacts").withColumnsRenamed({"full_name": "contact_name", "confidence": "confidence_score", "created_at": "last_verified_at"}))


@query(oracle("Email_Validation", {**{c: text(c) for c in ("validation_id", "contact_id", "company_id", "final_status", "retry_count")}, "email": text("email"), "verified_at": moment("verified_at")}, "checks LEFT JOIN (SELECT candidate_id, email FROM candidates) USING (candidate_id)"))
def tab_validation(spark: SparkSession, d: str) -> DataFrame:
    """OP-P07: checks of the tenant's contacts with the address that was checked."""
    v = frame(spark, d, "checks").join(frame(spark, d, "contacts").select("contact_id"), "contact_id")
    return Tab("Email_Validation").cells(v.join(frame(spark, d, "candidates").select("candidate_id", "email"), "candidate_id", "left"))


@query(oracle("Sales_Ready_Leads", {**{c: text(c) for c in ("job_id", "company_name", "email", "phone", "validation_status")}, "sales_lead_id": text("lead_id"), "contact_name": text("full_name"), "confidence_score": real("confidence"), "last_verified_at": moment("created_at")}, "leads WHERE NOT tombstoned AND validation_status = 'VERIFIED'"))
def tab_leads(spark: SparkSession, d: str) -> DataFrame:
    """OP-P08: verified leads that aren't tombstoned."""
    leads = frame(spark, d, "leads").where(~F.col("tombstoned") & (F.col("validation_status") == "VERIFIED"))
    return Tab("Sales_Ready_Leads").cells(leads.withColumnsRenamed({"lead_id": "sales_lead_id", "full_name": "contact_name", "confidence": "confidence_score", "created_at": "last_verified_at"}))


@query(oracle("Outreach_Queue", {"queue_id": text("message_id"), "campaign_id": text("campaign_id"), "contact_id": text("contact_id"), "email": text("to_email"), "send_status": text("m.status"), **{c: moment(c) for c in ("scheduled_at", "sent_at", "opened_at", "clicked_at", "replied_at")}, "bounce_status": "CASE WHEN bounced_at IS NOT NULL THEN 'bounced' ELSE '' END"}, "messages m JOIN (SELECT campaign_id FROM campaigns) USING (campaign_id)"))
def tab_outreach(spark: SparkSession, d: str) -> DataFrame:
    """OP-P09: messages of the tenant's campaigns; bounced where a bounce has a time."""
    m = frame(spark, d, "messages").join(frame(spark, d, "campaigns").select("campaign_id"), "campaign_id")
    return Tab("Outreach_Queue").cells(m.withColumn("bounce_status", F.when(F.col("bounced_at").isNotNull(), "bounced")).withColumnsRenamed({"message_id": "queue_id", "to_email": "email", "status": "send_status"}))


MADE = ("sent", "delivered", "opened", "clicked", "replied", "bounced")
NAMED = {"opened": "open_count", "clicked": "click_count", "replied": "reply_count", "bounced": "bounce_count", "sent": "sent_count", "delivered": "delivered_count"}


@query(oracle("Campaigns", {**{c: text(c) for c in ("campaign_id", "campaign_name", "job_id", "from_account", "status")}, "recipient_count": "coalesce(n, 0)::VARCHAR", **{NAMED[k]: f"coalesce(n_{k}, 0)::VARCHAR" for k in MADE}, "started_at": text("created_on"), "completed_at": "CASE WHEN status = 'completed' THEN (created_on + 30)::VARCHAR ELSE '' END"}, "campaigns LEFT JOIN (SELECT campaign_id, count(*) AS n, " + ", ".join(f"count({k}_at) AS n_{k}" for k in MADE) + " FROM messages GROUP BY 1) USING (campaign_id)"))
def tab_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """OP-P10, A03: counts of messages and of their times; an end only where the campaign is completed."""
    m = frame(spark, d, "messages").groupBy("campaign_id").agg(F.count("*").alias("recipient_count"), *[F.count(f"{k}_at").alias(NAMED[k]) for k in MADE])
    c = frame(spark, d, "campaigns").join(m, "campaign_id", "left").fillna(0, ["recipient_count", *NAMED.values()])
    return Tab("Campaigns").cells(c.withColumn("completed_at", F.when(F.col("status") == "completed", F.date_add("created_on", 30))).withColumnRenamed("created_on", "started_at"))


@query(oracle("Bounce_Log", {"bounce_id": text("bounce_id"), "campaign_id": text("campaign_id"), "contact_id": text("b.contact_id"), "email": text("b.email"), "bounce_type": text("bounce_type"), "detected_at": moment("detected_at"), "action_taken": "CASE WHEN bounce_type = 'hard' THEN 'suppressed' ELSE 'flagged' END"}, "bounces b JOIN messages USING (message_id) JOIN (SELECT campaign_id FROM campaigns) USING (campaign_id)"))
def tab_bounces(spark: SparkSession, d: str) -> DataFrame:
    """OP-P11: bounces over their messages' campaigns; only hard ones suppress."""
    b = frame(spark, d, "bounces").join(frame(spark, d, "messages").select("message_id", "campaign_id"), "message_id").join(frame(spark, d, "campaigns").select("campaign_id"), "campaign_id")
    return Tab("Bounce_Log").cells(b.withColumn("action_taken", F.when(F.col("bounce_type") == "hard", "suppressed").otherwise("flagged")))


@query(oracle("Suppression_List", {"email": "coalesce(nullif(email, ''), '@' || nullif(domain, ''), suppression_id::VARCHAR)", "domain": text("domain"), "reason": text("reason"), "suppressed_at": moment("created_at"), "permanent": text("permanent")}, "suppressions"))
def tab_suppressions(spark: SparkSession, d: str) -> DataFrame:
    """OP-P12: keyed by address, else @domain, else id."""
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    s = frame(spark, d, "suppressions").withColumn("email", F.coalesce(none("email"), F.concat(F.lit("@"), none("domain")), F.col("suppression_id").cast("string")))
    return Tab("Suppression_List").cells(s.withColumnRenamed("created_at", "suppressed_at"))


@query(oracle("Data_Source_Audit", {"event_id": text("run_id"), "job_id": text("job_id"), "source_name": text("source_name"), "compliance_posture": text("posture"), "status": text("status"), "records_found": text("found"), "created_at": moment("started_at")}, "runs"))
def tab_audit(spark: SparkSession, d: str) -> DataFrame:
    """OP-P13, K10: one row for every touch of a source."""
    return Tab("Data_Source_Audit").cells(frame(spark, d, "runs").withColumnsRenamed({"run_id": "event_id", "posture": "compliance_posture", "found": "records_found", "started_at": "created_at"}))


@query("""SELECT event_id::VARCHAR AS audit_id, user_id::VARCHAR AS actor, event_type AS action, 'event' AS entity_type, event_id::VARCHAR AS entity_id, '' AS before_value, coalesce(props, '') AS after_value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events""")
def tab_audit_log(spark: SparkSession, d: str) -> DataFrame:
    """OP-P14: who did what to what, and its value after."""
    e = frame(spark, d, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.lit("event").alias("entity_type"), F.col("event_id").alias("entity_id"), F.col("props").alias("after_value"), F.col("ts").alias("created_at"))
    return Tab("Audit_Log").cells(e)


#: The table behind each tab.
BEHIND = {"Mining_Jobs": "jobs", "Companies": "companies", "Contacts": "contacts", "Email_Validation": "checks", "Sales_Ready_Leads": "leads", "Outreach_Queue": "messages", "Campaigns": "campaigns", "Bounce_Log": "bounces", "Suppression_List": "suppressions", "Data_Source_Audit": "runs", "Audit_Log": "events"}


@query(sql(" UNION ALL ".join(f"SELECT '{t.name}' AS tab, '{t.key}' AS key_column, '{', '.join(t.editable) or '(none)'}' AS editable_columns, '{', '.join(t.columns)}' AS columns, (SELECT count(*) FROM {BEHIND[t.name]}) || ' rows' AS notes" for t in map(Tab, list(sheets.TABS)[1:]))))
def tab_readme(spark: SparkSession, d: str) -> DataFrame:
    """OP-P15, U04: the registry as a tab of its own, with the rows that each tab has now."""
    counts = [frame(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), F.concat("n", F.lit(" rows")).alias("said")) for name, t in BEHIND.items()]
    said = counts[0]
    for c in counts[1:]:
        said = said.union(c)
    return sheets.readme(spark).drop("notes").join(said, "tab").withColumnRenamed("said", "notes")


@query(sql("""SELECT CASE WHEN a.k IS NULL THEN 'append' WHEN b.k IS NULL THEN 'delete' WHEN a.v IS DISTINCT FROM b.v THEN 'update' ELSE 'skip' END AS action, count(*) AS n FROM (SELECT contact_id AS k, concat_ws('|', full_name, email) AS v FROM contacts WHERE contact_id % 7 <> 1) a FULL JOIN (SELECT contact_id AS k, concat_ws('|', full_name, CASE WHEN contact_id % 10 = 3 THEN upper(email) ELSE email END) AS v FROM contacts WHERE contact_id % 9 <> 2) b ON a.k = b.k GROUP BY 1"""))
def tab_sync(spark: SparkSession, d: str) -> DataFrame:
    """OP-P02, M08, S62: digests of the system columns; what sales wrote changes nothing."""
    from leadline import operators as op

    tab, c = Tab("Contacts"), frame(spark, d, "contacts").withColumnRenamed("full_name", "contact_name")
    old = tab.content(c.where("contact_id % 7 <> 1").withColumn("owner", F.lit("ada")))
    new = tab.content(c.where("contact_id % 9 <> 2").withColumn("email", F.when(F.col("contact_id") % 10 == 3, F.upper("email")).otherwise(F.col("email"))).withColumn("owner", F.lit("grace")))
    return op.snapshot_diff(old, new, "key", "digest").groupBy("action").agg(F.count("*").alias("n"))


@query(sql("""SELECT row_number() OVER (ORDER BY was NULLS LAST, campaign_id) + 1 AS row, campaign_id::VARCHAR AS campaign_id, campaign_name, status FROM campaigns LEFT JOIN (SELECT campaign_id, 100 - campaign_id AS was FROM campaigns WHERE campaign_id % 3 <> 0) USING (campaign_id) WHERE campaign_id % 4 <> 1"""))
def tab_mirror(spark: SparkSession, d: str) -> DataFrame:
    """OP-K06: rows that stay keep their order, later ones move up, new ones follow."""
    tab, c = Tab("Campaigns"), frame(spark, d, "campaigns")
    old = tab.cells(c.where("campaign_id % 3 <> 0")).withColumn("row", 100 - F.col("campaign_id").cast("long"))
    return sheets.mirrored(old, c.where("campaign_id % 4 <> 1"), tab).select("row", "campaign_id", "campaign_name", "status")


@query(sql("""SELECT status, count(*) AS n, CASE status WHEN 'bounced' THEN 'F4CCCC' WHEN 'queued' THEN 'EFEFEF' WHEN 'replied' THEN 'D9EAD3' WHEN 'delivered' THEN 'D9EAD3' ELSE 'CFE2F3' END AS colour FROM messages GROUP BY 1"""))
def tab_colours(spark: SparkSession, d: str) -> DataFrame:
    """OP-K07: the colour of each state."""
    return frame(spark, d, "messages").groupBy("status").agg(F.count("*").alias("n")).withColumn("colour", sheets.colour(F.col("status")))
