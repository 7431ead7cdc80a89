"""The lead pipeline's tables, derived by rule from the driver's tables: every row and column of them, in one place.

A table's rule is one SELECT that Spark and DuckDB read alike; `{name}` stands for a driver's or another derived table.
Queries in `leadline.plans` are DataFrame code over these tables, their SQL is written on its own over the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leadline.sources import table
from leadline.sources.shared import written

RULES = {
    "companies": """SELECT c_custkey AS company_id, 1 + cast(floor(c_custkey / 3) AS bigint) AS job_id, c_name AS company_name,
        CASE WHEN c_custkey % 7 <> 0 THEN lower(replace(replace(n_name, ' ', '-'), '_', '-')) || cast(c_custkey AS string) || '.example.com' END AS domain,
        CASE WHEN c_custkey % 3 = 0 THEN '+1555' || lpad(cast(c_custkey % 10000000 AS string), 7, '0') END AS phone,
        n_name AS city, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS industry,
        CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 37 % 18000) / 100e0 - 90 END AS latitude,
        CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 53 % 36000) / 100e0 - 180 END AS longitude,
        CASE c_nationkey % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' ELSE 'red' END AS posture,
        CASE WHEN c_acctbal > 5000 THEN 'live' WHEN c_acctbal > 0 THEN 'redirected' ELSE 'unreachable' END AS website_status,
        DATE '2024-01-01' + cast(c_custkey % 300 AS int) AS created_on
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "people": """SELECT o_orderkey AS contact_id, o_custkey AS company_id, o_orderdate AS created_at, o_orderpriority AS priority,
        CASE o_orderkey % 7 WHEN 0 THEN 'Ada' WHEN 1 THEN 'Grace' WHEN 2 THEN 'Alan' WHEN 3 THEN 'Edsger' WHEN 4 THEN 'Barbara' WHEN 5 THEN 'Ken' ELSE 'Niklaus' END AS first_name,
        CASE o_custkey % 5 WHEN 0 THEN 'Lovelace' WHEN 1 THEN 'Hopper' WHEN 2 THEN 'Turing' WHEN 3 THEN 'Liskov' ELSE 'Wirth' END AS last_name
        FROM {orders}""",
    "contacts": """SELECT contact_id, c.company_id, c.job_id, first_name, last_name,
        CASE WHEN contact_id % 13 <> 0 THEN first_name || ' ' || last_name END AS full_name,
        CASE substr(priority, 1, 1) WHEN '1' THEN 'Chief Technology Officer' WHEN '2' THEN 'Sales Manager' WHEN '3' THEN 'HR Executive' WHEN '5' THEN 'Software Intern' END AS designation,
        CASE substr(priority, 1, 1) WHEN '1' THEN 'executive' WHEN '2' THEN 'manager' WHEN '3' THEN 'staff' END AS seniority,
        CASE substr(priority, 1, 1) WHEN '1' THEN 'technology' WHEN '2' THEN 'sales' WHEN '3' THEN 'hr' END AS role_category,
        CASE WHEN contact_id % 11 = 0 THEN NULL WHEN contact_id % 17 = 0 THEN 'info@' || coalesce(domain, 'mail.example.org') ELSE lower(first_name) || '.' || cast(contact_id AS string) || '@' || coalesce(domain, 'mail.example.org') END AS email,
        CASE WHEN contact_id % 6 = 0 THEN '+4420' || lpad(cast(contact_id % 100000000 AS string), 8, '0') END AS phone,
        (contact_id % 100) / 100e0 AS confidence, contact_id % 4 = 1 AS primary_contact,
        CASE contact_id % 9 WHEN 0 THEN 'INVALID_SYNTAX' WHEN 1 THEN 'PROVIDER_INVALID' WHEN 2 THEN 'CATCH_ALL_REVIEW' WHEN 3 THEN 'UNKNOWN_RETRY' WHEN 4 THEN NULL ELSE 'VERIFIED' END AS final_email_status,
        contact_id % 9 >= 5 AND contact_id % 2 = 0 AS sales_ready, created_at
        FROM {people} p JOIN {companies} c ON p.company_id = c.company_id""",
    "candidates": """SELECT contact_id * 2 AS candidate_id, contact_id, lower(email) AS email, 'page' AS source FROM {contacts} WHERE email IS NOT NULL
        UNION ALL SELECT contact_id * 2 + 1, contact_id, lower(first_name) || '.' || lower(last_name) || substr(email, position('@' IN email), 200), 'pattern' FROM {contacts} WHERE email IS NOT NULL AND contact_id % 5 = 0""",
    "addresses": """SELECT candidate_id, contact_id, CASE candidate_id % 19 WHEN 0 THEN replace(email, '@', '@@') WHEN 1 THEN replace(email, '@', ' at ') WHEN 2 THEN email || '.' WHEN 3 THEN substr(email, 1, position('@' IN email)) || 'Mailinator.COM'
        WHEN 4 THEN substr(email, 1, position('@' IN email)) || 'corp.throw.example' WHEN 5 THEN ' Sales.Team+eu' || substr(email, position('@' IN email), 200) || ' ' WHEN 6 THEN substr(email, 1, position('@' IN email)) || 'host.localhost' WHEN 7 THEN '.' || email
        WHEN 8 THEN substr(email, 1, position('@' IN email)) || 'yopmail.com' WHEN 9 THEN upper(email) WHEN 10 THEN '  ' WHEN 11 THEN replace(email, '.', '..') WHEN 12 THEN 'jürgen' || email WHEN 13 THEN 'info' || substr(email, position('@' IN email), 200) ELSE email END AS raw FROM {candidates}""",
    "checks": """SELECT candidate_id AS validation_id, k.contact_id, c.company_id, c.job_id, candidate_id, CASE WHEN candidate_id % 3 = 0 THEN final_email_status ELSE 'VERIFIED' END AS final_status,
        candidate_id % 4 AS retry_count, created_at AS verified_at FROM {candidates} k JOIN {contacts} c ON k.contact_id = c.contact_id""",
    "users": "SELECT s_suppkey AS user_id, s_name AS user_name, s_suppkey % 3 = 0 AS is_admin FROM {supplier}",
    "jobs": """SELECT p_partkey AS job_id, p_name AS job_name, p_type AS company_type, p_partkey % 10 + 1 AS created_by, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS city,
        CASE p_partkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'India' WHEN 2 THEN 'France' END AS country, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS size_min, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 10 END AS size_max,
        CASE p_partkey % 3 WHEN 0 THEN 'click,view' WHEN 1 THEN 'view' ELSE 'purchase,signup,view' END AS selected_sources,
        CASE p_partkey % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'QUEUED' ELSE 'COMPLETED' END AS status, p_retailprice AS radius_km, p_partkey % 101 AS progress,
        DATE '2024-01-01' + cast(p_partkey % 3650 AS int) AS created_on FROM {part}""",
    "campaigns": """SELECT n_nationkey AS campaign_id, n_name AS campaign_name, n_nationkey % 40 AS job_id, 'sender' || cast(n_regionkey AS string) || '@example.com' AS from_account,
        CASE n_nationkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'sending' WHEN 2 THEN 'paused' ELSE 'completed' END AS status, DATE '2024-02-01' + n_nationkey AS created_on FROM {nation}""",
    "sends": """SELECT l_orderkey * 10 + l_linenumber AS message_id, l_orderkey AS contact_id, l_suppkey % 25 AS campaign_id, l_shipdate AS due_at, l_linenumber AS line,
        CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'bounced' WHEN l_returnflag = 'R' THEN 'replied' WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 'opened' WHEN l_linestatus = 'F' THEN 'delivered' WHEN l_quantity > 25 THEN 'sent' ELSE 'queued' END AS status
        FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, max(l_discount) AS l_discount, max(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber)""",
    "messages": """SELECT message_id, s.contact_id, campaign_id, email AS to_email, s.status, due_at AS scheduled_at, CASE WHEN s.status <> 'queued' THEN due_at END AS sent_at,
        CASE WHEN s.status IN ('delivered', 'opened', 'replied') THEN due_at + INTERVAL '3' HOUR END AS delivered_at, CASE WHEN s.status = 'opened' OR (s.status = 'replied' AND line % 3 = 0) THEN due_at + INTERVAL '5' HOUR END AS opened_at,
        CASE WHEN s.status = 'opened' AND line % 2 = 0 THEN due_at + INTERVAL '6' HOUR END AS clicked_at, CASE WHEN s.status = 'replied' THEN due_at + INTERVAL '1' DAY END AS replied_at, CASE WHEN s.status = 'bounced' THEN due_at + INTERVAL '1' HOUR END AS bounced_at
        FROM {sends} s JOIN {contacts} c ON s.contact_id = c.contact_id WHERE email IS NOT NULL""",
    "bounces": """SELECT message_id * 3 AS bounce_id, message_id, contact_id, to_email AS email, CASE message_id % 5 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' WHEN 2 THEN 'mailbox_full' WHEN 3 THEN 'spam_rejected' ELSE 'unknown' END AS bounce_type,
        bounced_at AS detected_at FROM {messages} WHERE bounced_at IS NOT NULL""",
    "replies": "SELECT message_id * 7 AS reply_id, message_id, replied_at AS received_at FROM {messages} WHERE replied_at IS NOT NULL",
    "suppressions": """SELECT contact_id AS suppression_id, CASE WHEN contact_id % 3 <> 0 THEN upper(email) END AS email, CASE WHEN contact_id % 2 = 0 AND email IS NOT NULL THEN substr(email, position('@' IN email) + 1, 200) END AS domain,
        CASE contact_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'hard_bounce' ELSE 'unsubscribe' END AS reason, contact_id % 2 = 0 AS permanent, created_at FROM {contacts} WHERE contact_id % 29 = 0""",
    "sightings": """SELECT event_id AS sighting_id, user_id AS company_id, event_type AS source_name, CASE WHEN event_id % 4 <> 0 THEN 'https://' || event_type || '.example.com/' || cast(user_id % 5 AS string) END AS source_url,
        CASE event_type WHEN 'purchase' THEN 'red' WHEN 'click' THEN 'amber' ELSE 'green' END AS posture, ts AS seen_at FROM {events}""",
    "signals": "SELECT event_id AS signal_id, user_id AS company_id, event_type AS source, CASE WHEN event_id % 3 <> 0 THEN 'Engineer ' || cast(event_id % 10 AS string) END AS title, ts AS posted_at FROM {events}",
    "runs": """SELECT event_id AS run_id, 1 + cast(floor(event_id / 5) AS bigint) AS job_id, event_type AS source_name, CASE event_type WHEN 'purchase' THEN 'red' WHEN 'click' THEN 'amber' ELSE 'green' END AS posture, cast(floor(value) AS bigint) AS found,
        cast(floor(value / 2) AS bigint) AS imported, CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'running' ELSE 'completed' END AS status, ts AS started_at, CASE WHEN event_id % 6 <> 2 THEN ts + INTERVAL '10' MINUTE END AS completed_at FROM {events}""",
    "leads": """SELECT contact_id AS lead_id, c.job_id, c.company_id, company_name, email, coalesce(c.phone, k.phone) AS phone, full_name, confidence, final_email_status AS validation_status, contact_id % 31 = 0 AS tombstoned, c.created_at
        FROM {contacts} c JOIN {companies} k ON c.company_id = k.company_id WHERE sales_ready""",
}
NAMES = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived table, or a driver's one; tables that are held are taken as they are."""
    if held and name in held:
        return held[name]
    if name not in RULES:
        return table(spark, sf_dir, name)
    used = sorted(set(NAMES.findall(RULES[name])))
    return spark.sql(RULES[name], **{n: frame(spark, sf_dir, n, held) for n in used})


def frames(spark: SparkSession, sf_dir: str, names: list[str], once: list[str]) -> dict[str, DataFrame]:
    """Several derived tables; those of `once`, in their order, are derived one time, written, and what rests on them reads them back."""
    held: dict[str, DataFrame] = {}
    for name in once:
        held[name] = written(frame(spark, sf_dir, name, held))
    return {n: frame(spark, sf_dir, n, held) for n in names}


def sql(query: str) -> str:
    """The query with the derived tables that it names as common table expressions."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in RULES and name not in needed:
            for n in NAMES.findall(RULES[name]):
                add(n)
            needed.append(name)

    for name in RULES:
        if re.search(rf"\b{name}\b", query):
            add(name)
    return "WITH " + ", ".join(f"{n} AS ({NAMES.sub(lambda m: m[1], RULES[n])})" for n in needed) + " " + query if needed else query
