"""Queries on mail that is rendered from the tables once, landed as files, and read back as a poll reads it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import streaming
from leadline.model import frame, sql
from leadline.plans.feeds import parts
from leadline.plans.registry import query
from leadline.sources import dns, landed, mailbox
from leadline.sources.shared import scratch, written

#: Of each kind of bounce its status and what the server said.
SAID = {"hard": ("5.1.1", "no such user"), "soft": ("4.2.2", "server busy"), "mailbox_full": ("5.2.2", "mailbox full"), "spam_rejected": ("5.7.1", "rejected as spam")}


def mail(spark: SparkSession, d: str) -> DataFrame:
    """(sender, received, raw): a delivery agent's report on every bounce, plain or with folded lines, and every reply, in which no agent speaks."""
    b, kind, k = frame(spark, d, "bounces"), F.col("bounce_type"), F.col("bounce_id")
    said = lambda i: F.create_map(*[F.lit(x) for name, v in SAID.items() for x in (name, v[i])])[kind]
    sent = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("message_id").cast("string"), 12, "0"))
    fold = F.when(k % 10 == 0, "\n ").otherwise(" ")
    inner = F.when(k % 2 == 0, F.concat(F.lit("--B\nContent-Type: message/rfc822\n\nMessage-ID: <lm-"), sent, F.lit("@x>\n\nhello\n\n"))).otherwise("")
    top = F.concat(F.lit("Subject: Delivery Status Notification "), k.cast("string"), F.lit("\nFrom: Mail Delivery <x@y.example>\n"))
    report = F.concat(top, F.lit("Content-Type: multipart/report; boundary=B\n\n--B\nContent-Type: message/delivery-status\n\nReporting-MTA: dns; m\n\nFinal-Recipient: rfc822;"), fold, F.col("email"), F.lit("\nStatus: "), said(0), F.lit("\nDiagnostic-Code: smtp; "), said(1), F.lit("\n\n"), inner, F.lit("--B--\n"))
    plain = F.concat(top, F.lit("Content-Type: text/plain\n\nFrom here on something went wrong with "), F.col("email"), F.lit("\nFrom us\n"))
    agent = F.when(k % 3 == 0, "postmaster@mx.example").otherwise("MAILER-DAEMON@mx.example")
    notices = b.select(agent.alias("sender"), F.col("detected_at").alias("received"), F.coalesce(report, plain).alias("raw"))
    r = frame(spark, d, "replies")
    answers = r.select(F.concat(F.lit("someone"), F.col("message_id"), F.lit("@example.org")).alias("sender"), F.col("received_at").alias("received"), F.concat(F.lit("Subject: Re: hello "), F.col("reply_id"), F.lit("\n\nFrom my side all is well, mailer-daemon@x.example.\n")).alias("raw"))
    return notices.union(answers)


NOTICE = """SELECT CASE WHEN bounce_id % 3 = 0 THEN 'postmaster' ELSE 'mailer-daemon' END AS agent, detected_at AS received, 'Delivery Status Notification ' || bounce_id AS subject, email AS final_recipient, CASE bounce_type WHEN 'hard' THEN '5.1.1' WHEN 'soft' THEN '4.2.2' WHEN 'mailbox_full' THEN '5.2.2' WHEN 'spam_rejected' THEN '5.7.1' END AS status, bounce_type, CASE WHEN bounce_type <> 'unknown' AND bounce_id % 2 = 0 THEN '00000000-0000-0000-0000-' || lpad(message_id::VARCHAR, 12, '0') END AS sent_id FROM bounces"""


@query(sql(f"""SELECT * FROM ({NOTICE}) WHERE received > TIMESTAMP '1998-01-01'"""))
def mailbox_notices(spark: SparkSession, d: str) -> DataFrame:
    """OP-I28, S50, S51, S53: all mail lands as files; a poll of some years takes the delivery agents' reports from them, and each is read: recipient,
    state, kind of bounce, and the message it speaks of."""
    path = f"{scratch(spark)}/mail"
    mailbox.deliver(mail(spark, d), path)
    found = mailbox.notices(spark, path, datetime.datetime(2002, 1, 1, tzinfo=datetime.timezone.utc), days=1461)
    got = landed.delivery_reports(found)
    return got.select("agent", F.col("received").cast("timestamp_ntz").alias("received"), "subject", F.col("report.final_recipient").alias("final_recipient"), F.col("report.smtp_status").alias("status"), "bounce_type", "sent_id")


@query(sql(f"""SELECT agent, received, subject FROM ({NOTICE})"""))
def mailbox_stream(spark: SparkSession, d: str) -> DataFrame:
    """OP-I28, T03: the same mail lands in three parts, and a stream that goes on from its offset takes the agents' reports from each part once."""
    at = scratch(spark)
    mailbox.register(spark)
    every = written(parts(mail(spark, d), "received", ["1998-01-01", "2000-01-01"]))
    kept = None
    for k in range(3):
        mailbox.deliver(every.where(F.col("part") == k), f"{at}/mail")
        stream = spark.readStream.format("mailbox").option("agents", ",".join(mailbox.AGENTS)).load(f"{at}/mail")
        kept = stream.select("agent", F.col("received").cast("timestamp_ntz").alias("received"), "subject")
        streaming.periodic(kept, streaming.into_log(f"{at}/log"), "bounces", f"{at}/cursor", once=True).awaitTermination()
    return streaming.log(spark, f"{at}/log", kept.schema)


#: Captured answers by rule: of every company's domain what was asked on three days.
ANSWERS = """SELECT domain, 'MX' AS type, CASE company_id % 9 WHEN 0 THEN 'nxdomain' WHEN 1 THEN 'noanswer' WHEN 2 THEN 'servfail' WHEN 3 THEN 'timeout' WHEN 7 THEN 'servfail' WHEN 8 THEN 'timeout' ELSE 'ok' END AS result,
 CASE WHEN company_id % 9 = 4 THEN '.' WHEN company_id % 9 IN (5, 6) THEN 'mx2.' || domain || '.,mx1.' || domain END AS records, TIMESTAMP '2024-03-01 00:00:00' AS asked_at FROM companies WHERE domain IS NOT NULL AND company_id % 31 <> 30
 UNION ALL SELECT domain, 'MX', CASE WHEN company_id % 9 = 7 THEN 'ok' ELSE 'servfail' END, CASE WHEN company_id % 9 = 7 THEN 'mail.' || domain || '.' END, TIMESTAMP '2024-03-02 00:00:00' FROM companies WHERE domain IS NOT NULL AND company_id % 9 IN (2, 7, 8)
 UNION ALL SELECT domain, 'MX', 'timeout', NULL, TIMESTAMP '2024-03-03 00:00:00' FROM companies WHERE domain IS NOT NULL AND company_id % 9 = 8
 UNION ALL SELECT domain, 'A', CASE company_id % 5 WHEN 0 THEN 'ok' WHEN 2 THEN 'timeout' WHEN 3 THEN 'nxdomain' ELSE 'noanswer' END, CASE WHEN company_id % 5 = 0 THEN '10.0.0.1' END, TIMESTAMP '2024-03-01 00:00:00' FROM companies WHERE domain IS NOT NULL AND company_id % 5 <> 4
 UNION ALL SELECT domain, 'AAAA', CASE company_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'noanswer' ELSE 'servfail' END, CASE WHEN company_id % 3 = 0 THEN '::1' END, TIMESTAMP '2024-03-01 06:00:00' FROM companies WHERE domain IS NOT NULL"""


@query(sql(f"""SELECT company_id, status, detail, CASE WHEN status = 'retry' THEN coalesce(tries, 0) ELSE 0 END::INT AS tries, CASE WHEN status = 'retry' AND coalesce(tries, 0) < 3 THEN coalesce(last + INTERVAL 6 HOUR, TIMESTAMP '2024-03-10 00:00:00') END AS retry_at FROM (SELECT company_id, tries, last, CASE WHEN d = '' THEN 'fail' WHEN mx = 'ok' AND names <> '' THEN 'pass' WHEN mx = 'nxdomain' THEN 'fail' WHEN mx IS NULL OR mx NOT IN ('ok', 'noanswer') THEN 'retry' WHEN a = 'ok' THEN 'pass' WHEN a IS NULL OR a NOT IN ('noanswer', 'nxdomain') THEN 'retry' WHEN aaaa = 'ok' THEN 'pass' WHEN aaaa IS NULL OR aaaa NOT IN ('noanswer', 'nxdomain') THEN 'retry' ELSE 'fail' END AS status,
 CASE WHEN d = '' THEN 'empty domain' WHEN mx = 'ok' AND names <> '' THEN 'MX: ' || names WHEN mx = 'nxdomain' THEN 'NXDOMAIN: domain does not exist' WHEN mx IS NULL THEN 'MX: not asked' WHEN mx NOT IN ('ok', 'noanswer') THEN 'MX: ' || mx WHEN a = 'ok' THEN 'A fallback (implicit MX)' WHEN a IS NULL THEN 'A: not asked' WHEN a NOT IN ('noanswer', 'nxdomain') THEN 'A: ' || a WHEN aaaa = 'ok' THEN 'AAAA fallback (implicit MX)' WHEN aaaa IS NULL THEN 'AAAA: not asked' WHEN aaaa NOT IN ('noanswer', 'nxdomain') THEN 'AAAA: ' || aaaa ELSE 'no MX and no A/AAAA fallback' END AS detail
 FROM (SELECT c.company_id, coalesce(c.domain, '') AS d, (SELECT arg_max(result, (asked_at, result)) FROM ans WHERE type = 'MX' AND ans.domain = c.domain) AS mx, (SELECT arg_max(result, (asked_at, result)) FROM ans WHERE type = 'A' AND ans.domain = c.domain) AS a, (SELECT arg_max(result, (asked_at, result)) FROM ans WHERE type = 'AAAA' AND ans.domain = c.domain) AS aaaa,
 (SELECT array_to_string(list_sort(list_filter(list_transform(string_split(arg_max(coalesce(records, ''), (asked_at, result, coalesce(records, ''))), ','), lambda x: regexp_replace(x, '[.]+$', '')), lambda x: x <> '')), ', ') FROM ans WHERE type = 'MX' AND ans.domain = c.domain) AS names,
 (SELECT count(*) FROM ans WHERE ans.domain = c.domain AND result IN ('servfail', 'timeout')) AS tries, (SELECT max(asked_at) FROM ans WHERE ans.domain = c.domain AND result IN ('servfail', 'timeout')) AS last FROM companies c))""").replace("SELECT company_id, status, detail, CASE WHEN status", f"_ANS_ SELECT company_id, status, detail, CASE WHEN status", 1).replace(" _ANS_ ", f", ans AS ({ANSWERS}) "))
def mail_hosts(spark: SparkSession, d: str) -> DataFrame:
    """OP-S40: whether every company's domain takes mail, by captured answers of several days: MX, then A, then AAAA; lookups that failed for a while with
    how often they did and when they are due again."""
    c = frame(spark, d, "companies")
    answers = spark.sql(ANSWERS.replace("FROM companies", "FROM {companies}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), companies=c).withColumn("records", F.split("records", ","))
    shout = c.select("company_id", F.when(F.col("company_id") % 2 == 0, F.concat(F.upper("domain"), F.lit("."))).otherwise(F.col("domain")).alias("domain"))
    return dns.mail_hosts(shout, answers, F.expr("timestamp_ntz '2024-03-10 00:00:00'")).drop("domain")
