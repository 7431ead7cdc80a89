"""Payloads, pages, delivery reports and state by key, on small invented cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from leadline.functions import web
from leadline.sources import landed
from leadline.streaming import state


def test_places(spark):
    place = {"id": "p1", "displayName": {"text": "Acme"}, "websiteUri": "https://www.facebook.com/acme", "primaryType": "tax_office", "addressComponents": [{"longText": "Ulm", "types": ["postal_town"]}, {"longText": "X", "types": ["locality"]}]}
    body = json.dumps({"places": [place, place, {"id": "p2", "websiteUri": "http://b.org"}]})
    rows = {r["place_id"]: r for r in landed.places(spark.createDataFrame([(body,), (None,), ("{bad",)], "body string")).where("place_id is not null").collect()}
    assert set(rows) == {"p1", "p2"}
    assert (rows["p1"]["website"], rows["p1"]["facebook"], rows["p1"]["city"], rows["p1"]["industry"]) == (None, "https://www.facebook.com/acme", "Ulm", "Tax Office")
    assert rows["p2"]["website"] == "http://b.org"


def test_pages(spark):
    ld = {"@graph": [{"@type": ["LocalBusiness"], "name": "Acme", "sameAs": "https://x.com/a", "address": {"streetAddress": "1 Way", "addressCountry": "DE"}}, {"@type": "JobPosting", "title": "Clerk", "datePosted": "2024-01-02"}, {"@type": "Person", "name": "Bo Li"}]}
    hidden = "".join(f"{b ^ 0x42:02x}" for b in b"h@i.org")
    html = f'<script type="application/ld+json">{json.dumps(ld)}</script><a href="mailto:A@b.org?subject=x">m</a><i data-cfemail="42{hidden}"></i> c [at] d [dot] net logo@2x.png'
    rows = landed.page_contacts(spark.createDataFrame([("u", html), ("v", None), ("w", "")], "url string, html string")).collect()
    got = {r["url"]: r for r in rows}
    assert got["u"]["emails"] == ["a@b.org", "h@i.org", "c@d.net"]
    assert got["u"]["ld"]["organization"] == "Acme" and got["u"]["ld"]["address"] == "1 Way, DE"
    assert got["u"]["ld"]["jobs"][0]["title"] == "Clerk" and got["u"]["ld"]["people"][0]["name"] == "Bo Li"
    assert got["v"]["emails"] == [] and got["w"]["ld"]["jobs"] == []


def test_reports(spark):
    ident = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    dsn = f"Content-Type: multipart/report; boundary=B\n\n--B\nContent-Type: text/plain\n\nSorry\n--B\nContent-Type: message/delivery-status\n\nReporting-MTA: dns; m\n\nFinal-Recipient: rfc822; a@b.org\nStatus: 5.2.2\nDiagnostic-Code: smtp; 552 over quota\n\n--B\nContent-Type: message/rfc822\n\nMessage-ID: <lm-{ident}@x>\n\nhello\n--B--\n"
    notice = "Content-Type: text/html\n\n<p>Not delivered to <b>c@d.org</b>: 5.1.1 unknown</p>"
    rows = [("a", dsn.encode()), ("b", notice.encode()), ("c", b"\xff\x00junk"), ("d", None)]
    got = {r["k"]: r for r in landed.delivery_reports(spark.createDataFrame(rows, "k string, raw binary")).collect()}
    assert got["a"]["report"]["final_recipient"] == "a@b.org" and got["a"]["bounce_type"] == "mailbox_full" and got["a"]["sent_id"] == ident
    assert got["b"]["report"]["final_recipient"] == "c@d.org" and got["b"]["bounce_type"] == "hard"
    assert got["c"]["bounce_type"] == got["d"]["bounce_type"] == "unknown"


def test_robots(spark):
    body = "User-agent: bot\nDisallow: /b\n\nUser-agent: *\nDisallow: /private\nDisallow:\nCrawl-delay: 30\n"
    r = spark.createDataFrame([(body,), (None,)], "t string").select(landed.robots_rules(F.col("t")), landed.crawl_delay(F.col("t"))).collect()
    assert tuple(r[0]) == (["/private"], 10.0) and tuple(r[1]) == ([], None)


def test_relative_dates(spark):
    rows = [("3+ days ago", "2024-01-07"), ("1 month ago", "2023-12-11"), ("yesterday", "2024-01-09"), ("2023-05-06", "2023-05-06"), ("soon", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(web.relative_date(F.col("t"), F.expr("timestamp_ntz '2024-01-10 00:00:00'")).cast("date").cast("string")).collect()
    assert [r[0] for r in got] == [b for _, b in rows]


def run(spark, df, folder, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("update" if name == "soft" else "append").option("checkpointLocation", folder).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_state(spark, tmp_path):
    rows = [("a", "soft"), ("a", "soft"), ("b", "soft"), ("a", "soft"), ("b", "hard")]
    spark.createDataFrame(rows, "recipient string, kind string").write.parquet(str(tmp_path / "b"))
    live = spark.readStream.schema("recipient string, kind string").parquet(str(tmp_path / "b"))
    assert {tuple(r) for r in run(spark, state.soft_bounces(live), str(tmp_path / "c1"), "soft")} == {("a", 3, True), ("b", 1, False)}
