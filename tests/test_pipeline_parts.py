"""Functions, exports, landed pages and streams of the lead pipeline on cases of their own."""

from __future__ import annotations

import csv
import datetime
import glob
import io
import json
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline import functions as fn
from leadline import operators as op
from leadline import streaming
from leadline.functions import checks, firms, people, phones, web
from leadline.sources import content_hash, exports, landed, payloads, sheets


def column(spark, values, f, kind="string"):
    """f of each value, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.select("i", f(F.col("c")).alias("r")).orderBy("i").select("r").collect()]


def test_syntax(spark):
    good = ["john.doe@example.com", "a@b.co", "first+tag@sub.domain.io", "Name.Surname@company.co.uk", "jürgen@exämple.de", "x" * 64 + "@a.org"]
    bad = ["", "  ", "not-an-email", "john@", "@example.com", "a@@b.com", "john doe@example.com", None, "plainaddress", ".a@b.co", "a..b@c.co", "a@-b.co", "a@b", "a@b.c-", "a@b.123", "a@host.localhost", "x" * 65 + "@a.org", "a@" + "b." * 130 + "co"]
    assert column(spark, good + bad, checks.syntax_ok) == [True] * len(good) + [False] * len(bad)


def test_disposable_roles_and_mail(spark):
    asked = ["someone@mailinator.com", "someone@example.com", "x@MailInator.CoM.", "x@custom.bad", "no-at-sign", None]
    assert column(spark, asked, lambda c: checks.disposable(c, ["CUSTOM.BAD", " "])) == [True, False, True, True, False, False]
    roles = ["info@x.org", "sales.team@x.org", "jobs+eu@x.org", "salesforce@x.org", "john@x.org", "@x.org", None]
    assert column(spark, roles, checks.role_based) == [True, True, True, False, False, False, False]
    assert column(spark, roles[:3], lambda c: checks.role_based(c, [])) == [False] * 3
    assert column(spark, ["a@yopmail.com", "a@b.org", "none"], lambda c: checks.mx_status(c, F.lit(True))) == ["fail", "pass", "fail"]
    assert column(spark, ["a@b.org"], lambda c: checks.mx_status(c, F.lit(False))) == ["skipped"]


def test_rules():
    plain = checks.decode_rules(None)
    assert plain["llm_threshold"] == 0.55 and plain["llm_mode"] == "advisory" and plain["unknown_retry"] == {"max_attempts": 3, "delay_hours": 6} and "info" in plain["role_keywords"] and not plain["allow_role_based"]
    odd = checks.decode_rules({"llm_threshold": 7, "llm_mode": "adjudicate", "catch_all_policy": "ALLOW", "risk_policy": None, "role_keywords": [" ", 3], "unknown_retry": {"max_attempts": 5, "x": 1}, "allow_role_based": 1, "other": 2})
    assert odd["llm_threshold"] == 1.0 and odd["llm_mode"] == "advisory" and odd["catch_all_policy"] == "allow" and odd["risk_policy"] == "review" and odd["role_keywords"] == plain["role_keywords"] and odd["unknown_retry"] == {"max_attempts": 5, "delay_hours": 6} and odd["allow_role_based"] is True
    assert checks.decode_rules({"llm_threshold": "x", "unknown_retry": True})["llm_threshold"] == 0.55
    patched = checks.patch_rules({"a": 1}, {"role_based_keywords": [" HR ", ""], "risk_handling": "reject", "unknown_retry_policy": "review", "llm_threshold": 0.2})
    assert patched == {"a": 1, "role_based_keywords": ["hr"], "role_keywords": ["hr"], "risk_handling": "reject", "risk_policy": "reject", "unknown_retry_policy": "review", "unknown_retry": 0, "llm_threshold": 0.2}


def test_sales_ready(spark):
    rows = spark.createDataFrame([("VERIFIED", False, None), ("VERIFIED", True, False), ("RISK_REVIEW", False, False), (None, False, False)], "s string, a boolean, b boolean")
    assert [r[0] for r in rows.select(checks.sales_ready(F.col("s"), F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_names(spark):
    good = ["Anna Lee", "J. R. Smith", "Mary-Jane O'Neil", "Anna Maria Van", "A Lee"]
    bad = ["Learn More", "Outsourced Controller Services", "anna lee", "Anna", "A B C D E", "Anna Lee2", "X" * 40 + " " + "Y" * 40, "", None, "Template Smith"]
    assert column(spark, good + bad, people.plausible_name) == [True] * len(good) + [False] * len(bad)
    assert column(spark, [" Anna  van Lee ", "Anna", " ", None], lambda c: F.struct(people.first_name(c), people.last_name(c))) == [("Anna", "Lee"), ("Anna", None), (None, None), (None, None)]
    rows = spark.createDataFrame([(" A@B.org ", 1, "X Y"), (None, 2, "The Näme"), ("", 3, None)], "e string, c long, n string")
    assert [r[0] for r in rows.select(people.contact_key(F.col("e"), F.col("c"), F.col("n"))).collect()] == ["email:a@b.org", "name:2:name", None]
    assert column(spark, [0.4, 0.95, 0.68], lambda c: people.aligned(c, F.lit(True)), "double") == [0.5, 0.99, 0.78]


def test_phones(spark):
    rows = [
        ("Call +91 79 4890 1234 or our Mumbai desk 022 2757 9191.", "IN", ["+917948901234", "+912227579191"]), ("order 1234 items, ref 000", "IN", []),
        ("+1 (415) 555-1234 or (415) 555 1234 or 1-415-555-1234", "US", ["+14155551234"]), ("+1 (555) 123-4567, 011 555 1234, 415 111 2222, 911 555 1234", "US", []),
        ("020 7946 0958, +44 (0)20 7946 0958, 44 20 7946 0958, 0044 20 7946 0958", "GB", ["+442079460958"]), ("call 079-4234 5678, v1.2345678901", "IN", ["+917942345678"]), ("tel 98765 43210", "IN", ["+919876543210"]),
        ("011 44 20 7946 0958", "US", ["+442079460958"]), ("+49 30 901820", None, ["+4930901820"]), ("0012345678", None, []), ("030 901820", "DE", ["+4930901820"]), ("06 12 34 56 78", "FR", ["+33612345678"]),
        ("+971 50 123 4567 and 04 331 2345", "AE", ["+971501234567", "+97143312345"]), ("6123 4567", "SG", ["+6561234567"]), ("0412 345 678 / 1300 123 456", "AU", ["+61412345678", "+611300123456"]),
        ("+210 1234 5678, +999 1234 5678, +34 912 345 678, +12345678", None, ["+34912345678"]), (None, "US", None),
    ]
    df = spark.createDataFrame([(t, r) for t, r, _ in rows], "t string, r string")
    assert [x[0] for x in df.select(phones.phones(F.col("t"), F.col("r"))).collect()] == [w for _, _, w in rows]
    assert column(spark, ["USA", " united kingdom ", "uk", "nl", "Nowhere", None], phones.region) == ["US", "GB", "GB", "NL", None, None]
    page = """<a href="tel:+14155551234;ext=3">call</a> <a class='b' href=TEL:%2B44-20-7946-0958>x</a> <p>Or (212) 555-0187<script>var a = "(646) 555-0187";</script> <a href="mailto:x">+1 415 555 1234</a>"""
    assert column(spark, [page, "", None], lambda c: phones.page_phones(c, F.lit("US"))) == [["+14155551234", "+442079460958", "+12125550187"], [], None]
    codes = re.compile(phones.CODE)
    assert [m[1] if (m := codes.match(n)) else None for n in ("12125550187", "442079460958", "971501234567", "2101234", "999", "35312345", "8881234")] == ["1", "44", "971", None, None, "353", "888"]
    assert all(codes.match(c + "5")[1] == c for c in phones.CODES)
    other = {"XX": phones.Plan("299", "", "00", "[2-9][0-9]{5}")}
    assert column(spark, ["222222", "00299222222", "122222"], lambda c: phones.e164(c, F.lit("XX"), other)) == ["+299222222", "+299222222", None]


def test_firms(spark):
    cases = {"CPA": "CPA certified public accountant firm", "CPA  Firm": "CPA certified public accountant firm", "Managed Service Provider (MSP)": "MSP managed IT service provider", "Helpers (MSP)": "MSP managed IT service provider", "BPO of banks": "BPO business process outsourcing company", " Bakery ": "Bakery", "": "", None: ""}
    assert column(spark, list(cases), firms.search_phrase) == list(cases.values())
    assert column(spark, ["consulting", "agency", "", "Law Firm"], lambda c: firms.search_variants(c, 3)) == [["consulting firm", "business consultant", "advisory services"], ["agency"], ["companies"], ["law firm attorneys legal services", "law firm", "advocates"]]
    assert column(spark, ["law firm"], lambda c: firms.search_variants(c, 0)) == [["law firm attorneys legal services"]]
    row = spark.createDataFrame([("firm", ["a", "b", "c", "d"], "", "Ohio"), ("", [], None, None)], "p string, s array<string>, c string, t string")
    assert [r[0] for r in row.select(firms.text_query(F.col("p"), F.col("s"), F.col("c"), F.col("t"))).collect()] == ["firm a b c in Ohio", "companies"]


def test_addresses(spark):
    pages = ["https://m.facebook.com/acme/about?x=1", "facebook.com/acme#top", "http://WWW.FACEBOOK.com/acme/", "https://facebook.com/", "https://facebook.com/groups/acme", "https://facebook.com/Profile.php?id=3", "https://notfacebook.com/acme", "", None]
    assert column(spark, pages, firms.page_address) == ["https://www.facebook.com/acme"] * 3 + [None] * 6
    assert column(spark, ["https://a.org/x", "http://www.a.org", "http://10.0.0.1/x", "https://a.org:81", None], lambda c: firms.homepage_variants(c)) == [["https://a.org/x", "http://a.org/x", "https://www.a.org/x", "http://www.a.org/x"], ["http://www.a.org", "https://www.a.org", "http://a.org", "https://a.org"], ["http://10.0.0.1/x", "https://10.0.0.1/x"], ["https://a.org:81", "http://a.org:81"], None]
    homes = spark.createDataFrame([(" a.org ", None), (None, "www.b.org"), ("", ""), ("http://c.org", "d.org")], "w string, d string")
    assert [r[0] for r in homes.select(firms.homepage(F.col("w"), F.col("d"))).collect()] == ["https://a.org", "https://b.org", None, "http://c.org"]
    assert column(spark, ["12", "999", "1.5", "Wed, 21 Oct 2026 07:28:00 GMT", "", None], firms.retry_after) == [12.0, 120.0, 1.5, None, None, None]
    assert column(spark, ["Hi\n", "Hi. Stop here."], lambda c: firms.with_footer(c, F.lit(" Stop "))) == ["Hi\n\n-- \nStop", "Hi. Stop here."]
    assert column(spark, ["Now hiring!", "We're   hiring", "a career", "scaring", "Open position"], firms.is_hiring) == [True, True, True, False, True]


def test_references(spark):
    got = ["a &amp; b", "x&#64;y.org", "x&#x40;y", "&eacute;&nbsp;&unknown; &", "&#0; &#1114112;", "plain", None]
    assert column(spark, got, web.unescape) == ["a & b", "x@y.org", "x@y", "é\xa0&unknown; &", "&#0; &#1114112;", "plain", None]
    assert column(spark, ["me&#91;at&#93;x&commat;", "a &lt;b&gt; at c dot org"], web.deobfuscate) == ["me@x&commat;", "a <b>@c.org"]
    assert column(spark, ["Delivery Status Notification (Failure)", "the delivery was fine", "Undelivered Mail", "Mail delivery failed", None], web.is_notice) == [True, False, True, True, False]


def test_slug_table():
    for c in "éßŁ½ﬁＡ①ǆ":
        want = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        assert fn.SEVERAL.get(c, dict(zip(fn.MARKED, fn.PLAIN)).get(c, "")) == want


def test_content_hash(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("a|b", "c")], "p string, q string")
    got = [r[0] for r in df.select(content_hash("q", "p")).collect()]
    assert len(set(got)) == 4 and got[0] == got[4]


def test_latest_before(spark):
    t = lambda h: datetime.datetime(2024, 1, 10) + datetime.timedelta(hours=h)
    asks = spark.createDataFrame([("a", t(0)), ("a", t(0)), ("a", t(71)), ("a", t(72)), ("b", t(5)), (None, t(0)), ("a", None)], "k string, at timestamp_ntz")
    facts = spark.createDataFrame([("a", t(0), 1), ("a", t(-73), 2), ("a", t(0), 3), ("b", t(6), 4), (None, t(0), 5)], "k string, made timestamp_ntz, v int")
    got = sorted(((r["k"] or "", r["at"] or t(-999), r["v"]) for r in op.latest_before(asks, facts, "k", "at", "made", 3, "v").collect()), key=str)
    assert got == sorted([("a", t(0), 3), ("a", t(0), 3), ("a", t(71), 3), ("a", t(72), None), ("b", t(5), None), ("", t(0), None), ("a", t(-999), None)], key=str)


def test_upsert(spark):
    rows = spark.createDataFrame([("k", 2, "late", "u1", "red"), ("k", 1, None, "u2", "green"), ("k", 3, "x", "u1", "amber"), (None, 4, "n", None, "green"), (None, 5, "n", "u", "odd")], "key string, seq long, name string, url string, posture string")
    got = {(r["key"], r["seq"]): (r["name"], r["urls"], r["posture"], r["sightings"], r["dedupe_status"]) for r in op.upsert(rows, "key", "seq", ["name"], "url", "posture").collect()}
    assert got == {("k", 1): (None, "u2,u1", "red", 3, "merged"), (None, 4): ("n", "", "green", 1, "unique"), (None, 5): ("n", "u", "green", 1, "unique")}


def test_tabs(spark):
    assert list(sheets.TABS) == ["README", "Mining_Jobs", "Companies", "Contacts", "Email_Validation", "Sales_Ready_Leads", "Outreach_Queue", "Campaigns", "Bounce_Log", "Suppression_List", "Data_Source_Audit", "Audit_Log"]
    tab = sheets.Tab("Contacts")
    assert tab.key == "contact_id" and tab.editable == ["owner", "sales_notes", "next_action"] and set(tab.system) == set(tab.columns) - set(tab.editable)
    df = spark.range(1).select(F.lit(None).cast("string").alias("a"), F.expr("timestamp_ntz '2024-01-02 03:04:05.678'").alias("b"), F.expr("cast(14 as decimal(5,2))").alias("c"), F.lit(4.6).alias("d"), F.expr("array('x', null, 'y')").alias("e"), F.lit(True).alias("f"))
    row = df.select(*[sheets.cell(F.col(f.name), f.dataType) for f in df.schema.fields]).head()
    assert tuple(row) == ("", "2024-01-02T03:04:05", "14", "4.6", "x, y", "true")
    assert [sheets.letters(n) for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]


def test_mirror_keeps_edits(spark):
    tab = sheets.Tab("Contacts")
    old = tab.cells(spark.createDataFrame([(1, "Ann", "ada"), (2, "Bo", ""), (3, "Cy", "bob")], "contact_id long, contact_name string, owner string")).withColumn("row", F.col("contact_id").cast("long") + 1)
    new = spark.createDataFrame([(3, "Cy B", "z"), (1, "Ann", "z"), (9, "Di", "new")], "contact_id long, contact_name string, owner string")
    got = [(r["row"], r["contact_id"], r["contact_name"], r["owner"]) for r in sheets.mirrored(old, new, tab).orderBy("row").collect()]
    assert got == [(2, "1", "Ann", "ada"), (3, "3", "Cy B", "bob"), (4, "9", "Di", "new")]


def test_exports(spark, tmp_path):
    one = spark.createDataFrame([(1, 'x "y"'), (2, None)], "id long, name string")
    tabs = {"Things": one, "A very long title of a tab: with more than 31": one.select("id")}
    assert exports.export(tabs, "json", str(tmp_path / "j"))["status"] == "COMPLETED"
    document = lambda name: "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / name / "part-*"))))
    assert json.loads(document("j")) == {"Things": [{"id": 1, "name": 'x "y"'}, {"id": 2, "name": None}], list(tabs)[1]: [{"id": 1}, {"id": 2}]}
    exports.one_file(spark, str(tmp_path / "j"), str(tmp_path / "j.json"))
    assert open(tmp_path / "j.json").read() == document("j")
    exports.json({"Things": one.limit(0)}, str(tmp_path / "j0"))
    assert json.loads(document("j0")) == []
    many = spark.range(3000).select("id", F.concat(F.lit("a, "), F.col("id") % 7, F.lit('"\n')).alias("the.name")).repartition(5)
    exports.json({"Many": many}, str(tmp_path / "j1"))
    assert sorted(r["id"] for r in json.loads(document("j1"))) == list(range(3000))
    exports.csv({"Things": one}, str(tmp_path / "c"))
    assert list(csv.reader(io.StringIO(document("c")))) == [["id", "name"], ["1", 'x "y"'], ["2", ""]]
    exports.csv({"Many": many}, str(tmp_path / "c1"))
    rows = list(csv.reader(io.StringIO(document("c1"))))
    assert rows[0] == ["id", "the.name"] and sorted(int(r[0]) for r in rows[1:]) == list(range(3000)) and rows[1][1].endswith('"\n')
    exports.xlsx(tabs, str(tmp_path / "t.xlsx"))
    with zipfile.ZipFile(tmp_path / "t.xlsx") as z:
        book, sheet = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
    assert [len(n) <= 31 for n in re.findall(r'<sheet name="([^"]*)"', book)] == [True, True] and 'state="frozen"' in sheet and '<autoFilter ref="A1:B3"/>' in sheet and "x &quot;" not in sheet and 'x "y"' in sheet
    seen = []
    failed = exports.export({"a": one}, "odd", "x" * 2000, seen.append)
    assert failed["status"] == "FAILED" and len(failed["error"]) <= 1000 and [s["status"] for s in seen] == ["RUNNING", "FAILED"]
    assert exports.titles(["a/b", "a b", "A b"]) == ["a b", "a b~2", "A b~3"]


CARDS = """<div class="grid team-grid"><div class="card member"><h3>Anna Lee</h3><p>Chief Executive Officer</p></div>
<div class="member"><h3>Ahmedabad Office</h3><p>Head Office</p></div><div class='member'>Head of Sales<br>Bo Chen</div>
<div class="member"><h3>anna LEE</h3></div><div class="member"><p>Learn More</p><p>CTO</p></div></div><script>Max Power CTO</script>"""


def test_team_cards(spark):
    assert [len(landed.card_lines(x)) for x in (CARDS, "<p class=teaser>", None, "<div class=team>a<div class=staff>b</div></div>", "<b class=bio>" * 3000)] == [5, 0, 0, 1, 3000]
    got = {r["name"]: (r["designation"], r["confidence"]) for r in landed.team_cards(spark.createDataFrame([("u", CARDS), ("v", None)], "url string, html string")).collect()}
    assert got["Bo Chen"][0] == "Head of Sales" and got["Anna Lee"][0] == "Chief Executive Officer" and set(got) == {"Anna Lee", "Bo Chen"}
    assert all(0.55 <= c <= 0.95 for _, c in got.values())


def test_first_social(spark):
    html = """<script type="application/ld+json">{"@type": "Organization", "name": "A", "sameAs": ["https://www.linkedin.com/company/ld"]}</script><a href="https://linkedin.com/company/anchor">x</a><a href='https://facebook.com/one'>f</a><a href="https://facebook.com/two">f</a>"""
    got = landed.social_links(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [r["social"] for r in got] == [{"linkedin": "https://www.linkedin.com/company/ld", "facebook": "https://facebook.com/one"}, {}]


def test_payload_lists(spark):
    bodies = ['[{"name": " A "}, {"name": ""}]', '{"items": [{"title": "B", "url": "https://www.b.org/x", "zip": "1"}]}', '{"results": {}, "data": [{"company_name": "C", "domain": "c.org"}]}', "no json", None]
    got = payloads.companies(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r["name"], r["domain"], r["postal_code"]) for r in got] == [("A", None, None), ("B", "b.org", "1"), ("C", "c.org", None)]
    with pytest.raises(ValueError, match="unknown sources: nowhere"):
        payloads.discover(spark, "", ["nowhere"])
    answers = ['{"results": [{"email": "A@b.org", "score": 0.5, "reason": " ok "}, {"email": "x", "score": 0.1}, {"email": "c@d.org", "score": 1.5}]}', '[{"email": "e@f.org", "score": "0.25"}]', "?", None]
    assert sorted(tuple(r) for r in payloads.scores(spark.createDataFrame([(a,) for a in answers], "content string")).collect()) == [("a@b.org", 0.5, "ok"), ("e@f.org", 0.25, "llm score")]


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    kind = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("tenant", T.LongType())])
    there = lambda rows, n: spark.createDataFrame([(i, t, k) for i, k in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    there([(1, 1), (2, 1), (2, 1), (3, 2)], 1)
    rows = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    log, at = str(tmp_path / "log"), str(tmp_path / "at")
    for _ in range(2):  # what is there, then what is new: one query, its checkpoint the cursor
        q = streaming.periodic(streaming.feed(rows(), 1, key="tenant", value=1), streaming.into_log(log), "dispatch", at, once=True)
        assert q.awaitTermination(120)
        there([(4, 1), (2, 1)], 2)
    read = lambda: sorted(r["event_id"] for r in streaming.log(spark, log, kind).collect())
    assert read() == [2, 4]
    streaming.into_log(log)(spark.createDataFrame([(2, t, 1)], kind), 0)  # a batch that comes again
    assert read() == [2, 4]
    assert streaming.live(spark.read.parquet(str(tmp_path / "in")), F.lit(t + datetime.timedelta(1))).count() == 0


def test_grants_and_patches(spark):
    rows = spark.createDataFrame([(["*"], "x"), (["a", "b"], "b"), (["a"], "b"), ([], "b"), (None, "b"), (["a"], None)], "g array<string>, n string")
    assert [r[0] for r in rows.select(checks.granted(F.col("g"), F.col("n"))).collect()] == [True, True, False, False, False, False]
    rules, patches = {"catch_all_policy": "review", "a": "1"}, [{"catch_all_handling": "allow"}, {"unknown_retry_policy": "retry", "a": "2"}, {"unknown_retry_policy": "drop", "risk_handling": "x"}, {}]
    df = spark.createDataFrame([(rules, p) for p in patches], "r map<string,string>, p map<string,string>")
    got = [dict(r[0]) for r in df.select(checks.patched(F.col("r"), F.col("p"))).collect()]
    assert got == [{k: str(v) for k, v in checks.patch_rules(rules, p).items()} for p in patches]


def test_names_of_whole_texts(spark):
    text = "x" * 500 + ". Anna Lee met J. R. Smith and Mary-Jane O'Neil\nLearn More. Émile Zola, A B C D E"
    assert column(spark, [text, "", None], people.candidate_names) == [["Anna Lee", "J. R. Smith", "Mary-Jane O'Neil", "Learn More.", "A B C D"], [], None]
    assert column(spark, ["Acme  Ltd", "The ACME ltd group", "Other", "", None], lambda c: fn.same_firm(c, F.lit("acme ltd"))) == [True, True, False, False, False]
    assert column(spark, [" law  firm ", "Circus", None], firms.group_of) == [("Professional Services", "Law Firm"), None, None]


def test_bounces_lose_addresses(spark):
    kinds = ["soft", "unknown", "soft", "rate_limited", "soft", "unknown", "soft"]
    rows = [(i, "a@x", k) for i, k in enumerate(kinds)] + [(20 + i, f"{k}@x", k) for i, k in enumerate(op.LOST)] + [(40, None, "soft"), (41, None, "unknown")]
    out = op.bounce_actions(spark.createDataFrame(rows, "i int, email string, kind string"), "email", ["i"]).collect()
    got = {r["i"]: (r["action"], r["message_status"]) for r in out}
    assert [got[i][0] for i in range(7)] == ["soft_retry (1/3)", "soft_retry (1/3)", "soft_retry (2/3)", "soft_retry (2/3)", "suppressed_soft_exhausted", "suppressed_soft_exhausted", "suppressed_soft_exhausted"]
    assert {got[i][1] for i in range(7)} == {"soft_bounce"} and [got[20 + i] for i in range(5)] == list(op.LOST.values()) and got[41][0] == "soft_retry (1/3)"
    actions = spark.createDataFrame([(1, "A@x", "soft_retry (1/3)"), (2, "a@X", "suppressed_spam"), (3, "a@x", "suppressed_hard"), (4, "b@x", "suppressed_soft_exhausted")], "i int, email string, action string")
    lost = op.suppressed_by_bounce(actions, "email", ["i"])
    there = spark.createDataFrame([(1, "B@x", "manual", False), (2, "b@X", "other", False), (3, "c@x", "manual", False), (4, None, "domain", True)], "id int, email string, reason string, permanent boolean")
    assert {tuple(r) for r in op.upsert_suppressions(there, lost).collect()} == {("a@x", "Spam rejection", True), ("b@x", "manual", True), ("c@x", "manual", False)}
