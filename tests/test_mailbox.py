"""Mail as landed files: ranges, filters that reach the reader, offsets; reports by patterns as the parser reads them."""

from __future__ import annotations

import datetime
import io

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

from leadline import streaming
from leadline.sources import dns, landed, mailbox

UTC = datetime.timezone.utc
T0 = datetime.datetime(2024, 5, 1, tzinfo=UTC)


def some(n=60):
    rows = []
    for i in range(n):
        agent = ("MAILER-DAEMON", "ann", "Postmaster")[i % 3]
        body = "\n".join(["From the start", ">From quoted", f"line {i}"] * (1 if i % 7 else 400))
        rows.append((f"{agent}@mx{i}.example", T0 + datetime.timedelta(hours=i), f"Subject: no {i}\n  folded\nX: y\n\n{body}\n"))
    return rows


def landing(spark, path, rows):
    mailbox.deliver(spark.createDataFrame(rows, "sender string, received timestamp, raw string").repartition(3), path)


def test_messages_come_back_whole(spark, tmp_path):
    path, rows = str(tmp_path / "mail"), some()
    landing(spark, path, rows)
    (tmp_path / "mail" / "_SUCCESS").write_text("From x y\n")
    mailbox.register(spark)
    for size in (3000, 64 << 20):
        got = spark.read.format("mailbox").option("split_bytes", size).load(path).collect()
        assert sorted((r["sender"], r["received"].astimezone(UTC), bytes(r["raw"]).decode()) for r in got) == sorted(rows)
        assert {(r["agent"], r["subject"]) for r in got} == {(s.partition("@")[0].lower(), f"no {i} folded") for i, (s, _, _) in enumerate(rows)}
    assert len({(r["file"], r["position"]) for r in got}) == len(rows)
    assert spark.read.format("mailbox").load(str(tmp_path / "nowhere")).collect() == []


def test_filters_reach_the_reader(spark, tmp_path):
    reader = mailbox.MailReader({"path": str(tmp_path)})
    at = T0 + datetime.timedelta(hours=10)
    left = list(reader.pushFilters([In(("agent",), ("mailer-daemon", "x")), EqualTo(("agent",), "mailer-daemon"), GreaterThan(("received",), at), LessThan(("received",), at), IsNotNull(("agent",)), EqualTo(("subject",), "s")]))
    assert [type(f).__name__ for f in left] == ["LessThan", "EqualTo"]
    w = reader.wanted
    assert w.takes("mailer-daemon", at + datetime.timedelta(seconds=1)) and not w.takes("mailer-daemon", at) and not w.takes("x", at + datetime.timedelta(1)) and not w.takes("mailer-daemon", None)
    path, rows = str(tmp_path / "mail"), some()
    landing(spark, path, rows)
    got = mailbox.notices(spark, path, T0 + datetime.timedelta(hours=82))
    assert {r["sender"] for r in got.collect()} == {s for s, t, _ in rows if t > at and not s.startswith("ann")}


def test_a_message_belongs_to_one_range():
    text = b"From a@x 2024-05-01T00:00:00Z\nSubject: 1\n\n>From b\n\nFrom b@x nonsense\nno header\n\nFrom c@x 2024-05-02T00:00:00+02:00\n\n"
    every = None
    for size in range(1, len(text) + 2):
        rows = [r for i in range(0, len(text), size) for r in mailbox.messages(io.BytesIO(text), mailbox.Range("f", i, i + size), mailbox.Wanted())]
        every = every or rows
        assert rows == every
    assert [(r[1], r[2], r[4] and r[4].isoformat(), r[5], r[6]) for r in every] == [(0, "a", "2024-05-01T00:00:00+00:00", "1", b"Subject: 1\n\nFrom b\n"), (51, "b", None, None, b"no header\n"), (80, "c", "2024-05-02T00:00:00+02:00", None, b"")]


def test_streams_go_on_from_their_offset(spark, tmp_path):
    path, rows = str(tmp_path / "mail"), some(30)
    mailbox.register(spark)
    for part in (rows[:10], rows[10:20], [], rows[20:]):
        if part:
            landing(spark, path, part)
        stream = spark.readStream.format("mailbox").option("agents", "postmaster, mailer-daemon").option("since", (T0 + datetime.timedelta(hours=5)).isoformat()).load(path).select("sender")
        streaming.periodic(stream, streaming.into_log(str(tmp_path / "log")), "bounces", str(tmp_path / "at"), once=True).awaitTermination()
    got = [r["sender"] for r in streaming.log(spark, str(tmp_path / "log"), stream.schema).collect()]
    assert sorted(got) == sorted(s for s, t, _ in rows[5:] if not s.startswith("ann"))


def test_reports_by_patterns_and_by_the_parser(spark):
    part = "Final-Recipient: rfc822; a@b.org\nAction: failed\nStatus: 5.1.1\nDiagnostic-Code: smtp; 550 no; such  user\n"
    whole = lambda p, inner="", top="": f"{top}Content-Type: multipart/report; boundary=B\n\n--B\nContent-Type: text/plain\n\nSorry x@y.org 4.4.1\n\n--B\nContent-Type: message/delivery-status\n\nReporting-MTA: dns; m\n\n{p}\n{inner}--B--\n"
    sent = "--B\nContent-Type: message/rfc822\n\nSubject: x\nMessage-ID: <lm-00000000-0000-0000-0000-000000000001@x>\n\nhello\n"
    texts = [
        whole(part), whole(part, sent), whole(part.replace("; a@b", ";\n a@b")), whole(part.replace("Diagnostic-Code", "X-Other")), whole(part.replace("Status: 5.1.1", "Status:   4.2.2  ")), whole(part, top="Status: RO\n"),
        whole(part, sent.replace("Message-ID: <", "Message-ID:\n <")), whole(part, sent.replace("message/rfc822", "text/rfc822-headers")), whole(part + "\n" + part.replace("a@b", "c@d")), whole(part).replace("\n", "\r\n"), whole(part.lower()),
        "Content-Type: text/plain\n\nno such user z@y.org 5.7.1\n", "", "junk", whole(part).replace("Content-Type: message/delivery-status\n", "Content-Type: message/delivery-status\nContent-Transfer-Encoding: base64\n"),
    ]
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)] + [(99, None)], "i int, raw binary")
    got = {r["i"]: r for r in landed.delivery_reports(df).collect()}
    for i, t in enumerate(texts):
        want = landed.report(t.encode())
        assert {k: got[i]["report"][k] for k in want} == want, t
    assert got[99]["bounce_type"] == "unknown" and got[1]["sent_id"].endswith("0001") and got[4]["bounce_type"] == "soft"
    plain = df.select("i", landed._plain_report(F.col("raw").cast("string")).isNotNull().alias("p")).collect()
    assert {r["i"] for r in plain if r["p"]} >= {0, 1, 4, 10}


def test_mail_hosts(spark):
    at = lambda h: datetime.datetime(2024, 3, 1) + datetime.timedelta(hours=h)
    answers = [
        ("acme.com", "MX", "ok", ["Mail.acme.com.", "a.acme.com."], at(0)), ("a.com", "MX", "noanswer", None, at(0)), ("a.com", "A", "ok", ["1.2.3.4"], at(0)), ("six.com", "MX", "ok", ["."], at(0)), ("six.com", "A", "nxdomain", None, at(0)), ("six.com", "AAAA", "ok", ["::1"], at(0)),
        ("nope.invalid", "MX", "nxdomain", None, at(0)), ("empty.example", "MX", "noanswer", None, at(0)), ("empty.example", "A", "noanswer", None, at(0)), ("empty.example", "AAAA", "noanswer", None, at(0)),
        ("slow.example", "MX", "timeout", None, at(0)), ("brk.example", "MX", "servfail", None, at(0)), ("brk.example", "MX", "timeout", None, at(7)), ("brk.example", "MX", "servfail", None, at(14)),
        ("late.com", "MX", "servfail", None, at(0)), ("late.com", "MX", "ok", ["x.late.com"], at(6)), ("late.com", "MX", "nxdomain", None, at(99)), ("half.com", "MX", "noanswer", None, at(0)),
    ]
    asked = ["acme.com", " ACME.com. ", "a.com", "six.com", "nope.invalid", "empty.example", "slow.example", "brk.example", "late.com", "half.com", "never.com", "", None]
    rows = dns.mail_hosts(spark.createDataFrame([(d,) for d in asked], "domain string"), spark.createDataFrame(answers, "domain string, type string, result string, records array<string>, asked_at timestamp_ntz"), F.expr("timestamp_ntz '2024-03-02 00:00:00'")).collect()
    passed = {r["domain"]: r["detail"] for r in rows if r["status"] == "pass"}
    assert passed == {"acme.com": "MX: Mail.acme.com, a.acme.com", " ACME.com. ": "MX: Mail.acme.com, a.acme.com", "a.com": "A fallback (implicit MX)", "six.com": "AAAA fallback (implicit MX)", "late.com": "MX: x.late.com"}
    failed = {r["domain"]: r["detail"] for r in rows if r["status"] == "fail"}
    assert failed == {"nope.invalid": "NXDOMAIN: domain does not exist", "empty.example": "no MX and no A/AAAA fallback", "": "empty domain", None: "empty domain"}
    again = {r["domain"]: (r["detail"], r["tries"], r["retry_at"]) for r in rows if r["status"] == "retry"}
    assert again == {"slow.example": ("MX: timeout", 1, at(6)), "brk.example": ("MX: servfail", 3, None), "half.com": ("A: not asked", 0, at(24)), "never.com": ("MX: not asked", 0, at(24))}
