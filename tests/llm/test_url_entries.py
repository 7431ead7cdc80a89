"""Operator 7: list entries with capitals in the path or a slash at the end."""

from __future__ import annotations

import datetime

from leadline.llm import urlfilter


def test_entry_paths(spark):
    day = datetime.date(2024, 1, 1)
    entries = [("l", "url", v, "add", day) for v in ("Bad.net/Path", "end.net/a/", "q.net/p?x=/", "slash.net/")] + [("l", "domain", "D.net", "add", day)]
    urls = {"http://BAD.net/Path/x": 1, "http://bad.net/path": 0, "http://end.net/a": 1, "http://end.net/a/": 1, "http://end.net/a/b?c": 1, "http://end.net/ab": 0, "http://q.net/p?x=/": 1, "http://q.net/p?x=": 0, "http://slash.net/x": 1, "http://slash.net": 1, "http://w.d.NET/": 1}
    captures = spark.createDataFrame([(u, day) for u in urls], "url string, fetched_on date")
    got = urlfilter.filter_urls(captures, spark.createDataFrame(entries, "list string, kind string, value string, action string, day date")).collect()
    assert {r["url"]: len(r["url_lists"]) for r in got} == urls


def test_odd_hosts(spark):
    """Dots at the end, numbers in brackets, several @ before the host, and very long addresses."""
    day = datetime.date(2024, 1, 1)
    entries = spark.createDataFrame([("l", "domain", v, "add", day) for v in ("bad.net", "[::1]")] + [("l", "url", "ok.org/a", "add", day)], "list string, kind string, value string, action string, day date")
    urls = {"http://bad.net./x": 1, "http://w.bad.net.:80/": 1, "http://[::1]:8080/x": 1, "http://[::2]/": 0, "http://u@bad.net:p@good.org/": 0, "http://u:p@q@bad.net/": 1, "http://good.org/@bad.net": 0, "http://ok.org/a/" + "b" * 100_000: 1, "http://ok.org/" + "a/" * 2000: 1, "//": 0, "": 0}
    captures = spark.createDataFrame([(u, day, 1, "x") for u in urls], "url string, fetched_on date, url_hits int, key string")
    got = urlfilter.filter_urls(captures, entries).collect()
    assert {r["url"]: len(r["url_lists"]) for r in got} == urls and {r["key"] for r in got} == {"x"}
    assert urlfilter.filter_urls(captures.limit(0), entries).collect() == []


def test_entries_are_read_as_captures_are(spark):
    day = datetime.date(2024, 1, 1)
    values = [("url", "http://a.example.com/en"), ("url", "HTTPS://u:p@B.example.com:8080/Path/"), ("url", " c.example.com/x "), ("url", "//d.example.com"), ("domain", "e.example.com."), ("domain", "*.f.example.com"), ("domain", " G.example.com "), ("domain", "h.example.com:443"), ("domain", ".i.example.com"), ("domain", "bücher.de"), ("url", "xn--mller-kva.de/a")]
    bad = [("domain", ""), ("domain", "j.example.com/path"), ("url", "/only/a/path"), ("other", "k.example.com"), ("url", None)]
    schema = "list string, kind string, value string, action string, day date"
    entries = spark.createDataFrame([(f"l{i}", k, v, "add", day) for i, (k, v) in enumerate(values + bad)] + [("z", "domain", "m.example.com", "odd", day), ("z", "domain", "m.example.com", "add", None)], schema)
    urls = {"http://a.example.com/en/x": "l0", "https://b.example.com/Path": "l1", "https://b.example.com/path": "", "http://c.example.com/x": "l2", "http://w.d.example.com/": "", "http://d.example.com/q?": "l3", "http://x.e.example.com/": "l4", "http://f.example.com": "l5", "http://g.example.com:9/": "l6", "http://h.example.com": "l7", "http://y.i.example.com": "l8"}
    urls |= {"http://www.xn--bcher-kva.de/": "l9", "http://www.bücher.de/": "l9", "http://Müller.de/a/b": "l10", "http://j.example.com/path": "", "http://k.example.com": "", "http://m.example.com": ""}
    got = urlfilter.filter_urls(spark.createDataFrame([(u, day) for u in urls], "url string, fetched_on date"), entries).collect()
    assert {r["url"]: ",".join(r["url_lists"]) for r in got} == urls
    assert {(r["kind"], r["value"]) for r in urlfilter.unreadable(entries).collect()} == {*bad, ("domain", "m.example.com")}
