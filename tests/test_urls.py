"""References, hosts and suffixes against Python's own functions and the standards' examples."""

from __future__ import annotations

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from leadline.functions import checks, urls
from leadline.sources import links

BASES = ("http://a/b/c/d;p?q", "http://a", "http://a/", "https://x.org/en/825/?page=2&ref=x", "http://h/a/b/", "http://h/a/./b/../c")
REFERENCES = "g:h|g|./g|g/|/g|//g|?y|g?y|#s|g#s|g?y#s|;x|g;x|g;x?y#s||.|./|..|../|../g|../..|../../|../../g|../../../g|../../../../g|/./g|/../g|g.|.g|g..|..g|./../g|./g/.|g/./h|g/../h|g;x=1/./y|g;x=1/../y|g?y/./x|g?y/../x|g#s/./x|g#s/../x|a/../../x| /sp ace |mailto:a@b|http://q.org|?a?b|#a#b|g/../../..".split("|")


def test_references(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("x")).collect()
    assert [(r["b"], r["r"], r["x"]) for r in got] == [(b, r, urljoin(b, r.strip())) for b, r in rows]
    odd = spark.createDataFrame([(None, "a"), ("http://a/", None), ("http://a/b", "c\n/d"), ("", "x/../y"), ("http://a/b", "//h/../x"), ("http://a/b", "http://c/./d/..")], "b string, r string")
    assert [r[0] for r in odd.select(urls.resolve(F.col("b"), F.col("r"))).collect()] == [None, None, "http://a/c/d", "y", "http://h/x", "http://c/"]


def test_punycode(spark):
    rng = random.Random(1)
    letters = "abc-1üßéñ漢字кириллицаÄ日本語ไทย𝒳😀"
    labels = [x for x in ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(500)) if not x.isascii()] + ["é" * 63, "\U0010ffff", "\x80"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", urls.punycode(F.col("x")).alias("p")).collect()
    assert [(r["x"], r["p"]) for r in got] == [(x, x.encode("punycode").decode()) for x in labels]


def test_hosts(spark):
    want = {"Bücher.DE": "xn--bcher-kva.de", "a.b": "a.b", "日本。jp": "xn--wgv71a.jp", "": "", "xn--a.b": "xn--a.b", None: None}
    got = spark.createDataFrame([(x,) for x in want], "x string").select("x", urls.ascii_host(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == want
    valid = {"a.b": True, "bücher.de": True, "-a.b": False, "a-.b": False, "a..b": False, "": False, "ab--c.d": False, "xn--bcher-kva.de": True, "a" * 63 + ".b": True, "a" * 64 + ".b": False, "ü" * 60 + ".b": False, "a_b.c": False, "́a.b": False, "हिन्दी.भारत": True, ".".join(["a" * 60] * 5): False, None: False}
    got = spark.createDataFrame([(x,) for x in valid], "x string").select("x", urls.valid_host(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == valid


def test_addresses_of_any_script(spark):
    want = {
        "a@b.org": True, "jürgen@bücher.de": True, "x@日本。jp": True, "a@" + "ü" * 60 + ".de": False, "a@b": False, "a@@b.org": False, "a b@c.org": False, "a@b.1": False, "a@-b.org": False, "a@b.localhost": False,
        "a" * 64 + "@b.org": True, "a" * 65 + "@b.org": False, "ü" * 64 + "@" + "a" * 60 + "." + "b" * 61 + ".org": False, "a@" + ".".join(["b" * 62] * 4) + ".org": False, "": False, None: False, "a@xn--bcher-kva.de": True, ".a@b.org": False, "a..b@c.org": False,
    }
    got = spark.createDataFrame([(x,) for x in want], "x string").select("x", checks.syntax_ok(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == want


def test_rules_are_a_parameter(spark):
    lines = ["// comment", "com", "*.uk  x", "!city.uk", "b.c.d.e", "", "// ===BEGIN PRIVATE DOMAINS===", "blogs.com", "// ===END PRIVATE DOMAINS===", "भारत"]
    for private, blog in ((False, "blogs.com"), (True, "me.blogs.com")):
        rules = urls.suffixes(lines, private)
        want = {"a.me.blogs.com": blog, "x.y.co.uk": "y.co.uk", "x.city.uk": "city.uk", "x.a.b.c.d.e": "a.b.c.d.e", "z.d.e": "z.d.e", "q.xn--h2brj9c": "q.xn--h2brj9c", "uk": "uk"}
        got = spark.createDataFrame([(x,) for x in want], "x string").select("x", urls.registrable(F.col("x"), rules).alias("y")).collect()
        assert {r["x"]: r["y"] for r in got} == want


def test_anchors_of_any_quotes(spark):
    html = """<html><head><BASE target=x href='../sub/?q'></head><a href=plain.html>One</a> <a class="x > y" title='a href="no"' HREF = "/q?a=b&amp;c">Two <b>b</b></a>
    <a data-href="no">none</a><a name=x>none</a><a href=''>empty</a><footer class=f><a id="i" href='#top'>Top</a></footer><abbr href="no">x</abbr>"""
    df = spark.createDataFrame([(1, "https://www.acme.com/a/b/c", html), (2, "https://x.org", None), (3, None, "<a href='x'>y</a>")], "page_id long, url string, html string")
    rows = links.resolved(links.anchors(df)).collect()
    assert sorted((r["href"], r["target"], r["anchor"], r["footer"]) for r in rows if r["page_id"] == 1) == [
        ("", "https://www.acme.com/a/sub/?q", "empty", False),
        ("#top", "https://www.acme.com/a/sub/?q#top", "Top", True),
        ("/q?a=b&amp;c", "https://www.acme.com/q?a=b&amp;c", "Two b", False),
        ("plain.html", "https://www.acme.com/a/sub/plain.html", "One", False),
    ]
    assert [r["target"] for r in rows if r["page_id"] != 1] == [None]
