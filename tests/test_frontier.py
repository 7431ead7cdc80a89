"""Links of a page: own domain, anchor text, footer."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.functions import web
from leadline.plans import QUERIES


def test_site_frontier(spark, tmp_path):
    out = "".join(f'<a href="https://other{i}.com/contact">Contact</a>' for i in range(20))
    page = out + """<p><a class=x href='/x1'>Contact <b>us</b></a> <a href="mailto:a@b.c">contact</a> <a href="#team">team</a> <a data-href="/no" href="//blog.acme.co.uk/p/">Read</a>
    <a href="y?z">more</a> <a href="https://www.acme.co.uk/">home</a> <a href="https://beta.co.uk/team">team</a></p><footer><a href="/legal/">Legal</a> <a href="/f">x</a></footer>"""
    spark.createDataFrame([(1, "https://www.acme.co.uk", page), (2, "", page), (3, "http://a.org", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["score"], r["url"], r["place"]) for r in QUERIES["site_frontier"](spark, str(tmp_path)).collect()), key=lambda x: x[2])
    base = "https://www.acme.co.uk"
    assert got == [(100, f"{base}/x1", 1), (50, f"{base}/legal", 2), (0, "https://blog.acme.co.uk/p", 3), (0, f"{base}/f", 4), (0, f"{base}/y?z", 5)]


def test_registrable_domain(spark):
    want = {"http://a.b.acme.co.uk/x": "acme.co.uk", "www.acme.com": "acme.com", "http://10.0.0.1/": "10.0.0.1", "http://a.example/": "a.example", "http://x.a.test": "x.a.test", "https://blog.acme.co.uk/x": "acme.co.uk", "http://127.0.0.1:8080/x": "127.0.0.1", "http://[::1]:80/": "[::1]", "http://bücher.Müller.de": "xn--mller-kva.de", "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "www.ck": "www.ck", "y.www.ck": "www.ck", "city.kawasaki.jp": "city.kawasaki.jp", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "co.uk": ".co.uk", "http://localhost:80": "localhost", "http://x.co.org/": "co.org", "acme.com.": "acme.com"}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", web.registrable_domain(F.col("u")).alias("d")).collect()
    assert {r["u"]: r["d"] for r in got} == want
