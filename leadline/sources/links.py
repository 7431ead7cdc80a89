"""Links of landed pages, resolved, and which of them a crawl follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.functions import urls, web

ANCHOR, FOOTER = urls.TAG.format("a") + r".*?</a\s*>", r"(?is)<footer[\s>].*?</footer\s*>"


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, base, footer, place, href, anchor): every anchor with an address, in order, those of footers numbered apart; base is what
    the page's references stand against. Null pages have none."""
    rows = pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("_h"), urls.base_of(F.col(html), F.col(url)).alias("base"))
    inside = F.array_join(F.regexp_extract_all("_h", F.lit(FOOTER), F.lit(0)), " ")
    found = lambda text, footer: rows.select(key, "url", "base", F.lit(footer).alias("footer"), F.posexplode(F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(0))).alias("place", "_a"))
    every = found(inside, True).union(found(F.regexp_replace("_h", FOOTER, " "), False))
    anchor = F.trim(F.regexp_replace(F.regexp_replace("_a", urls.ANY_TAG, " "), r"\s+", " "))
    return every.select(key, "url", "base", "footer", "place", urls.attribute(F.col("_a"), "href").alias("href"), anchor.alias("anchor")).where("href IS NOT NULL")


def resolved(links: DataFrame) -> DataFrame:
    """links with `target`: the address that each href stands for."""
    return links.withColumn("target", urls.resolve(F.col("base"), F.col("href")))


def followed(links: DataFrame, key: str = "page_id", most: int = 8, rules: urls.Suffixes = urls.COMMON) -> DataFrame:
    """(key, url, score, place): of each page the `most` best links to its own registrable domain but not to itself, one a canonical form.

    Hosts are few among links: the domain of each distinct one is found once and joined back.
    """
    named = resolved(links.where("href <> '' AND NOT startswith(href, '#')")).where(F.col("target").rlike("(?i)^https?://"))
    named = named.withColumns({"_to": web.host(F.col("target")), "_own": web.host(F.col("url"))})
    hosts = named.select(F.explode(F.array("_to", "_own")).alias("_host")).distinct().withColumn("_domain", web.registrable_domain(F.col("_host"), rules))
    of = lambda c: hosts.select(F.col("_host").alias(c), F.col("_domain").alias(f"{c}_domain"))
    own = named.join(of("_to"), "_to").join(of("_own"), "_own").where("_to_domain = _own_domain")
    scored = own.select(key, web.canonical_url(F.col("target")).alias("to"), web.canonical_url(F.col("url")).alias("_self"), web.link_score(F.col("target"), F.col("anchor"), F.col("footer")).alias("score")).where("to <> _self")
    best = scored.groupBy(key, F.col("to").alias("url")).agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "url"))).where(F.col("place") <= most)
