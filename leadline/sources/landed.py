"""Landed payloads as columns: structured data of pages, delivery reports, provider JSON and robots rules."""

from __future__ import annotations

import email
import email.policy
import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.functions import people, web

PLACE = "places array<struct<id string, displayName struct<text string>, formattedAddress string, internationalPhoneNumber string, websiteUri string, rating double, userRatingCount int, location struct<latitude double, longitude double>, addressComponents array<struct<longText string, types array<string>>>, primaryType string, primaryTypeDisplayName struct<text string>>>"


def places(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per place of search payloads (OP-I04 to I06): a social host is no website, a facebook page is kept apart; the first component of each kind counts; malformed JSON gives no rows."""
    p = payloads.select(F.explode(F.from_json(body, PLACE)["places"]).alias("p"))
    part = lambda *kinds: F.try_element_at(F.filter("p.addressComponents", lambda c: F.arrays_overlap(c["types"], F.array(*map(F.lit, kinds)))), F.lit(1))["longText"]
    site, social = F.col("p.websiteUri"), web.is_non_company(F.col("p.websiteUri"))
    rows = p.select(
        F.col("p.id").alias("place_id"),
        F.col("p.displayName.text").alias("name"),
        F.when(~social, site).alias("website"),
        F.when(web.host(site).rlike(r"(^|[.])facebook[.]com$"), site).alias("facebook"),
        F.col("p.internationalPhoneNumber").alias("phone"),
        F.col("p.formattedAddress").alias("address"),
        part("locality", "postal_town").alias("city"),
        part("administrative_area_level_1").alias("state"),
        part("country").alias("country"),
        part("postal_code").alias("postal_code"),
        F.coalesce("p.primaryTypeDisplayName.text", F.initcap(F.regexp_replace("p.primaryType", "_", " "))).alias("industry"),
        F.col("p.location.latitude").alias("latitude"),
        F.col("p.location.longitude").alias("longitude"),
        F.col("p.rating").alias("rating"),
        F.col("p.userRatingCount").alias("reviews"),
    )
    return rows.dropDuplicates(["place_id"])


def _objects(blocks: list[str]):
    """Every JSON-LD object of the blocks, those of lists and @graph too."""
    for block in blocks:
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                if isinstance(x.get("@graph"), list):
                    todo = x["@graph"] + todo
                yield x


def _strings(x) -> list[str]:
    return [s for s in (x if isinstance(x, list) else [x]) if isinstance(s, str)]


JSONLD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)
STRUCTURED = "organization string, urls array<string>, emails array<string>, telephones array<string>, address string, people array<struct<name string, title string>>, jobs array<struct<title string, posted string>>"


def structured(html: str | None) -> dict:
    out = {"organization": None, "urls": [], "emails": [], "telephones": [], "address": None, "people": [], "jobs": []}
    for x in _objects(JSONLD.findall(html or "")):
        kinds = _strings(x.get("@type"))
        if "Person" in kinds and isinstance(x.get("name"), str):
            out["people"].append({"name": x["name"], "title": next(iter(_strings(x.get("jobTitle"))), None)})
        elif "JobPosting" in kinds and isinstance(x.get("title"), str):
            out["jobs"].append({"title": x["title"], "posted": next(iter(_strings(x.get("datePosted"))), None)})
        elif any(k.endswith(("Organization", "Business", "Corporation", "Service")) for k in kinds):
            out["organization"] = out["organization"] or next(iter(_strings(x.get("name"))), None)
            out["urls"] += _strings(x.get("sameAs"))
            points = x.get("contactPoint") or []
            for y in [x, *(points if isinstance(points, list) else [points])]:
                if isinstance(y, dict):
                    out["emails"] += _strings(y.get("email"))
                    out["telephones"] += _strings(y.get("telephone"))
            a = x.get("address")
            if out["address"] is None and a:
                parts = [a] if isinstance(a, str) else [a.get(k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")] if isinstance(a, dict) else []
                out["address"] = ", ".join(s for s in parts if isinstance(s, str) and s) or None
    return out


#: Pages that are read into Python's objects at once; an Arrow batch holds more.
READ = 256
_TYPE = pa.struct([("organization", pa.string()), *((n, pa.list_(pa.string())) for n in ("urls", "emails", "telephones")), ("address", pa.string()), ("people", pa.list_(pa.struct([("name", pa.string()), ("title", pa.string())]))), ("jobs", pa.list_(pa.struct([("title", pa.string()), ("posted", pa.string())])))])


def _structured(html: pa.Array) -> pa.Array:
    parts = [pa.array([structured(h) for h in html.slice(i, READ).to_pylist()], _TYPE) for i in range(0, len(html), READ)]
    return pa.concat_arrays(parts) if parts else pa.array([], _TYPE)


def structured_data(html: Column) -> Column:
    return F.arrow_udf(_structured, STRUCTURED)(html)


def page_contacts(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, emails, ld): addresses of a page in order of trust, mailto, hidden by exclusive or, then written out, with assets and placeholders left out, and its structured data (OP-S18 to S22, S30, S31); null pages have none."""
    h = F.coalesce(F.col(html), F.lit(""))
    mailto = F.regexp_extract_all(h, F.lit(r'(?i)href="mailto:([^"?]+)'), F.lit(1))
    hidden = F.transform(F.regexp_extract_all(h, F.lit(r'data-cfemail="((?:[0-9a-fA-F]{2}){4,})"'), F.lit(1)), web.cfemail)
    text = web.deobfuscate(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))
    plain = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))
    every = F.array_distinct(F.transform(F.concat(mailto, hidden, plain), lambda e: F.lower(F.trim(e))))
    return pages.select(key, F.filter(every, lambda e: ~web.is_asset_or_placeholder(e)).alias("emails"), structured_data(h).alias("ld"))


REPORT = "final_recipient string, smtp_status string, diagnostic string, original_id string"


def report(raw: bytes | None) -> dict:
    out = dict.fromkeys(("final_recipient", "smtp_status", "diagnostic", "original_id"))
    texts = []
    for part in email.message_from_bytes(raw or b"", policy=email.policy.compat32).walk():
        kind = part.get_content_type()
        for k, name in (("final_recipient", "Final-Recipient"), ("smtp_status", "Status"), ("diagnostic", "Diagnostic-Code")):
            if part.get(name) and out[k] is None:
                out[k] = " ".join(str(part[name]).rpartition(";")[2].split())
        if kind == "message/rfc822" or kind == "text/rfc822-headers":
            inner = part.get_payload()
            inner = inner[0] if isinstance(inner, list) and inner else email.message_from_string(inner if isinstance(inner, str) else "")
            out["original_id"] = out["original_id"] or inner.get("Message-ID")
        elif kind.startswith("text/"):
            texts.append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
    text = re.sub(r"<[^>]*>", " ", " ".join(texts))
    if out["smtp_status"] is None and (m := re.search(r"\b([245]\.\d{1,3}\.\d{1,3})\b", text)):
        out["smtp_status"] = m[1]
    if out["final_recipient"] is None and (m := re.search(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", text)):
        out["final_recipient"] = m[0]
    if out["diagnostic"] is None and out["smtp_status"] and text.strip():
        out["diagnostic"] = " ".join(text.split())[:500]
    return out


def _reports(raw: pd.Series) -> pd.DataFrame:
    nothing = report(None)
    return pd.DataFrame([nothing if r is None else report(bytes(r)) for r in raw], columns=["final_recipient", "smtp_status", "diagnostic", "original_id"])


def _plain_report(text: Column) -> Column:
    """The fields of a report whose delivery-status part is plain lines; null of any other text, which a mail parser reads."""
    part = F.regexp_extract(text, r"(?is)\nContent-Type:[ \t]*message/delivery-status[^\n]*\n(.*?)(?=\n--|$)", 1)
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract(part, rf"(?im)^{name}:(?:[^\n]*;)?([^\n]*)$", 1), r"\s+", " "))
    inner = F.regexp_extract(text, r"(?is)\nContent-Type:[ \t]*(?:message/rfc822|text/rfc822-headers)[^\n]*\n\n(.*?)(?:\n\n|$)", 1)
    known = F.struct(
        field("Final-Recipient").alias("final_recipient"),
        field("Status").alias("smtp_status"),
        field("Diagnostic-Code").alias("diagnostic"),
        F.nullif(F.trim(F.regexp_extract(inner, r"(?im)^Message-ID:([^\n]*)$", 1)), F.lit("")).alias("original_id"),
    )
    root = F.regexp_extract(text, r"(?s)^(.*?)(?:\n\n|$)", 1)
    strange = text.rlike(r"(?im)^Content-Transfer-Encoding:[ \t]*(?:base64|quoted-printable)") | part.rlike(r"\n[ \t]+\S") | inner.rlike(r"(?im)^Message-ID:[^\n]*\n[ \t]") | root.rlike(r"(?im)^(?:Status|Final-Recipient|Diagnostic-Code):") | F.contains(text, F.lit("\r"))
    one = F.regexp_count(text, F.lit(r"(?i)message/(?:delivery-status|rfc822)|text/rfc822-headers")) == F.when(inner != "", 2).otherwise(1)
    return F.when(~strange & one & (known["final_recipient"] != "") & (known["smtp_status"] != "") & (known["diagnostic"] != ""), known)


def delivery_reports(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """messages with a report and the kind of bounce (OP-S50, S51, S53); bytes that are no report are of kind unknown.

    Reports of plain lines, the common form, are read by patterns; only others reach the mail parser, a batch of them at a time.
    """
    rows = messages.withColumn("_plain", _plain_report(F.col(raw).cast("string")))
    parsed = F.pandas_udf(_reports, REPORT)(F.when(F.col("_plain").isNull(), F.col(raw)))
    rows = rows.withColumn("_parsed", parsed).withColumn("report", F.coalesce("_plain", "_parsed")).drop("_plain", "_parsed")
    return rows.withColumn("bounce_type", web.classify_bounce(F.col("report.smtp_status"), F.col("report.diagnostic"))).withColumn("sent_id", F.nullif(F.regexp_extract(F.coalesce("report.original_id", F.lit("")), r"lm-([0-9a-fA-F-]{36})@", 1), F.lit("")))


def robots_rules(body: Column) -> Column:
    """Array of path prefixes that the group of every agent disallows (OP-I15); none where the file is missing."""
    group = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?is)user-agent:\s*\*\s*\n(.*?)(?=\nuser-agent:|$(?![\r\n]))", 1)
    return F.filter(F.regexp_extract_all(group, F.lit(r"(?im)^disallow:[ \t]*(\S*)"), F.lit(1)), lambda p: p != "")


def crawl_delay(body: Column) -> Column:
    """Seconds, 10 at most; null if not stated."""
    seconds = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?im)^crawl-delay:\s*([0-9.]+)", 1).try_cast("double")
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(10.0)))


#: What a class of people's cards holds.
CARD_WORDS = ("team", "member", "person", "staff", "people", "profile", "leader", "bio", "employee", "attorney")


class _Cards(HTMLParser):
    """Lines of text of the elements whose class speaks of people, by class, in order."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, list[list[str]]]] = []
        self.found: dict[str, list[list[str]]] = {}
        self.quiet = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"):
            return
        self.quiet += tag in ("script", "style")
        cards = []
        for c in dict.fromkeys((dict(attrs).get("class") or "").split()):
            if any(w in c.lower() for w in CARD_WORDS):
                cards.append([])
                self.found.setdefault(c, []).append(cards[-1])
        self.open.append((tag, cards))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, _ = self.open.pop()
                self.quiet -= t in ("script", "style")
                if t == tag:
                    break

    def handle_data(self, data):
        line = " ".join(data.split())
        if line and not self.quiet:
            for _, cards in self.open:
                for c in cards:
                    c.append(line)


def card_lines(html: str | None) -> list[list[str]]:
    """Of the commonest class of people's cards (of equal ones the first) the lines of each card."""
    p = _Cards()
    p.feed(html or "")
    p.close()
    return max(p.found.values(), key=len, default=[])


def _card_lines(html: pd.Series) -> pd.Series:
    return html.map(card_lines)


def team_cards(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, name, designation, seniority, role_category, confidence): people of a page's cards, each name once (OP-S29, A21).

    A name is a card's first line that can be a person's and no short designation; a designation its first line of at most 120
    letters that names a role. Confidence: 0.55, 0.15 for two or three words, 0.15 for who decides, 0.05 for a short line.
    """
    cards = pages.select(key, F.posexplode(F.pandas_udf(_card_lines, "array<array<string>>")(F.col(html))).alias("no", "lines"))
    words = lambda x: F.size(F.split(x, " "))
    names = F.filter("lines", lambda x: people.plausible_name(x) & ~(web.designation(x)["role"].isNotNull() & (words(x) <= 3)))
    titles = F.filter("lines", lambda x: (F.length(x) <= 120) & web.designation(x)["role"].isNotNull())
    rows = cards.select(key, "no", F.get(names, 0).alias("name"), F.get(titles, 0).alias("designation")).where("name is not null and designation is not null")
    rows = rows.withColumn("_d", web.designation(F.col("designation")))
    sure = F.lit(0.55) + F.when(words(F.col("name")).between(2, 3), 0.15).otherwise(0.0) + F.when(F.col("_d.seniority").isin("c_level", "owner", "senior"), 0.15).otherwise(0.0) + F.when(F.length("designation") <= 60, 0.05).otherwise(0.0)
    rows = rows.select(key, "no", "name", "designation", F.col("_d.seniority").alias("seniority"), F.col("_d.role").alias("role_category"), F.round(F.least(sure, F.lit(0.95)), 3).alias("confidence"))
    first = rows.groupBy(key, F.lower("name").alias("_n")).agg(F.min_by(F.struct("name", "designation", "seniority", "role_category", "confidence"), "no").alias("x"))
    return first.select(key, "x.*")


def first_social(urls: Column) -> Column:
    """Of addresses in order of trust the first of each network, as a map."""
    every = F.transform(urls, lambda u: F.struct(web.social_kind(u).alias("kind"), u.alias("url")))
    known = F.filter(every, lambda x: x["kind"].isNotNull())
    firsts = F.filter(known, lambda x, i: ~F.exists(F.slice(known, 1, i), lambda y: y["kind"] == x["kind"]))
    return F.map_from_entries(firsts)


def social_links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, social): of each page the first address of each network, those of its structured data before its anchors (OP-S15)."""
    h = F.coalesce(F.col(html), F.lit(""))
    anchors = F.regexp_extract_all(h, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))
    rows = pages.select(key, anchors.alias("_a"), structured_data(h).alias("_ld"))
    return rows.select(key, first_social(F.concat(F.coalesce("_ld.urls", F.expr("cast(array() as array<string>)")), "_a")).alias("social"))
