"""Landed payloads, pages and mail made of the tables' rows in their outer form, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.functions import web
from leadline.model import frame, sql
from leadline.plans.registry import query
from leadline.sources import exports, landed

PLACE_SQL = """SELECT 'p' || company_id AS place_id, company_name AS name, CASE WHEN company_id % 6 <> 0 THEN 'https://' || domain END AS website, CASE WHEN company_id % 6 = 0 THEN 'https://www.facebook.com/firm' || company_id END AS facebook, phone, city, CASE WHEN company_id % 2 = 0 THEN 'Ohio' END AS state, CASE company_id % 3 WHEN 0 THEN upper(industry[1]) || lower(industry[2:]) WHEN 1 THEN industry END AS industry, latitude FROM companies"""


@query(sql(PLACE_SQL))
def landed_places(spark: SparkSession, d: str) -> DataFrame:
    """OP-I04, I05, I06: places of search payloads: a social address is no website, components by kind, the kind's shown name before its own."""
    k = F.col("company_id")
    part = lambda text, kind: F.struct(text.alias("longText"), F.array(F.lit("political"), F.lit(kind)).alias("types"))
    site = F.when(k % 6 == 0, F.concat(F.lit("https://www.facebook.com/firm"), k)).otherwise(F.concat(F.lit("https://"), "domain"))
    parts = F.filter(F.array(part(F.when(k % 2 == 0, "Ohio"), "administrative_area_level_1"), part(F.col("city"), "locality"), part(F.lit("Second"), "locality")), lambda p: p["longText"].isNotNull())
    place = F.struct(F.concat(F.lit("p"), k).alias("id"), F.struct(F.col("company_name").alias("text")).alias("displayName"), site.alias("websiteUri"), F.col("phone").alias("internationalPhoneNumber"), F.struct("latitude", "longitude").alias("location"), parts.alias("addressComponents"), F.when(k % 3 == 0, F.lower("industry")).alias("primaryType"), F.when(k % 3 == 1, F.struct(F.col("industry").alias("text"))).alias("primaryTypeDisplayName"))
    body = frame(spark, d, "companies").groupBy("job_id").agg(F.to_json(F.struct(F.collect_list(place).alias("places"))).alias("body"))
    return landed.places(body).select("place_id", "name", "website", "facebook", "phone", "city", "state", "industry", "latitude")


def hidden(email: F.Column, key: int = 0x42) -> F.Column:
    """An address as hexadecimal digits, each byte combined with the key, which stands first."""
    digits = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    return F.concat(F.lit(f"{key:02x}"), F.array_join(F.transform(F.split(email, ""), lambda c: digits(F.ascii(c).bitwiseXOR(F.lit(key)))), ""))


FOUND = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: A page's text as SQL reads it: without scripts, styles and tags, hidden addresses written out.
SEEN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s*[\[({]\s*at\s*[\])}]\s*', '@', 'gi'), '\s*[\[({]\s*dot\s*[\])}]\s*', '.', 'gi'), '\s+at\s+', '@', 'gi'), '\s+dot\s+', '.', 'gi')"""


@query(rf"""SELECT kind, id, coalesce(l[1], '') AS best, array_to_string(list_sort(list_distinct(l)), ' ') AS emails FROM (SELECT kind, id, list_filter(list_concat(CASE WHEN top <> '' THEN [lower(top)] ELSE [] END, list_transform(regexp_extract_all({SEEN}, '{FOUND}'), lambda e: lower(e))), lambda e: NOT (split_part(e, '@', 2) IN ({", ".join(f"'{x}'" for x in web.PLACEHOLDER_DOMAINS)}) OR regexp_extract(e, '([^.]*)$', 1) IN ({", ".join(f"'{x}'" for x in web.ASSET_TLDS)}))) AS l
 FROM (SELECT 'page' AS kind, page_id AS id, '' AS top, html AS h FROM pages UNION ALL SELECT 'document', doc_id, CASE WHEN doc_id % 4 >= 2 THEN regexp_extract(text, '{FOUND}') ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN replace(text, '@', ' [at] ') ELSE text END FROM documents WHERE text IS NOT NULL))""")
def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    """OP-S18 to S22: addresses of every whole page, and of every text as a page: by turns written out, written with [at], with its first address also as a link, or
    hidden by exclusive or; in order of trust, linked before hidden before written; placeholders and file names go."""
    k, text = F.col("doc_id"), F.col("text")
    e = F.regexp_extract(text, FOUND, 0)
    link = F.concat(text, F.lit('<a class=x href="mailto:'), e, F.lit('?subject=hi">mail</a>'))
    hide = F.concat(text, F.lit('<i data-cfemail="'), hidden(e), F.lit('"></i>'))
    html = F.when(k % 4 == 1, F.regexp_replace(text, "@", " [at] ")).when((k % 4 == 2) & (e != ""), link).when((k % 4 == 3) & (e != ""), hide).otherwise(text)
    texts = frame(spark, d, "documents").where("text IS NOT NULL").select(F.lit("document").alias("kind"), k.alias("id"), html.alias("html"))
    every = frame(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "html").union(texts)
    got = landed.page_contacts(every.withColumn("key", F.struct("kind", "id")), "key")
    return got.select("key.kind", "key.id", F.coalesce(F.get("emails", 0), F.lit("")).alias("best"), F.array_join(F.array_sort("emails"), " ").alias("emails"))


@query(sql("""SELECT company_id, company_name AS organization, coalesce(phone, '') AS telephones, 'Way 1, ' || city AS address, coalesce(jobs, '') AS jobs FROM companies LEFT JOIN (SELECT company_id, string_agg(coalesce(title, 'Clerk'), ',' ORDER BY signal_id) AS jobs FROM signals GROUP BY 1) USING (company_id)"""))
def structured_pages(spark: SparkSession, d: str) -> DataFrame:
    """OP-S30, S31: organisations, addresses and postings of pages' structured data."""
    posting = F.struct(F.lit("JobPosting").alias("@type"), F.coalesce("title", F.lit("Clerk")).alias("title"), F.col("posted_at").cast("string").alias("datePosted"))
    jobs = frame(spark, d, "signals").groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("signal_id", posting.alias("p")))), lambda x: x["p"]).alias("jobs"))
    c = frame(spark, d, "companies").join(jobs, "company_id", "left")
    org = F.struct(F.array(F.lit("LocalBusiness")).alias("@type"), F.col("company_name").alias("name"), F.col("phone").alias("telephone"), F.struct(F.lit("Way 1").alias("streetAddress"), F.col("city").alias("addressLocality")).alias("address"))
    block = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    html = F.concat(block(F.to_json(org)), F.coalesce(block(F.to_json("jobs")), F.lit("")), F.lit("<p>text</p>"))
    got = landed.page_contacts(c.select("company_id", html.alias("html")), "company_id")
    return got.select("company_id", F.col("ld.organization").alias("organization"), F.array_join("ld.telephones", ",").alias("telephones"), F.col("ld.address").alias("address"), F.array_join(F.transform("ld.jobs", lambda j: j["title"]), ",").alias("jobs"))


@query(sql("""SELECT company_id, full_name AS name, arg_min(designation, contact_id) AS designation, 0.9::DOUBLE AS confidence FROM contacts WHERE full_name IS NOT NULL AND designation = 'Chief Technology Officer' GROUP BY 1, 2"""))
def team_pages(spark: SparkSession, d: str) -> DataFrame:
    """OP-S29, A21: people of the cards of a team page, each once; cards without a person or a role go."""
    k = F.col("contact_id")
    card = lambda a, b: F.concat(F.lit('<div class="grid-item team-member"><h3>'), a, F.lit("</h3><p>"), b, F.lit("</p></div>"))
    html = F.concat(card(F.coalesce("full_name", F.lit("Learn More")), F.col("designation")), F.when(k % 2 == 0, card(F.lit("Main Office"), F.lit("Chief Technology Officer"))).otherwise('<div class="teaser">Team of the year</div>'))
    c = frame(spark, d, "contacts").where("designation = 'Chief Technology Officer'").groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contact_id", html.alias("h")))), lambda x: x["h"]), "").alias("html"))
    return landed.team_cards(c, "company_id").select("company_id", "name", "designation", "confidence")


@query(sql("""SELECT company_id, CASE WHEN company_id % 2 = 0 THEN 'https://www.linkedin.com/company/l' || company_id ELSE 'https://linkedin.com/company/a' || company_id END AS linkedin, CASE WHEN company_id % 3 <> 0 THEN 'https://facebook.com/f' || company_id END AS facebook FROM companies"""))
def page_socials(spark: SparkSession, d: str) -> DataFrame:
    """OP-S14, S15: the first address of each network, a page's structured data before its links."""
    k = F.col("company_id")
    ld = F.when(k % 2 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "Organization", "name": "x", "sameAs": ["https://www.linkedin.com/company/l'), k, F.lit('"]}</script>'))).otherwise("")
    link = lambda x: F.concat(F.lit("<a class=x href='"), x, F.lit("'>go</a>"))
    at = lambda s: F.concat(F.lit(s), k)
    html = F.concat(link(at("https://linkedin.com/company/a")), link(F.lit("https://facebook.com/sharer/x")), F.when(k % 3 != 0, F.concat(link(at("https://facebook.com/f")), link(F.lit("https://facebook.com/later")))).otherwise(""), ld)
    got = landed.social_links(frame(spark, d, "companies").select("company_id", html.alias("html")), "company_id")
    return got.select("company_id", F.col("social")["linkedin"].alias("linkedin"), F.col("social")["facebook"].alias("facebook"))


@query("""SELECT t, n, x FROM (SELECT 0 AS t, 0::BIGINT AS n, '{"region":[' AS x UNION ALL SELECT 0, r, CASE WHEN r > 1 THEN ',' ELSE '' END || j FROM (SELECT row_number() OVER (ORDER BY j) AS r, j FROM (SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS j FROM region)) UNION ALL SELECT 0, 4611686018427387904, ']' UNION ALL SELECT 1, 0, ',"nation":[' UNION ALL SELECT 1, r, CASE WHEN r > 1 THEN ',' ELSE '' END || j FROM (SELECT row_number() OVER (ORDER BY j) AS r, j FROM (SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS j FROM nation)) UNION ALL SELECT 1, 4611686018427387904, ']}')""")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    """OP-K03: the lines of one document {tab: rows}."""
    return exports.json_lines({"region": frame(spark, d, "region").select("r_regionkey", "r_name"), "nation": frame(spark, d, "nation").select("n_nationkey", "n_name")})
