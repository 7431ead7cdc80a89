"""Validation of addresses by all its stages, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline import operators as op
from leadline.functions import checks, people, phones, web
from leadline.model import frame, frames, sql
from leadline.plans.registry import query

#: A tenant's rules as they are stored, some of them out of range.
STORED = {"llm_mode": "HARD", "llm_threshold": "0.3", "catch_all_policy": "Allow", "risk_policy": "odd", "role_keywords": ["Sales", " info ", "", 7], "unknown_retry": 2}
RULES = checks.decode_rules(STORED)
THROWN = ["Corp.Throw.Example"]


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Each address with the word of every stage; the last two are asked only where no earlier one fails."""
    t = frames(spark, d, ["addresses", "suppressions"], ["contacts"])
    a = t["addresses"].withColumn("email", F.lower(F.trim("raw")))
    e = F.col("email")
    rows = a.select("candidate_id", "contact_id", "email", checks.syntax_ok(e).alias("syntax_ok"), checks.disposable(e, THROWN).alias("disposable"), checks.role_based(e, RULES["role_keywords"]).alias("role_based"))
    rows = rows.withColumn("mx_status", checks.mx_status(e, F.col("syntax_ok")))
    asked = F.col("syntax_ok") & ~F.col("disposable") & ~F.col("role_based") & (F.col("mx_status") != "fail")
    unit = checks.stable_unit(e, F.lit("mv"))
    said = F.when(unit < 0.55, "valid").when(unit < 0.7, "catch_all").when(unit < 0.8, "risk").when(unit < 0.9, "invalid").otherwise("unknown")
    rows = rows.withColumn("llm_score", F.when(asked, F.round(checks.stable_unit(e, F.lit("llm")), 6))).withColumn("mv_status", F.when(asked, said))
    s = t["suppressions"]
    return op.suppressed(rows, s.where("email is not null").select("email"), s.where("domain is not null").select("domain"))


HEX = lambda salt: f"(('0x' || substr(sha256(email || '|{salt}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
DOMAIN = "nullif(regexp_replace(lower(trim(split_part(email, '@', -1))), '\\.+$', ''), '')"
STAGED = rf"""SELECT candidate_id, contact_id, email, syntax_ok, disposable, role_based, mx_status, CASE WHEN asked THEN round({HEX('llm')}, 6) END AS llm_score, CASE WHEN asked THEN CASE WHEN {HEX('mv')} < 0.55 THEN 'valid' WHEN {HEX('mv')} < 0.7 THEN 'catch_all' WHEN {HEX('mv')} < 0.8 THEN 'risk' WHEN {HEX('mv')} < 0.9 THEN 'invalid' ELSE 'unknown' END END AS mv_status,
 email IN (SELECT lower(email) FROM suppressions WHERE email IS NOT NULL) OR split_part(email, '@', -1) IN (SELECT lower(domain) FROM suppressions WHERE domain IS NOT NULL) AS suppressed FROM (SELECT *, syntax_ok AND NOT disposable AND NOT role_based AND mx_status <> 'fail' AS asked FROM (SELECT *, CASE WHEN NOT syntax_ok THEN 'skipped' WHEN dom IS NULL OR dom IN ('tempmail.com', 'yopmail.com', 'guerrillamail.com', 'mailinator.com') THEN 'fail' ELSE 'pass' END AS mx_status FROM (SELECT *,
 regexp_matches(email, '^[\p{{L}}\p{{N}}!#$%&''*+/=?^_`{{|}}~-]+([.][\p{{L}}\p{{N}}!#$%&''*+/=?^_`{{|}}~-]+)*@([\p{{L}}\p{{N}}]([\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?[.])+\p{{L}}([\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])$') AND NOT regexp_matches(email, '[.](arpa|invalid|local|localhost|onion|test)$') AND length(email) <= 254 AS syntax_ok,
 coalesce(dom IN ('tempmail.com', 'yopmail.com', 'guerrillamail.com', 'mailinator.com', '10minutemail.com', 'corp.throw.example'), false) AS disposable, regexp_matches(email, '(^|[._+-])(sales|info)([._+-][^@]*)?@[^@]*$') AS role_based FROM (SELECT *, CASE WHEN position('@' IN email) > 0 THEN {DOMAIN} END AS dom FROM (SELECT candidate_id, contact_id, lower(trim(raw)) AS email FROM addresses)))))"""
DECIDED = "CASE WHEN suppressed THEN 'SUPPRESSED' WHEN NOT syntax_ok THEN 'INVALID_SYNTAX' WHEN disposable THEN 'DISPOSABLE_REJECTED' WHEN role_based THEN 'ROLE_BASED_REJECTED' WHEN mx_status = 'fail' THEN 'MX_FAILED' WHEN llm_score < 0.3 THEN 'LLM_LOW_CONFIDENCE' WHEN mv_status IS NULL OR mv_status = 'valid' THEN 'VERIFIED' WHEN mv_status = 'invalid' THEN 'PROVIDER_INVALID' WHEN mv_status = 'catch_all' THEN 'VERIFIED' WHEN mv_status = 'risk' THEN 'RISK_REVIEW' ELSE 'UNKNOWN_RETRY' END"


@query(sql(STAGED))
def validation_stages(spark: SparkSession, d: str) -> DataFrame:
    """OP-M05, S36, S37, S38, S39, S61: syntax, disposable, role, mail, score and verifier of every address."""
    return staged(spark, d)


@query(sql(f"SELECT candidate_id, {DECIDED} AS final_status FROM ({STAGED})"))
def validation_decisions(spark: SparkSession, d: str) -> DataFrame:
    """OP-M05, S41, S42: the stages' words decided by a tenant's rules."""
    rows = staged(spark, d).withColumn("llm_threshold", F.lit(RULES["llm_threshold"]))
    names = ("suppressed", "syntax_ok", "disposable", "role_based", "mx_status", "llm_score", "llm_threshold", "mv_status")
    decided = fn.decide({n: F.col(n) for n in names}, RULES["allow_role_based"], RULES["llm_mode"] == "hard", RULES["catch_all_policy"] == "allow", RULES["risk_policy"] == "reject")
    return rows.select("candidate_id", decided.alias("final_status"))


@query(sql(f"SELECT contact_id, count(*) AS candidates, count(*) FILTER (s = 'VERIFIED' AND NOT suppressed AND NOT role_based AND NOT disposable) AS ready FROM (SELECT *, {DECIDED} AS s FROM ({STAGED})) GROUP BY 1"))
def ready_contacts(spark: SparkSession, d: str) -> DataFrame:
    """OP-S43: verified addresses without a flag against them, by contact."""
    rows = staged(spark, d).withColumn("llm_threshold", F.lit(RULES["llm_threshold"]))
    names = ("suppressed", "syntax_ok", "disposable", "role_based", "mx_status", "llm_score", "llm_threshold", "mv_status")
    status = fn.decide({n: F.col(n) for n in names}, RULES["allow_role_based"], True, True, False)
    ok = checks.sales_ready(status, F.col("suppressed"), F.col("role_based"), F.col("disposable"))
    return rows.groupBy("contact_id").agg(F.count("*").alias("candidates"), F.count_if(ok).alias("ready"))


NOT = "|".join(people.NOT_NAMES)
NAMED = people.CANDIDATE.replace("'", "''")


@query(rf"""SELECT doc_id, name, length(name) <= 60 AND regexp_matches(name, '^(([A-Z][.]?){{1,2}}|[A-Z][a-z’''A-Za-z-]*)( +(([A-Z][.]?){{1,2}}|[A-Z][a-z’''A-Za-z-]*)){{1,3}}$') AND NOT regexp_matches(' ' || lower(regexp_replace(name, '[.’''-]', '', 'g')) || ' ', ' ({NOT}) ') AS plausible, split_part(name, ' ', 1) AS first, split_part(name, ' ', -1) AS last FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{NAMED}', 1)) AS name FROM documents)""")
def name_checks(spark: SparkSession, d: str) -> DataFrame:
    """OP-S24, S26: every run of words of every whole text that may be a person's name, whether it can be one, and its first and last part."""
    rows = frame(spark, d, "documents").select("doc_id", F.explode(people.candidate_names(F.col("text"))).alias("name"))
    n = F.col("name")
    return rows.select("doc_id", "name", people.plausible_name(n).alias("plausible"), people.first_name(n).alias("first"), people.last_name(n).alias("last"))


@query(sql("""SELECT contact_id, CASE WHEN trim(coalesce(email, '')) <> '' THEN 'email:' || lower(trim(email)) ELSE 'name:' || company_id || ':' || lower(replace(full_name, ' ', '-')) END AS key, left(designation, 10) AS designation FROM contacts"""))
def contact_keys(spark: SparkSession, d: str) -> DataFrame:
    """OP-S05, S27: the key that contacts are told by, and a text cut to its column's width."""
    c = frame(spark, d, "contacts")
    return c.select("contact_id", people.contact_key(F.col("email"), F.col("company_id"), F.col("full_name")).alias("key"), people.clamp(F.col("designation"), 10).alias("designation"))


@query(r"""SELECT doc_id, email, role, CASE WHEN role THEN 0.4 WHEN named THEN 0.68 ELSE 0.55 END AS confidence, CASE WHEN email LIKE '%@example.com' THEN round(least(CASE WHEN role THEN 0.4 WHEN named THEN 0.68 ELSE 0.55 END + 0.1, 0.99), 3) ELSE CASE WHEN role THEN 0.4 WHEN named THEN 0.68 ELSE 0.55 END END AS aligned FROM (SELECT doc_id, email, regexp_matches(email, '(^|[._+-])(info|support|sales|admin|careers|jobs|hr|marketing|contact|hello)([._+-][^@]*)?@') AS role, regexp_matches(split_part(email, '@', 1), '^[a-z]{2,}[._-][a-z]{2,}$') AS named FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')) AS email FROM documents))""")
def minted_contacts(spark: SparkSession, d: str) -> DataFrame:
    """OP-S33, S34: contacts made from the bare addresses of texts; those on the site's own domain are surer."""
    found = F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:[.][a-z0-9-]+)+', 0)"))
    rows = frame(spark, d, "documents").select("doc_id", F.explode(found).alias("email")).withColumn("role", checks.role_based(F.col("email")))
    rows = rows.withColumn("confidence", people.minted_confidence(F.col("role"), web.name_from_local(F.substring_index("email", "@", 1))))
    return rows.withColumn("aligned", people.aligned(F.col("confidence"), F.col("email").endswith("@example.com")))


def sql_national(n: str, p: phones.Plan) -> str:
    trunk = f" WHEN {n} LIKE '{p.trunk}%' AND regexp_matches(substr({n}, {len(p.trunk) + 1}), '{p.whole}') THEN substr({n}, {len(p.trunk) + 1})" if p.trunk else ""
    return f"('+{p.code}' || CASE WHEN regexp_matches({n}, '{p.whole}') THEN {n}{trunk} END)"


def sql_abroad(n: str) -> str:
    code = f"regexp_extract({n}, '{phones.CODE}', 1)"
    rest = f"substr({n}, length({code}) + 1)"
    known = " ".join(f"WHEN '{p.code}' THEN {sql_national(rest, p)}" for p in {p.code: p for p in phones.PLANS.values()}.values())
    return f"CASE {code} {known} ELSE CASE WHEN {code} <> '' AND regexp_matches({rest}, '{phones.ANY}') AND length({n}) BETWEEN 7 AND 15 THEN '+' || {n} END END"


def sql_home(n: str, p: phones.Plan) -> str:
    return f"coalesce({sql_national(n, p)}, CASE WHEN {n} LIKE '{p.abroad}%' THEN {sql_abroad(f'substr({n}, {len(p.abroad) + 1})')} END, CASE WHEN {n} LIKE '{p.code}%' THEN {sql_national(f'substr({n}, {len(p.code) + 1})', p)} END)"


def sql_numbers(rows: str) -> str:
    """SELECT kind, id, phone of rows (kind, id, region, text)."""
    found = f"SELECT kind, id, region, raw LIKE '+%' AS plus, regexp_replace(raw, '[^0-9]', '', 'g') AS n FROM (SELECT kind, id, region, unnest(regexp_extract_all(text, '{phones.PHONE}', 2)) AS raw FROM ({rows}))"
    homes = " ".join(f"WHEN region = '{r}' THEN {sql_home('n', p)}" for r, p in phones.PLANS.items())
    return f"SELECT DISTINCT kind, id, phone FROM (SELECT kind, id, CASE WHEN plus THEN {sql_abroad('n')} {homes} END AS phone FROM ({found})) WHERE phone IS NOT NULL"


LANGUAGES = "CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' END"


@query(sql_numbers(f"SELECT 'document' AS kind, doc_id AS id, {LANGUAGES} AS region, text FROM documents"))
def document_phones(spark: SparkSession, d: str) -> DataFrame:
    """OP-S23, S02: numbers of every text that can be dialled, by the plan of its language's country."""
    country = F.when(F.col("lang") == "en", "USA").when(F.col("lang") == "fr", "France").when(F.col("lang") == "de", " germany ")
    return frame(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.explode(phones.phones(F.col("text"), phones.region(country))).alias("phone"))


#: A contact's number as a link says it: by turns whole, with the trunk digit, without either, with the prefix for calls abroad, and cut short.
DIALLED = "CASE contact_id % 5 WHEN 0 THEN phone WHEN 1 THEN '0' || substr(phone, 4, 20) WHEN 2 THEN substr(phone, 4, 20) WHEN 3 THEN '00' || substr(phone, 2, 20) ELSE substr(phone, 1, 9) END"


@query(sql(sql_numbers(f"SELECT 'link' AS kind, contact_id AS id, ['GB', 'GB', 'IN', 'US', 'GB', 'DE', 'FR', 'SG', 'AE'][contact_id % 9 + 1] AS region, {DIALLED} AS text FROM contacts WHERE phone IS NOT NULL").replace("unnest(regexp_extract_all(text, '" + phones.PHONE + "', 2)) AS raw", "text AS raw")))
def linked_phones(spark: SparkSession, d: str) -> DataFrame:
    """OP-S23: contacts' numbers as tel: links of pages in eight countries, as people write them: those that can be dialled."""
    k = F.col("contact_id")
    c = frame(spark, d, "contacts").where("phone IS NOT NULL").withColumn("raw", F.expr(DIALLED))
    raw = F.when(k % 2 == 0, F.regexp_replace("raw", "^[+]", "%2B")).otherwise(F.col("raw"))
    html = F.concat(F.lit("<a class=\"x\" href='TEL:"), F.substring(raw, 1, 6), F.lit("-"), F.substring(raw, 7, 20), F.lit(";ext=5'>call</a>"))
    names = F.array(*map(F.lit, ("UK", "gb", "India", "usa", "United Kingdom", "Germany", "France", "singapore", "UAE")))
    country = F.element_at(names, (k % 9 + 1).cast("int"))
    return c.select(F.lit("link").alias("kind"), k.alias("id"), F.explode(phones.page_phones(html, phones.region(country))).alias("phone"))
