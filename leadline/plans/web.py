"""Queries on pages, addresses, names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline.functions import LEGAL_FORMS, ROLE_LOCALS, slug_name, web
from leadline.model import frame, sql
from leadline.plans.registry import query
from leadline.sources import table


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def pick(values, by: str):
    """The value at place `by` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def sql_pick(values, by: str) -> str:
    return f"[{sql_list(values)}][({by} % {len(values)}) + 1]"


HOST = "regexp_extract(lower({}), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)', 1)"
NETWORK = sql_pick(web.NON_COMPANY_HOSTS, "page_id")
#: Sites by turns: a page's own, a network's under the page's first label, a network's name before the page's host, a network's as it is typed.
WEBSITES = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://' || string_split(h, '.')[1] || '.' || {NETWORK} || '/x' WHEN 1 THEN {NETWORK} || '.' || h WHEN 2 THEN 'HTTP://u@' || upper({NETWORK}) || ':80?x' WHEN 3 THEN 'not' || {NETWORK} ELSE url END AS site FROM (SELECT *, {HOST.format('url')} AS h FROM pages)"""


@query(f"""SELECT page_id, {HOST.format('site')} AS host, list_bool_or(list_transform([{sql_list(web.NON_COMPANY_HOSTS)}], lambda x: '.' || {HOST.format('site')} LIKE '%.' || x)) AS rejected FROM ({WEBSITES})""")
def non_company_hosts(spark: SparkSession, d: str) -> DataFrame:
    """OP-S07, S12: the host of each site, and whether it can't be a company's own: a network's or under one."""
    k, h, n = F.col("page_id"), web.host(F.col("url")), pick(web.NON_COMPANY_HOSTS, "page_id")
    site = F.when(k % 5 == 0, F.concat(F.lit("https://"), F.substring_index(h, ".", 1), F.lit("."), n, F.lit("/x"))).when(k % 5 == 1, F.concat(n, F.lit("."), h)).when(k % 5 == 2, F.concat(F.lit("HTTP://u@"), F.upper(n), F.lit(":80?x"))).when(k % 5 == 3, F.concat(F.lit("not"), n)).otherwise(F.col("url"))
    rows = table(spark, d, "pages").select("page_id", site.alias("site"))
    return rows.select("page_id", web.host(F.col("site")).alias("host"), web.is_non_company(F.col("site")).alias("rejected"))


@query(f"""SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(lower('The ' || c_name || ' ' || c_mktsegment || ' & Holdings Co. Ltd'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({sql_list(LEGAL_FORMS)})), '-') AS slug FROM customer""")
def name_slugs(spark: SparkSession, d: str) -> DataFrame:
    """OP-S03: names as slugs."""
    name = F.concat(F.lit("The "), "c_name", F.lit(" "), "c_mktsegment", F.lit(" & Holdings Co. Ltd"))
    return table(spark, d, "customer").select("c_custkey", slug_name(name).alias("slug"))


TITLES = ("Founder & CEO", "Managing Partner", "Head of Sales", "CTO", "Vice President", "Team Lead", "Director of Tax", "Factory worker", "Chief Scientist", "Senior Consultant", "Owner", "Associate")


def _title_hit(word: str) -> str:
    return rf"regexp_matches(t, '\b{word}\b')" if word.isalpha() and len(word) <= 4 else f"contains(t, '{word}')"


SENIORITY = sql_case([(_title_hit(w), f"'{s}'") for w, s, _ in web.DESIGNATIONS], "NULL")
ROLE = sql_case([(_title_hit(w), f"'{r}'") for w, _, r in web.DESIGNATIONS], "NULL")


ADDRESS = r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"


#: A title of each part: one of the above, with the part's own kind and name behind it.
TITLED = sql_pick(TITLES, "p_partkey") + " || ', ' || p_type || ' ' || p_name"


@query(f"""SELECT title, seniority, role, coalesce({sql_case([(f"role = '{k}'", v) for k, v in web.RELEVANCE.items()], "NULL")}, {sql_case([(f"seniority = '{k}'", v) for k, v in web.RELEVANCE.items()], "NULL")}, 0)::INT AS relevance, n FROM (SELECT title, {SENIORITY} AS seniority, {ROLE} AS role, n FROM (SELECT title, lower(title) AS t, count(*) AS n FROM (SELECT {TITLED} AS title FROM part) GROUP BY 1))""")
def designation_class(spark: SparkSession, d: str) -> DataFrame:
    """OP-S28, W02: titles to seniority, role and relevance."""
    title = F.concat(pick(TITLES, "p_partkey"), F.lit(", "), "p_type", F.lit(" "), "p_name")
    rows = table(spark, d, "part").groupBy(title.alias("title")).agg(F.count("*").alias("n"))
    x = web.designation(F.col("title"))
    rows = rows.select("title", x["seniority"].alias("seniority"), x["role"].alias("role"), "n")
    return rows.withColumn("relevance", web.relevance(F.col("role"), F.col("seniority")).cast("int"))


FOUND = r"SELECT DISTINCT email FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')) AS email FROM documents UNION ALL SELECT email FROM candidates)"


@query(sql(f"""SELECT email, CASE WHEN length(list_filter(p, lambda x: regexp_matches(x, '^[a-z]{{2,}}$'))) = 2 AND length(p) = 2 THEN array_to_string(list_transform(p, lambda x: upper(x[1]) || x[2:]), ' ') END AS name, list_has_any(regexp_split_to_array(local, '[._+-]'), [{sql_list(ROLE_LOCALS)}]) AS role_based FROM (SELECT email, local, CASE WHEN contains(local, '.') THEN string_split(local, '.') WHEN contains(local, '_') THEN string_split(local, '_') WHEN contains(local, '-') THEN string_split(local, '-') END AS p FROM (SELECT email, split_part(email, '@', 1) AS local FROM ({FOUND})))"""))
def names_from_locals(spark: SparkSession, d: str) -> DataFrame:
    """OP-S25, S38: names from the local parts of all addresses in texts and of all candidates, and role mailboxes."""
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(ADDRESS), F.lit(0))).alias("email"))
    rows = found.union(frame(spark, d, "candidates").select("email")).distinct().withColumn("local", F.substring_index("email", "@", 1))
    roles = F.arrays_overlap(F.split("local", "[._+-]"), F.array(*map(F.lit, ROLE_LOCALS)))
    return rows.select("email", web.name_from_local(F.col("local")).alias("name"), roles.alias("role_based"))


ENDINGS = ("", "", "@2x.png", "@example.com", ".css", "@sentry.io")
VARIANT = "CASE doc_id % 6 WHEN 2 THEN split_part(e, '@', 1) || '@2x.png' WHEN 3 THEN split_part(e, '@', 1) || '@example.com' WHEN 4 THEN e || '.css' WHEN 5 THEN split_part(e, '@', 1) || '@sentry.io' ELSE e END"


@query(rf"""SELECT doc_id, email, lower(split_part(email, '@', 2)) IN ({sql_list(web.PLACEHOLDER_DOMAINS)}) OR regexp_extract(email, '([^.]*)$', 1) IN ({sql_list(web.ASSET_TLDS)}) AS rejected FROM (SELECT DISTINCT doc_id, {VARIANT} AS email FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')) AS e FROM documents))""")
def asset_addresses(spark: SparkSession, d: str) -> DataFrame:
    """OP-S21: all addresses of texts, by turns as they stand and as file names and placeholders that look like addresses."""
    e = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(ADDRESS), F.lit(0))).alias("e"))
    rows = e.select("doc_id", F.expr(VARIANT.replace("split_part(e, '@', 1)", "substring_index(e, '@', 1)")).alias("email")).distinct()
    return rows.withColumn("rejected", web.is_asset_or_placeholder(F.col("email")))


#: The whole text of every document with its addresses hidden by turns.
HIDE = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '@', ' [at] ') WHEN 2 THEN replace(replace(text, '@', ' (AT) '), '.', ' {dot} ') ELSE replace(text, '@', ' at ') END"
BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\s*[\[({]\s*at\s*[\])}]\s*', '@', 'gi'), '\s*[\[({]\s*dot\s*[\])}]\s*', '.', 'gi'), '\s+at\s+', '@', 'gi'), '\s+dot\s+', '.', 'gi')"


@query(f"""SELECT doc_id, {BARE} AS text FROM (SELECT doc_id, {HIDE} AS h FROM documents)""")
def deobfuscated(spark: SparkSession, d: str) -> DataFrame:
    """OP-S19: hidden addresses of whole texts written out."""
    return table(spark, d, "documents").select("doc_id", web.deobfuscate(F.expr(HIDE)).alias("text"))


def _hiring_hit(phrase: str) -> str:
    p = phrase.replace("'", "''")
    before = rf"length(regexp_extract(lower(text), '(?s)^(.*?)\b{p}\b', 1))"
    return rf"CASE WHEN regexp_matches(lower(text), '\b{p}\b') THEN '{p}: ' || trim(regexp_replace(substr(text, greatest({before} - 40, 0) + 1, {before} + {len(phrase) + 60} - greatest({before} - 40, 0)), '\s+', ' ', 'g')) END"


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(map(_hiring_hit, web.HIRING_PHRASES))}], lambda x: x IS NOT NULL), chr(10)) AS signals FROM documents""")
def document_hiring(spark: SparkSession, d: str) -> DataFrame:
    """OP-S16: of every document the hiring phrases, each with the surroundings of its first hit, one a line; '' if none."""
    hits = F.transform(web.hiring_signals(F.coalesce("text", F.lit(""))), lambda x: F.concat(x["phrase"], F.lit(": "), x["snippet"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(hits, "\n").alias("signals"))


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([{', '.join(map(_hiring_hit, web.HIRING_PHRASES))}], lambda x: x IS NOT NULL), chr(10)) AS signals FROM conversations""")
def hiring_phrases(spark: SparkSession, d: str) -> DataFrame:
    """OP-S16: of every turn the hiring phrases, each with the surroundings of its first hit."""
    hits = F.transform(web.hiring_signals(F.coalesce("text", F.lit(""))), lambda x: F.concat(x["phrase"], F.lit(": "), x["snippet"]))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(hits, "\n").alias("signals"))


@query(rf"""SELECT kind, id, email FROM (SELECT 'page' AS kind, page_id AS id, unnest(list_distinct(regexp_extract_all(lower(html), '{ADDRESS}'))) AS email FROM pages UNION ALL SELECT 'document', doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{ADDRESS}'))) FROM documents) WHERE NOT (split_part(email, '@', 2) IN ({sql_list(web.PLACEHOLDER_DOMAINS)}) OR regexp_extract(email, '([^.]*)$', 1) IN ({sql_list(web.ASSET_TLDS)}))""")
def page_emails(spark: SparkSession, d: str) -> DataFrame:
    """OP-S18, S21: distinct addresses of every page and document that are neither file names nor placeholders."""
    found = lambda t, kind, key, c: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(ADDRESS), F.lit(0)))).alias("email"))
    rows = found("pages", "page", "page_id", "html").union(found("documents", "document", "doc_id", "text"))
    return rows.where(~web.is_asset_or_placeholder(F.col("email")))


RESULTS = (" OK ", "valid", "Catchall", "risky", "disposable", "unknown", "catch_all")
SAID = "CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE " + sql_pick(RESULTS, "c_custkey") + " END"


@query(f"""SELECT c_custkey, CASE lower(trim(r)) WHEN 'ok' THEN 'valid' WHEN 'valid' THEN 'valid' WHEN 'catchall' THEN 'catch_all' WHEN 'catch_all' THEN 'catch_all' WHEN 'risky' THEN 'risk' WHEN 'disposable' THEN 'invalid' ELSE 'unknown' END AS status FROM (SELECT c_custkey, {SAID} AS r FROM customer)""")
def verifier_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """OP-I17: a verifier's words as states; words that it never says are unknown."""
    said = F.when(F.col("c_custkey") % 4 == 3, F.col("c_name")).otherwise(pick(RESULTS, "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", web.verifier_status(said).alias("status"))


#: What a posting says of its time: so many of some unit, by its value, or a word or day.
N = "cast(floor(value) AS bigint)"
POSTED = f"CASE event_id % 8 WHEN 0 THEN {N} || ' days ago' WHEN 1 THEN {N} % 9 || '+ weeks ago' WHEN 2 THEN 'Yesterday' WHEN 3 THEN 'posted ' || {N} % 30 || ' month ago' WHEN 4 THEN {N} || ' Hours  ago' WHEN 5 THEN left(cast(ts AS string), 10) WHEN 6 THEN 'today' ELSE 'soon' END"


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN ts - to_days(n::INT) WHEN 1 THEN ts - to_days((n % 9 * 7)::INT) WHEN 2 THEN ts - INTERVAL 1 DAY WHEN 3 THEN ts - to_days((n % 30 * 30)::INT) WHEN 4 THEN ts - to_hours(n) WHEN 5 THEN date_trunc('day', ts)::TIMESTAMP WHEN 6 THEN ts END AS posted_at FROM (SELECT *, floor(value)::BIGINT AS n FROM events)""")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """OP-S44, S45: relative dates of every row against its own time."""
    return table(spark, d, "events").select("event_id", web.relative_date(F.expr(POSTED), F.col("ts")).alias("posted_at"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 280 THEN rtrim(t[:279]) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """OP-S46: the beginning of each text on one line (the excerpt is the feature)."""
    return table(spark, d, "documents").select("doc_id", web.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT s_suppkey, k AS tile, round(CASE WHEN k = 0 THEN lat ELSE lat + degrees(r * cos(radians(60.0 * (k - 1))) / 6371.0) END, 6) AS lat, round(CASE WHEN k = 0 THEN lng ELSE lng + degrees(r * sin(radians(60.0 * (k - 1))) / (6371.0 * cos(radians(lat)))) END, 6) AS lng, CASE WHEN km <= 1 THEN greatest(km, 0.1) ELSE km / 2 END AS km FROM (SELECT s_suppkey, (s_suppkey % 60)::DOUBLE AS lat, (s_suppkey % 170)::DOUBLE AS lng, (s_suppkey % 30)::DOUBLE AS km, (s_suppkey % 30) * sqrt(3.0::DOUBLE) / 2 AS r, unnest(range(0, 7))::INT AS k FROM supplier) WHERE k = 0 OR km > 1""")
def tile_cover(spark: SparkSession, d: str) -> DataFrame:
    """OP-S59, J15: each search circle as seven smaller ones."""
    at = lambda n: (F.col("s_suppkey") % n).cast("double")
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(web.tiles(at(60), at(170), at(30))).alias("t"))
    return rows.select("s_suppkey", "t.tile", F.round("t.lat", 6).alias("lat"), F.round("t.lng", 6).alias("lng"), "t.km")
