"""Queries on links, hosts and registrable domains of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.functions import urls, web
from leadline.plans.registry import query
from leadline.plans.web import sql_case, sql_list
from leadline.sources import links, table


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_resolve(base: str, ref: str) -> str:
    """A SELECT of `target` from rows with columns of these names and any others."""
    lead = "[a-zA-Z][a-zA-Z0-9+.-]*:"
    part = lambda x, p, i=1: f"regexp_extract({x}, '{p}', {i})"

    def parts(x: str, n: str) -> str:
        return (
            f"nullif(lower({part(x, '^([a-zA-Z][a-zA-Z0-9+.-]*):')}), '') AS {n}_scheme, CASE WHEN regexp_matches({x}, '^(?:{lead})?//') THEN {part(x, f'^(?:{lead})?//([^/?#]*)')} END AS {n}_auth, "
            f"{part(x, f'^(?:{lead})?(?://[^/?#]*)?([^?#]*)')} AS {n}_path, CASE WHEN regexp_matches({x}, '^[^#]*[?]') THEN {part(x, '^[^?#]*[?]([^#]*)')} END AS {n}_query, CASE WHEN contains({x}, '#') THEN {part(x, '^[^#]*#(.*)$')} END AS {n}_frag"
        )

    fold = "list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(p, '/'), lambda s: [s])), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN CASE WHEN len(a) > CASE WHEN p LIKE '/%' THEN 1 ELSE 0 END THEN a[:-2] ELSE a END ELSE a || s END)"
    nodots = "CASE WHEN dotted THEN CASE WHEN regexp_matches(p, '(^|/)[.][.]?$') AND k <> '' AND k NOT LIKE '%/' THEN k || '/' ELSE k END ELSE p END"
    own = "(r_scheme IS NOT NULL OR r_auth IS NOT NULL)"
    merged = "CASE WHEN b_auth IS NOT NULL AND b_path = '' THEN '/' || r_path ELSE regexp_extract(b_path, '^(.*/)?[^/]*$', 1) || r_path END"
    return f"""SELECT *, coalesce(coalesce(r_scheme, b_scheme) || ':', '') || coalesce('//' || CASE WHEN {own} THEN r_auth ELSE b_auth END, '') || {nodots} || coalesce('?' || CASE WHEN {own} OR r_path <> '' OR r_query IS NOT NULL THEN r_query ELSE b_query END, '') || coalesce('#' || r_frag, '') AS target
FROM (SELECT *, CASE WHEN p LIKE '/%' AND k0 NOT LIKE '/%' THEN '/' || k0 ELSE k0 END AS k FROM (SELECT *, array_to_string({fold}, '/') AS k0 FROM (SELECT *, {own} OR r_path <> '' AS dotted, CASE WHEN {own} OR r_path LIKE '/%' THEN r_path WHEN r_path = '' THEN b_path ELSE {merged} END AS p FROM (SELECT *, {parts('r0', 'r')}, {parts(base, 'b')} FROM (SELECT *, regexp_replace(trim({ref}), '[\\t\\r\\n]', '', 'g') AS r0 FROM rows)))))"""


def sql_registrable(h: str, rules: urls.Suffixes = urls.COMMON) -> str:
    tail = lambda k: f"array_to_string(string_split({h}, '.')[-{k}:], '.')"
    at_least = lambda k: f"len(string_split({h}, '.')) >= {k}"
    steps = [(f"regexp_matches({h}, '^[0-9]+([.][0-9]+){{3}}$') OR {h} LIKE '[%'", h)]
    take = lambda k: f"CASE WHEN len(string_split({h}, '.')) > {k} THEN {tail(k + 1)} ELSE '.' || {h} END"
    for k in range(rules.depth, 1, -1):
        if some := rules.level("exceptions", k):
            steps.append((f"{at_least(k)} AND {tail(k)} IN ({sql_list(some)})", take(k - 1)))
    for k in range(rules.depth, 0, -1):
        hits = [f"{tail(k)} IN ({sql_list(some)})"] if (some := rules.level("plain", k)) else []
        if k > 1 and (some := rules.level("wild", k - 1)):
            hits.append(f"{tail(k - 1)} IN ({sql_list(some)})")
        if k == 1 and rules.countries:
            hits.append(f"regexp_matches({tail(1)}, '^[a-z]{{2}}$')")
        steps.append((f"{at_least(k)} AND ({' OR '.join(hits) or 'false'})", take(k)))
    return sql_case(steps, h)


def sql_host(u: str) -> str:
    return rf"regexp_replace(regexp_extract(lower({u}), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1), '[.]+$', '')"


def sql_canonical(u: str) -> str:
    bare = f"regexp_replace({u}, '#.*$', '')"
    return f"lower(regexp_extract({bare}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(regexp_extract({bare}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') || regexp_extract({bare}, '([?].*)$', 1)"


HREF = quoted(urls.ATTRIBUTE.format("href"))


def _value(tag: str) -> str:
    return f"CASE WHEN regexp_matches({tag}, '{HREF}') THEN trim(" + " || ".join(f"regexp_extract({tag}, '{HREF}', {i})" for i in (1, 2, 3)) + ") END"


#: Every anchor of a page: footers apart, its place, address and text. The tables' pages have no base element.
ANCHORS = f"""SELECT page_id, url, url AS base, footer, i - 1 AS place, {_value('a')} AS href, trim(regexp_replace(regexp_replace(a, '{quoted(urls.ANY_TAG)}', ' ', 'g'), '\\s+', ' ', 'g')) AS anchor FROM (SELECT page_id, url, footer, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (
 SELECT page_id, url, true AS footer, regexp_extract_all(array_to_string(regexp_extract_all(html, '{quoted(links.FOOTER)}'), ' '), '{quoted(links.ANCHOR)}') AS l FROM pages UNION ALL SELECT page_id, url, false, regexp_extract_all(regexp_replace(html, '{quoted(links.FOOTER)}', ' ', 'g'), '{quoted(links.ANCHOR)}') FROM pages))"""
SCORED = sql_case([(f"regexp_matches(lower(target || ' ' || anchor), '{w}')", f"{p} + CASE WHEN footer THEN 10 ELSE 0 END") for w, p in web.LINK_SCORES], "0")


@query(f"""WITH rows AS MATERIALIZED (SELECT * FROM ({ANCHORS}) WHERE href <> '' AND href NOT LIKE '#%'), t AS ({sql_resolve('base', 'href')})
SELECT page_id, url, score, place FROM (SELECT page_id, canon AS url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, canon)::INT AS place FROM (SELECT page_id, canon, max(score)::INT AS score FROM (SELECT page_id, {sql_canonical('target')} AS canon, {sql_canonical('url')} AS own, {SCORED} AS score, {sql_host('target')} AS h, {sql_host('url')} AS g FROM t WHERE regexp_matches(target, '(?i)^https?://')) WHERE canon <> own AND {sql_registrable('h')} = {sql_registrable('g')} GROUP BY 1, 2)) WHERE place <= 8""")
def site_frontier(spark: SparkSession, d: str) -> DataFrame:
    """OP-S09, S10, S11, W05, W06: links of a page to its own registrable domain but not to itself, resolved, one a canonical form with its best
    score by address, anchor text and footer, the best eight."""
    return links.followed(links.anchors(table(spark, d, "pages")))


VARIED = "CASE place % 8 WHEN 0 THEN href WHEN 1 THEN '..' || href WHEN 2 THEN '.' || href || '/../x?y#z' WHEN 3 THEN '?q=' || substr(href, 2) WHEN 4 THEN substr(href, 2) || '/.' WHEN 5 THEN '//CDN.example.net' || href || '/./../' WHEN 6 THEN '../../../..' || href ELSE ' #' || substr(href, 2) END"


@query(f"""WITH rows AS MATERIALIZED (SELECT page_id, base, footer, place, {VARIED} AS href FROM ({ANCHORS})) SELECT page_id, footer, place, href, target FROM ({sql_resolve('base', 'href')})""")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """OP-S11: every link of every page resolved against it, by turns as it stands and as relative references to the same names."""
    rows = links.anchors(table(spark, d, "pages")).withColumn("href", F.expr(VARIED))
    return links.resolved(rows).select("page_id", "footer", F.col("place").cast("long").alias("place"), "href", "target")


ENDS = ("", ".co.uk", ".gov.uk", ".ck", ".www.ck", ".kawasaki.jp", ".city.kawasaki.jp", ".test", ".co.org", ".net.", ".com.br", ".unknownzone")
HOSTS = f"[{sql_list(ENDS)}][(page_id % {len(ENDS)}) + 1]"


@query(f"""SELECT page_id, host, {sql_registrable('g')} AS domain FROM (SELECT *, regexp_replace(host, '[.]+$', '') AS g FROM (SELECT page_id, CASE WHEN page_id % 29 = 7 THEN '10.0.' || page_id % 200 || '.1' WHEN page_id % 29 = 8 THEN substr({HOSTS}, 2) ELSE {sql_host('url')} || {HOSTS} END AS host FROM pages)) WHERE host <> ''""")
def page_domains(spark: SparkSession, d: str) -> DataFrame:
    """OP-S07, S08: the registrable domain of every page's host, and of hosts that its labels give under other suffixes, wildcards and exceptions among them."""
    k = F.col("page_id")
    end = F.element_at(F.array(*map(F.lit, ENDS)), (k % len(ENDS) + 1).cast("int"))
    host = F.when(k % 29 == 7, F.concat(F.lit("10.0."), k % 200, F.lit(".1"))).when(k % 29 == 8, F.substring(end, 2, 100)).otherwise(F.concat(web.host(F.col("url")), end))
    return table(spark, d, "pages").select("page_id", host.alias("host")).where("host <> ''").withColumn("domain", web.registrable_domain(F.col("host")))


_DIGITS = """list_reduce(list_prepend({'q': delta, 'k': 0::BIGINT, 'o': '', 'f': false}, list_transform(range(1, 9), lambda k: {'q': 0::BIGINT, 'k': k, 'o': '', 'f': false})), lambda a, x: CASE WHEN a.f THEN a WHEN a.q < greatest(1, least(26, 36 * x.k - bias)) THEN {'q': a.q, 'k': x.k, 'o': a.o || chr((a.q + CASE WHEN a.q < 26 THEN 97 ELSE 22 END)::INT), 'f': true}
 ELSE {'q': (a.q - greatest(1, least(26, 36 * x.k - bias))) // (36 - greatest(1, least(26, 36 * x.k - bias))), 'k': x.k, 'f': false, 'o': a.o || chr((greatest(1, least(26, 36 * x.k - bias)) + (a.q - greatest(1, least(26, 36 * x.k - bias))) % (36 - greatest(1, least(26, 36 * x.k - bias))) + CASE WHEN greatest(1, least(26, 36 * x.k - bias)) + (a.q - greatest(1, least(26, 36 * x.k - bias))) % (36 - greatest(1, least(26, 36 * x.k - bias))) < 26 THEN 97 ELSE 22 END)::INT)} END).o"""


@query(rf"""WITH RECURSIVE words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents),
l AS MATERIALIZED (SELECT word FROM words WHERE regexp_matches(word, '[^\x00-\x7F]')),
c AS MATERIALIZED (SELECT word, unicode(ch) AS c, i FROM (SELECT word, unnest(string_split(word, '')) AS ch, unnest(range(len(string_split(word, '')))) AS i FROM l)),
b AS (SELECT word, count(*) FILTER (c < 128) AS b, coalesce(string_agg(chr(c), '' ORDER BY i) FILTER (c < 128), '') AS plain FROM c GROUP BY 1),
o AS MATERIALIZED (SELECT x.word, x.c, row_number() OVER (PARTITION BY x.word ORDER BY x.c, x.i) AS r, (SELECT count(*) FROM c y WHERE y.word = x.word AND y.i < x.i AND y.c <= x.c) AS place FROM c x WHERE x.c >= 128),
d AS MATERIALIZED (SELECT word, r, h, (c - n) * (h + 1) + place - i AS delta FROM (SELECT o.*, b.b + r - 1 AS h, coalesce(lag(c) OVER w, 128) AS n, coalesce(lag(place) OVER w + 1, 0) AS i FROM o JOIN b USING (word) WINDOW w AS (PARTITION BY word ORDER BY r))),
e AS (SELECT *, CASE WHEN s <= 455 THEN 0 WHEN s // 35 <= 455 THEN 1 WHEN s // 1225 <= 455 THEN 2 WHEN s // 42875 <= 455 THEN 3 ELSE 4 END AS t FROM (SELECT *, delta // CASE WHEN r = 1 THEN 700 ELSE 2 END + (delta // CASE WHEN r = 1 THEN 700 ELSE 2 END) // (h + 1) AS s FROM d)),
f AS (SELECT word, r, delta, coalesce(lag(36 * t + 36 * (s // [1, 35, 1225, 42875, 1500625][t + 1]) // (s // [1, 35, 1225, 42875, 1500625][t + 1] + 38)) OVER (PARTITION BY word ORDER BY r), 72)::BIGINT AS bias FROM e),
g AS (SELECT word, string_agg({_DIGITS}, '' ORDER BY r) AS code FROM (SELECT word, r, delta::BIGINT AS delta, bias FROM f) GROUP BY 1),
p AS (SELECT word, 'xn--' || plain || CASE WHEN plain <> '' THEN '-' ELSE '' END || code AS label FROM g JOIN b USING (word))
SELECT word, coalesce(label, word) || '.example' AS host, length(coalesce(label, word)) <= 63 AS valid FROM words LEFT JOIN p USING (word)""")
def word_hosts(spark: SparkSession, d: str) -> DataFrame:
    """OP-S36: every distinct word of the documents as a host's label: in ASCII, and whether it may be one."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()
    host = F.concat("word", F.lit(".example"))
    return words.select("word", urls.ascii_host(host).alias("host"), urls.valid_host(host).alias("valid"))
