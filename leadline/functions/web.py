"""Column functions on links, addresses in texts, names, titles and dates; all JVM-side."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions import urls

# Fixed values -------------------------------------------------------------------------------------------------
LINK_SCORES = (
    ("contact|contact-us|contactus|reach-us|get-in-touch", 100),
    ("about|about-us|team|our-team|leadership|people|our-people", 90),
    ("partners|management|board|directors", 85),
    ("services|solutions|practice|expertise|what-we-do", 60),
    ("careers|career|jobs|join-us|vacancies|openings", 55),
    ("privacy|imprint|impressum|legal|terms", 40),
)
NON_COMPANY_HOSTS = ("linkedin.com", "facebook.com", "m.facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "wa.me", "api.whatsapp.com", "chat.whatsapp.com", "linktr.ee", "t.me", "justdial.com", "sulekha.com", "indiamart.com", "google.com")
HIRING_PHRASES = ("we're hiring", "we are hiring", "join our team", "open positions", "open roles", "current openings", "career opportunities", "now hiring", "job openings", "we're looking for", "we are looking for")
ASSET_TLDS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico", "avif", "css", "js", "mjs", "json", "map", "xml", "woff", "woff2", "ttf", "eot", "otf", "mp4", "webm", "mp3", "wav", "pdf", "zip")
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "email.com", "domain.com", "yourdomain.com", "yourcompany.com", "mycompany.com", "company.com", "yoursite.com", "mysite.com", "website.com", "test.com", "sentry.io")
VERIFIER_RESULTS = {"ok": "valid", "valid": "valid", "invalid": "invalid", "catch_all": "catch_all", "catchall": "catch_all", "unknown": "unknown", "disposable": "invalid", "risky": "risk", "risk": "risk"}
DESIGNATIONS = (
    ("founder", "c_level", "founder"), ("co-founder", "c_level", "founder"), ("cofounder", "c_level", "founder"),
    ("chief executive", "c_level", "executive"), ("ceo", "c_level", "executive"), ("managing partner", "c_level", "partner"),
    ("managing director", "c_level", "executive"), ("cto", "c_level", "executive"), ("cfo", "c_level", "finance"),
    ("coo", "c_level", "operations"), ("chief", "c_level", "executive"), ("owner", "owner", "owner"),
    ("principal", "senior", "principal"), ("partner", "senior", "partner"), ("vice president", "senior", "sales"),
    ("vp ", "senior", "sales"), ("director", "senior", "director"), ("head of ", "senior", "department_head"),
    ("president", "c_level", "executive"), ("manager", "mid", "manager"), ("lead", "mid", "lead"),
    ("associate", "junior", "associate"), ("consultant", "mid", "consultant"), ("advisor", "senior", "advisor"),
)
RELEVANCE = {"founder": 100, "ceo": 95, "owner": 92, "managing_partner": 90, "managing partner": 90, "managing_director": 88, "managing director": 88, "partner": 85, "principal": 80, "director": 78, "vp_sales": 72, "vp sales": 72, "cto": 70, "cfo": 70, "operations_head": 65, "operations head": 65, "decision_maker": 60, "department_head": 55}
BOUNCES = (
    ("mailbox_full", ("mailbox full", "quota exceeded", "over quota", "user is over quota", "5.2.2")),
    ("invalid_domain", ("no such domain", "domain not found", "unable to resolve", "host unknown", "domain does not exist", "5.1.2")),
    ("spam_rejected", ("spam", "content rejected", "message rejected as spam", "policy violation", "listed on", "blocklist", "blacklist", "bulk mail")),
    ("blocked", ("blocked", "access denied", "not permitted", "rejected by", "connection refused")),
    ("rate_limited", ("rate limit", "too many", "try again later", "throttl", "4.7.28")),
)
TEMPLATE_VARIABLES = ("FirstName", "LastName", "FullName", "Company", "Industry", "City", "State", "Country", "Services", "Designation", "Website", "HiringSignal")
# --------------------------------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    """Host in lower case, whether or not a scheme stands before it; '' if none."""
    return F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slashes at the end of the path; the query stays."""
    u = F.regexp_replace(url, r"#.*$", "")
    front = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    return F.concat(front, path, F.regexp_extract(u, r"([?].*)$", 1))


def link_score(url: Column, anchor: Column, footer: Column) -> Column:
    """Points of the first group of words found in url and anchor, ten more in a footer; 0 if none."""
    hay, out = F.lower(F.concat_ws(" ", url, anchor)), None
    for words, points in LINK_SCORES:
        out = F.when(hay.rlike(words), points) if out is None else out.when(hay.rlike(words), points)
    return F.least(out.otherwise(0) + F.when(footer & out.isNotNull(), 10).otherwise(0), F.lit(200))


def registrable_domain(url: Column, rules: urls.Suffixes = urls.COMMON) -> Column:
    """The registrable domain of an address's host in ASCII; the whole host of numbers, single labels and unknown top levels."""
    return urls.registrable(urls.ascii_host(F.regexp_replace(host(url), r"\.+$", "")), rules)


def is_non_company(url: Column) -> Column:
    h = host(url)
    return F.coalesce(h.rlike("^(.*[.])?(" + "|".join(x.replace(".", "[.]") for x in NON_COMPANY_HOSTS) + ")$"), F.lit(False))


def hiring_signals(text: Column) -> Column:
    """Array of (phrase, snippet): the first whole-phrase hit of each, 40 characters before and 60 after, white space collapsed."""
    hits = []
    for p in HIRING_PHRASES:
        before = F.length(F.regexp_extract(F.lower(text), rf"(?s)^(.*?)\b{p}\b", 1))
        start = F.greatest(before - 40, F.lit(0))
        cut = F.substring(text, start + 1, before + len(p) + 60 - start)
        hits.append(F.when(F.lower(text).rlike(rf"\b{p}\b"), F.struct(F.lit(p).alias("phrase"), F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("snippet"))))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def unescape(text: Column) -> Column:
    """Character references as their characters: numbers in either base, and the names of the HTML 4 tables; others stay."""
    names = F.create_map(*[x for n, c in sorted(name2codepoint.items()) for x in (F.lit(f"&{n};"), F.lit(chr(c)))], F.lit("&apos;"), F.lit("'"))
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    ok = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)

    def one(token: Column) -> Column:
        number = F.coalesce(F.conv(F.nullif(F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10).cast("long"), F.nullif(F.regexp_extract(token, "^&#([0-9]{1,7});$", 1), F.lit("")).cast("long"))
        return F.when(~token.startswith("&"), token).when(ok(number), point(number)).otherwise(F.coalesce(names[token], token))

    tokens = F.regexp_extract_all(text, F.lit("&[#a-zA-Z0-9]{1,10};|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(tokens, one), "")).otherwise(text)


def deobfuscate(text: Column) -> Column:
    """Character references become their characters; [at], (at), {at} and ' at ' become @; the same of dot."""
    t = F.regexp_replace(unescape(text), r"(?i)\s*[\[({]\s*at\s*[\])}]\s*", "@")
    t = F.regexp_replace(t, r"(?i)\s*[\[({]\s*dot\s*[\])}]\s*", ".")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)\s+at\s+", "@"), r"(?i)\s+dot\s+", ".")


def is_notice(text: Column) -> Column:
    """A mail system's word on a message, by one of three phrases."""
    low = F.lower(text)
    return F.coalesce(low.contains("delivery status notification") | low.contains("mail delivery") | low.contains("undelivered"), F.lit(False))


def is_asset_or_placeholder(email: Column) -> Column:
    domain = F.lower(F.substring_index(email, "@", -1))
    return (F.instr(email, "@") == 0) | domain.isin(*PLACEHOLDER_DOMAINS) | F.substring_index(domain, ".", -1).isin(*ASSET_TLDS)


def cfemail(code: Column) -> Column:
    """An address hidden as hex, each byte combined with the first by exclusive or."""
    at = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.expr("cast(1 as int)") * (F.length(code) / 2 - 1).cast("int")), lambda i: F.chr(at(i).bitwiseXOR(at(F.lit(0))))), "")


def designation(title: Column) -> Column:
    """(seniority, role) of the first keyword found; short words only as words of their own."""
    t, out = F.lower(title), None
    for word, seniority, role in DESIGNATIONS:
        hit = t.rlike(rf"\b{word}\b") if word.isalpha() and len(word) <= 4 else t.contains(word)
        what = F.struct(F.lit(seniority).alias("seniority"), F.lit(role).alias("role"))
        out = F.when(hit, what) if out is None else out.when(hit, what)
    return out


def relevance(*names: Column) -> Column:
    """Points of the first of role, seniority and designation on the list; 0 if none is."""
    table = F.create_map(*[F.lit(x) for kv in RELEVANCE.items() for x in kv])
    return F.coalesce(*[F.try_element_at(table, F.coalesce(F.lower(F.trim(n)), F.lit(""))) for n in names], F.lit(0))


def name_from_local(local: Column) -> Column:
    """'Anna Lee' of anna.lee: exactly two parts of two letters or more around the first of . _ - that is there."""
    parts = F.when(local.contains("."), F.split(local, "[.]")).when(local.contains("_"), F.split(local, "_")).when(local.contains("-"), F.split(local, "-"))
    ok = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike("^[A-Za-z]{2,}$"))
    return F.when(ok, F.concat_ws(" ", F.transform(parts, F.initcap)))


def verifier_status(result: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VERIFIER_RESULTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.lower(F.trim(result)), F.lit(""))), F.lit("unknown"))


def classify_bounce(status: Column, diagnostic: Column) -> Column:
    """The first group of keywords found in diagnostic and status; then the status class; else unknown."""
    text, out = F.lower(F.concat_ws(" ", F.coalesce(diagnostic, F.lit("")), F.coalesce(status, F.lit("")))), None
    for kind, words in BOUNCES:
        hit = text.rlike("|".join(w.replace(".", "[.]") for w in words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(status.startswith("5"), "hard").when(status.startswith("4"), "soft").otherwise("unknown")


def relative_date(text: Column, now: Column) -> Column:
    """'3 days ago', 'today', 'just posted', 'yesterday' or an ISO date as a timestamp; months have 30 days, years 365; else null."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"(\d+)\+?\s*(minute|hour|day|week|month|year)s?\s+ago", 1)
    unit = F.regexp_extract(t, r"(\d+)\+?\s*(minute|hour|day|week|month|year)s?\s+ago", 2)
    secs = F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800).when(unit == "month", 2592000).when(unit == "year", 31536000)
    ago = now - F.make_dt_interval(secs=F.expr("cast(0 as double)") + secs * F.nullif(n, F.lit("")).cast("double"))
    return F.when(n != "", ago).when(t.isin("today", "just posted"), now).when(t == "yesterday", now - F.expr("interval 1 day")).otherwise(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(t, F.lit(10)))).cast("timestamp_ntz"))


def excerpt(text: Column, most: int = 280) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…"))).otherwise(t)


def render(template: Column, values: dict[str, Column]) -> Column:
    """(text, error): {{Variable}} replaced; an unknown variable, or one without a value, is an error and leaves no text."""
    used = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))
    unknown = F.array_except(used, F.array(*map(F.lit, TEMPLATE_VARIABLES)))
    given = {k: F.nullif(v, F.lit("")) for k, v in values.items()}
    empty = F.array_compact(F.array(*[F.when(given[k].isNull() if k in given else F.lit(True), F.lit(k)) for k in TEMPLATE_VARIABLES]))
    missing = F.array_intersect(used, empty)
    error = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ","))).when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    text = template
    for k, v in given.items():
        # a function's result as replacement may hold $ or \: they stand for themselves
        safe = F.regexp_replace(F.coalesce(v, F.lit("")), r"([\\$])", r"\\$1")
        text = F.regexp_replace(text, F.lit(rf"\{{\{{\s*{k}\s*\}}\}}"), safe)
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def tiles(lat: Column, lng: Column, km: Column) -> Column:
    """Seven disks that cover one: centre and six at 60 degrees, ring at sqrt(3)/2 of the radius, half as wide; one disk up to 1 km."""
    at = lambda k, a, b, r: F.struct(F.lit(k).alias("tile"), a.alias("lat"), b.alias("lng"), r.alias("km"))
    ring, out = km * (3**0.5 / 2), [at(0, lat, lng, km / 2)]
    for k in range(6):
        turn = F.radians(F.lit(60.0 * k))
        out.append(at(k + 1, lat + F.degrees(ring * F.cos(turn) / 6371.0), lng + F.degrees(ring * F.sin(turn) / (F.lit(6371.0) * F.cos(F.radians(lat)))), km / 2))
    return F.when(km <= 1, F.array(at(0, lat, lng, F.greatest(km, F.lit(0.1))))).otherwise(F.array(*out))


#: Paths of a social network that are no business page, and marks of pages drawn by scripts.
FACEBOOK_NONPAGES = ("sharer", "share.php", "dialog", "plugins", "tr?", "login", "profile.php")
SPA_MARKERS = ('id="root"', 'id="app"', 'id="__next"', "data-reactroot", "ng-app", "ng-version")


def social_kind(url: Column) -> Column:
    """linkedin, linkedin_person or facebook; null for other links and for pages that are no business's."""
    u = F.lower(F.trim(url))
    other = u.rlike("|".join(x.replace(".", "[.]").replace("?", "[?]") for x in FACEBOOK_NONPAGES))
    return F.when(u.rlike(r"linkedin[.]com/(company|school)/"), "linkedin").when(u.rlike(r"linkedin[.]com/in/"), "linkedin_person").when(u.rlike(r"facebook[.]com/+[^/?#]") & ~other, "facebook")


def visible_length(html: Column) -> Column:
    """Characters left without scripts, styles and tags, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[ \t\n\x0B\f\r]+", " ")))


def needs_browser(html: Column) -> Column:
    """Fewer than 400 visible characters, or the mark of a scripted page and fewer than 1200."""
    n = visible_length(html)
    return (n < 400) | (F.lower(html).rlike("|".join(SPA_MARKERS)) & (n < 1200))


def gate(posture: Column, enabled: Column, signed_off: Column, flag: Column) -> Column:
    """Why a source may not run: the first gate that fails; null where it may. Green ones always may."""
    return F.when(posture == "green", None).when(~enabled, "not_enabled").when(~signed_off, "not_signed_off").when(~flag, "flag_off")


def box(lat: Column, lng: Column, km: Column) -> Column:
    """(south, west, north, east) around a circle of 0.1 to 100 km."""
    r = F.greatest(F.lit(0.1), F.least(F.lit(100.0), km))
    dy, dx = F.degrees(r / 6371.0), F.degrees(r / (F.lit(6371.0) * F.cos(F.radians(lat))))
    return F.struct((lat - dy).alias("south"), (lng - dx).alias("west"), (lat + dy).alias("north"), (lng + dx).alias("east"))


def crawl_allowed(body: Column, path: Column) -> Column:
    """Whether the rules of every agent let a path be read: the longest rule that it begins with decides, an allowing one of
    equal length first; null and empty rules allow everything."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    step = F.struct(F.lit(False).alias("mine"), F.lit(False).alias("ruled"), F.lit(-1).alias("best"), F.lit(True).alias("ok"))

    def take(a: Column, x: Column) -> Column:
        field, value = F.lower(F.regexp_extract(x, r"^([A-Za-z-]+)\s*:", 1)), F.trim(F.regexp_extract(x, r"^[A-Za-z-]+\s*:(.*)$", 1))
        named = F.struct(((value == "*") | (a["mine"] & ~a["ruled"])).alias("mine"), F.lit(False).alias("ruled"), a["best"].alias("best"), a["ok"].alias("ok"))
        allow = field == "allow"
        fits = a["mine"] & (value != "") & path.startswith(value) & ((F.length(value) > a["best"]) | (allow & (F.length(value) == a["best"])))
        ruled = F.struct(a["mine"].alias("mine"), F.lit(True).alias("ruled"), F.when(fits, F.length(value)).otherwise(a["best"]).alias("best"), F.when(fits, allow).otherwise(a["ok"]).alias("ok"))
        return F.when(field == "user-agent", named).when(field.isin("allow", "disallow"), ruled).otherwise(a)

    return F.aggregate(lines, step, take)["ok"]
