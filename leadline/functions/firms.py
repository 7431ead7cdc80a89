"""Kinds of firms, the texts they are searched by, and the addresses of their pages, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a short kind of firm is searched as.
EXPANSIONS = {
    "ca": "chartered accountant CA firm", "ca firm": "chartered accountant CA firm", "cpa": "CPA certified public accountant firm", "cpa firm": "CPA certified public accountant firm", "cfo services": "outsourced CFO financial advisory firm", "audit firm": "audit and assurance accounting firm", "tax": "tax consultancy accounting firm",
    "bpo": "BPO business process outsourcing company", "kpo": "KPO knowledge process outsourcing company", "lpo": "LPO legal process outsourcing company", "rpo": "RPO recruitment process outsourcing company", "ites": "ITES IT-enabled services company", "call center": "call center BPO contact center", "contact center": "contact center BPO", "shared services": "shared services center GBS",
    "it": "IT services technology company", "it company": "IT services technology company", "it services": "IT services company", "msp": "MSP managed IT service provider", "managed service provider": "MSP managed IT service provider", "saas": "SaaS software company", "software": "software development company", "software company": "software development company", "cloud": "cloud services company", "cybersecurity": "cybersecurity firm", "ai": "AI artificial intelligence company", "data analytics": "data analytics company",
    "consulting": "consulting firm", "consulting company": "management consulting firm", "management consulting": "management consulting firm", "strategy consulting": "strategy consulting firm", "hr consulting": "HR consulting firm", "staffing": "staffing recruitment agency", "recruitment agency": "recruitment staffing agency", "law firm": "law firm attorneys legal services", "legal services": "law firm legal services", "engineering firm": "engineering services firm", "architecture firm": "architecture design firm",
    "agency": "agency", "marketing agency": "marketing agency", "digital agency": "digital marketing agency", "advertising agency": "advertising agency", "pr firm": "public relations PR agency",
    "manufacturer": "manufacturing company", "hospital": "hospital healthcare provider", "healthcare": "healthcare company clinic", "hotel": "hotel hospitality", "real estate": "real estate agency", "logistics": "logistics freight company",
}
#: Other texts that a kind of firm is searched by.
VARIANTS = {
    "ca": ["chartered accountant", "CA firm", "tax consultant", "audit firm", "GST consultant"], "ca firm": ["chartered accountant", "CA firm", "tax consultant", "audit firm", "GST consultant"], "cpa": ["CPA firm", "certified public accountant", "tax preparation", "accounting firm"], "cpa firm": ["CPA firm", "certified public accountant", "tax preparation", "accounting firm"], "audit firm": ["audit firm", "assurance services", "chartered accountant"], "tax": ["tax consultant", "tax preparation service", "accounting firm"],
    "bpo": ["BPO company", "business process outsourcing", "call center services"], "kpo": ["KPO company", "knowledge process outsourcing", "research outsourcing"], "it": ["IT services company", "software company", "technology consulting"], "it company": ["IT services company", "software company", "technology consulting"], "it services": ["IT services company", "software development", "technology consulting"], "msp": ["managed IT service provider", "IT support company", "IT services"], "software": ["software development company", "software agency", "IT services"], "software company": ["software development company", "software agency", "IT services"],
    "law firm": ["law firm", "advocates", "legal services", "attorneys"], "legal services": ["legal services", "law firm", "advocates"], "marketing agency": ["marketing agency", "digital marketing agency", "branding agency"], "digital agency": ["digital marketing agency", "web design agency", "SEO agency"], "recruitment agency": ["recruitment agency", "staffing agency", "placement services"], "staffing": ["staffing agency", "recruitment agency", "manpower services"], "real estate": ["real estate agency", "property dealer", "realtor"], "consulting": ["consulting firm", "business consultant", "advisory services"],
}
#: Kinds of firms by group.
GROUPS = {
    "Accounting & Finance": ["CA Firm", "CPA Firm", "Accounting Firm", "Audit Firm", "Tax Consultancy", "Bookkeeping Firm", "Financial Advisory", "Wealth Management"],
    "IT & Technology": ["IT Company", "IT Services", "Software Company", "SaaS Company", "Cloud Services", "Cybersecurity Firm", "AI / Data Analytics", "Managed Service Provider (MSP)"],
    "Outsourcing": ["BPO", "KPO", "LPO", "RPO", "ITES", "Call Center", "Shared Services"],
    "Consulting & Staffing": ["Management Consulting", "Strategy Consulting", "HR Consulting", "Recruitment Agency", "Staffing Firm", "Business Consulting"],
    "Professional Services": ["Law Firm", "Legal Services", "Engineering Firm", "Architecture Firm"],
    "Marketing & Agencies": ["Marketing Agency", "Digital Agency", "Advertising Agency", "PR Firm"],
    "Industry": ["Manufacturer", "Hospital", "Healthcare", "Hotel", "Real Estate", "Logistics"],
}
#: Hosts of pages, and beginnings of paths that are no firm's page.
PAGE_HOSTS = ("facebook.com", "www.facebook.com", "m.facebook.com", "fb.com")
NOT_PAGES = ("/profile.php", "/people/", "/groups/", "/messages/", "/watch", "/marketplace", "/events/", "/story.php", "/photo", "/permalink.php")
#: What says in a snippet that a firm is hiring.
HIRING_TERMS = r"(?i)\b(hiring|we\s*'?re\s+hiring|now\s+hiring|join\s+our\s+team|careers?|vacanc(?:y|ies)|open\s+positions?|job\s+openings?|apply\s+now|recruit)\b"


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, null without one."""
    kind = "array<string>" if isinstance(next(iter(table.values())), list) else "string"
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(v))])[key].cast(kind)


def firm_key(kind: Column) -> Column:
    """Lower case, single spaces, without what stands from a bracket on."""
    return F.lower(F.trim(F.regexp_replace(F.substring_index(kind, "(", 1), r"\s+", " ")))


def group_of(kind: Column) -> Column:
    """(grp, kind) of a kind of firm as it is listed, case and white space aside; null if no group lists it."""
    listed = {t.lower(): (g, t) for g, ts in GROUPS.items() for t in ts}
    named = F.create_map(*[x for k, (g, t) in listed.items() for x in (F.lit(k), F.struct(F.lit(g).alias("grp"), F.lit(t).alias("kind")))])
    return F.try_element_at(named, F.lower(F.trim(F.regexp_replace(F.coalesce(kind, F.lit("")), r"\s+", " "))))


def search_phrase(kind: Column) -> Column:
    """The text a kind of firm is searched as: by its whole name, a bracketed short form, or its first word; else itself; '' of nothing."""
    key = firm_key(kind)
    short = F.lower(F.trim(F.regexp_extract(kind, r"\(([^)]*)\)", 1)))
    return F.coalesce(lookup(EXPANSIONS, key), lookup(EXPANSIONS, short), lookup(EXPANSIONS, F.substring_index(key, " ", 1)), F.trim(kind), F.lit(""))


def search_variants(kind: Column, limit: int) -> Column:
    """The phrase first, then other texts that differ from it in more than case; at most `limit`, at least one."""
    key, anchor = firm_key(kind), search_phrase(kind)
    none = F.expr("cast(array() as array<string>)")
    others = F.coalesce(lookup(VARIANTS, key), lookup(VARIANTS, F.substring_index(key, " ", 1)), none)
    every = F.concat(F.when(anchor != "", F.array(anchor)).otherwise(none), F.filter(others, lambda v: F.lower(v) != F.lower(anchor)))
    return F.when(F.size(every) == 0, F.array(F.lit("companies"))).otherwise(F.slice(every, 1, max(1, limit)))


def text_query(phrase: Column, services: Column, *places: Column) -> Column:
    """Phrase, the first three services and 'in' the first place that is named; 'companies' if nothing is said."""
    named = lambda c: F.nullif(c, F.lit(""))
    where = F.coalesce(*[named(p) for p in places])
    said = F.trim(F.concat_ws(" ", named(phrase), named(F.array_join(F.slice(services, 1, 3), " ")), F.concat(F.lit("in "), where)))
    return F.coalesce(named(said), F.lit("companies"))


def homepage(website: Column, domain: Column) -> Column:
    """The listed address with a scheme, else the domain's without www."""
    site = F.nullif(F.trim(website), F.lit(""))
    listed = F.when(site.rlike("^https?://"), site).otherwise(F.concat(F.lit("https://"), site))
    return F.coalesce(listed, F.concat(F.lit("https://"), F.regexp_replace(F.nullif(F.trim(domain), F.lit("")), r"^www\.", "")))


def homepage_variants(base: Column) -> Column:
    """The address, then with the other scheme, then with www put on or off in both; no www for numbers and ports."""
    scheme, host, path = (F.regexp_extract(base, r"^(https?)://([^/?#]*)([^?#]*)", i) for i in (1, 2, 3))
    other = F.when(scheme == "https", "http").otherwise("https")
    toggled = F.when(host.startswith("www."), F.substring(host, 5, 1000)).otherwise(F.concat(F.lit("www."), host))
    at = lambda s, h: F.concat(s, F.lit("://"), h, path)
    two = F.array(base, at(other, host))
    return F.when(base.isNotNull(), F.array_distinct(F.when(host.rlike(r"^[0-9.]+$") | host.contains(":"), two).otherwise(F.concat(two, F.array(at(scheme, toggled), at(other, toggled))))))


def page_address(url: Column) -> Column:
    """A firm's page as https://www.facebook.com/<name>; null for other hosts, profiles, groups, posts and the start page."""
    parts = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
    host, path = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    name = F.regexp_extract(path, "^/*([^/]+)", 1)
    bad = F.lit(False)
    for p in NOT_PAGES:
        bad = bad | F.lower(path).startswith(p)
    return F.when(host.isin(*PAGE_HOSTS) & ~bad & (name != ""), F.concat(F.lit("https://www.facebook.com/"), name))


def is_hiring(*texts: Column) -> Column:
    return F.concat_ws(" ", *texts).rlike(HIRING_TERMS)


def retry_after(header: Column) -> Column:
    """Seconds of a Retry-After header, 120 at most; null for dates and none."""
    seconds = F.when(F.trim(header).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(header)).cast("double")
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(120.0)))


def with_footer(body: Column, text: Column, default: str = "Reply with 'unsubscribe' to receive no further messages.") -> Column:
    """The body with the way out below it, once."""
    out = F.trim(F.coalesce(F.nullif(text, F.lit("")), F.lit(default)))
    return F.when(F.contains(body, out), body).otherwise(F.concat(F.rtrim(F.regexp_replace(body, r"\s+$", "")), F.lit("\n\n-- \n"), out))


def mail_headers(message: Column, account: Column, app: str = "https://app.example.com") -> Column:
    """Headers by which a notice finds its message again, and a reader the way out."""
    host = app.split("//")[-1].split("/")[0].split(":")[0]
    return F.create_map(
        F.lit("Message-ID"), F.concat(F.lit("<lm-"), message, F.lit(f"@{host}>")),
        F.lit("List-Unsubscribe"), F.concat(F.lit(f"<{app}/unsubscribe?m="), message, F.lit(">, <mailto:"), account, F.lit("?subject=unsubscribe>")),
        F.lit("List-Unsubscribe-Post"), F.lit("List-Unsubscribe=One-Click"),
        F.lit("Auto-Submitted"), F.lit("auto-generated"),
    )
