"""Column functions on addresses, names, phones, bounces and places; all JVM-side."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a company name's slug leaves out.
LEGAL_FORMS = ("inc", "incorporated", "llc", "llp", "ltd", "limited", "pvt", "private", "plc", "co", "corp", "corporation", "company", "gmbh", "sa", "srl", "bv", "ag", "pty", "group", "holdings", "partners", "associates", "and", "the")
#: Local parts of role mailboxes.
ROLE_LOCALS = ("info", "support", "sales", "admin", "careers", "jobs", "hr", "marketing", "contact", "hello")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def normalize_domain(c: Column) -> Column:
    """Host of a URL or the part after an address's last @: lower case, no scheme, user, port, path, www or trailing dots; null if nothing is left."""
    s = F.lower(F.trim(c))
    s = F.when(s.contains("//"), s).otherwise(F.substring_index(s, "@", -1))
    host = F.regexp_extract(s, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_extract(F.trim(host), r"^(?:www\.)?(.*?)\.*$", 1), F.lit(""))


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition holds one ASCII character, that character, and those that hold several."""
    one, plain, several = [], [], {}
    for n in range(128, sys.maxunicode + 1):
        kept = unicodedata.normalize("NFKD", chr(n)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            one.append(chr(n))
            plain.append(kept)
        elif kept and n < 0x10000:
            several[chr(n)] = kept
    return "".join(one), "".join(plain), several


MARKED, PLAIN, SEVERAL = _decomposed()


def ascii_letters(c: Column) -> Column:
    """Text without marks: what is ASCII in its compatibility decomposition."""
    table = F.create_map(*[F.lit(x) for kv in SEVERAL.items() for x in kv])
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], x)), "")
    wide = F.when(c.rlike("[" + "".join(SEVERAL) + "]"), spread).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(wide, MARKED, PLAIN), r"[^\x00-\x7F]", "")).otherwise(c)


def normalize_phone(c: Column) -> Column:
    """A leading + if there, and the digits; null without digits."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(digits != "", F.concat(F.when(F.trim(c).startswith("+"), "+").otherwise(""), digits))


def slug_name(c: Column) -> Column:
    """Lower-case words joined by hyphens, legal forms left out unless nothing else is there; null without words."""
    words = F.filter(F.split(F.lower(ascii_letters(c)), "[^a-z0-9]+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS))
    return F.nullif(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), "-"), F.lit(""))


def company_key(domain: Column, name: Column, phone: Column, address: Column | None = None) -> Column:
    """The first of domain, name, phone and address that says something, with its kind."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    keys = [named("domain", normalize_domain(domain)), named("name", slug_name(name)), named("phone", normalize_phone(phone))]
    return F.coalesce(*keys, *([named("addr", slug_name(address))] if address is not None else []))


def is_role(local: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(local), "[._+-]"), F.array(*map(F.lit, ROLE_LOCALS)))


def decide(c: dict[str, Column], role_ok: bool = False, llm_hard: bool = True, catch_all_ok: bool = False, risk_rejected: bool = False) -> Column:
    """Final state of an address, the first rule that holds: suppressed, syntax, disposable, role, mx, llm (only if hard), then the verifier's word."""
    mv = c["mv_status"]
    return (
        F.when(c["suppressed"], "SUPPRESSED")
        .when(~c["syntax_ok"], "INVALID_SYNTAX")
        .when(c["disposable"], "DISPOSABLE_REJECTED")
        .when(c["role_based"] & F.lit(not role_ok), "ROLE_BASED_REJECTED")
        .when(c["mx_status"] == "fail", "MX_FAILED")
        .when(F.lit(llm_hard) & (c["llm_score"] < c["llm_threshold"]), "LLM_LOW_CONFIDENCE")
        .when(mv.isNull() | (mv == "valid"), "VERIFIED")
        .when(mv == "invalid", "PROVIDER_INVALID")
        .when(mv == "catch_all", "VERIFIED" if catch_all_ok else "CATCH_ALL_REVIEW")
        .when(mv == "risk", "PROVIDER_INVALID" if risk_rejected else "RISK_REVIEW")
        .otherwise("UNKNOWN_RETRY")
    )


def rounded(x: Column, places: int) -> Column:
    """A double to places as SQL's round() has it: the product with the power of ten goes to the nearest whole number, so that 0.5005 becomes 0.5, where
    Spark's own looks at the written digits."""
    return F.round(x * 10.0**places) / 10.0**places


def rate(part: Column, whole: Column) -> Column:
    """Per cent to two places; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(rounded(F.lit(100.0) * part / whole, 2))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def holds_keyword(keywords: list[str], *columns: Column) -> Column:
    """Some keyword stands in the columns, joined by spaces, whatever the case; empty keywords and null columns don't count."""
    hay = F.lower(F.concat_ws(" ", *columns))
    words = [k.strip().lower() for k in keywords if k.strip()]
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(hay, k)) if words else F.lit(False)


def merge_maps(old: Column, new: Column) -> Column:
    """All keys of both; the new value where both have one."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def remaining(elapsed: Column, per_cent: Column) -> Column:
    """What is left at the pace so far; null unless 0 < per_cent < 100."""
    return F.when((per_cent > 0) & (per_cent < 100), F.round(elapsed / (per_cent / 100.0) - elapsed, 3))


#: What one search finds, a directory adds, and the parts of a job's cost.
CEILING, DIRECTORY, SEARCHES, PAGES, PER_PAGE, GEOCODE = 60, 160, 40, 3, 0.032, 0.005
PER_CONTACT = (0.10 * 0.18, 0.0008, 0.0002)


def estimate(jobs, job: str, maps: str, directories: str, variants: str, tiles: str):
    """(job, companies, low, high, runtime, cost): whole numbers are cut, in exact decimals; where maps and directories both run, a fifth or so are the same."""
    whole = lambda c, hundredths: F.floor(c * hundredths / F.lit(100)).cast("long")
    both = F.col(maps) & F.col(directories)
    found = whole(F.lit(CEILING) * (F.lit(100) + 35 * (F.col(variants) - 1)) / 100, F.when(F.col(tiles) > 1, 250).otherwise(100))
    every = F.when(both, whole(found + DIRECTORY, F.lit(78))).when(F.col(maps), found).when(F.col(directories), F.lit(DIRECTORY)).otherwise(F.lit(0)).cast("long")
    out = jobs.withColumn("companies", every)
    contacts = whole(F.col("companies"), F.lit(250))
    searched = F.least(F.col(variants) * F.col(tiles), F.lit(SEARCHES)) * PAGES * PER_PAGE + GEOCODE
    cost = F.when(F.col(maps), searched).otherwise(F.lit(0.0)) + contacts * PER_CONTACT[0] + contacts * PER_CONTACT[1] + contacts * PER_CONTACT[2]
    c = F.col("companies")
    return out.select(job, "companies", whole(c, F.lit(85)).alias("low"), whole(c, F.lit(110)).alias("high"), F.greatest(F.lit(20).cast("long"), whole(c, F.lit(40))).alias("runtime"), F.round(cost, 2).alias("cost"))


def same_firm(named: Column, wanted: Column) -> Column:
    """A name on a posting is that of the firm looked for: one holds the other, case and runs of white space aside; an absent name is nobody's."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a, b = plain(named), plain(wanted)
    return F.coalesce((named != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))
