"""The stages of address validation as column functions, and the rules that they follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions import ROLE_LOCALS, urls

#: Domains that the demonstration's mail lookup fails.
DEAD_DOMAINS = ("tempmail.com", "yopmail.com", "guerrillamail.com", "mailinator.com")
#: Throwaway domains that are known without a tenant's own; a parameter takes any larger list.
DISPOSABLE = (*DEAD_DOMAINS, "10minutemail.com", "trashmail.com", "sharklasers.com", "getnada.com", "dispostable.com", "maildrop.cc", "throwawaymail.com", "fakeinbox.com", "temp-mail.org", "mintemail.com", "spamgourmet.com")
#: Top levels that are set aside for other uses than mail.
SET_ASIDE = ("arpa", "invalid", "local", "localhost", "onion", "test")
ATOM = r"[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+"
LOCAL = rf"^{ATOM}(?:\.{ATOM})*$"


def domain_of(email: Column) -> Column:
    """What follows the last @, lower case, without spaces around and dots at the end; null if nothing does."""
    return F.when(F.instr(email, "@") > 0, F.nullif(F.regexp_replace(F.lower(F.trim(F.substring_index(email, "@", -1))), r"\.+$", ""), F.lit("")))


def syntax_ok(email: Column) -> Column:
    """One @, a dotted local part of at most 64 characters, a domain of two labels or more that may have mail.

    The domain may be of any script: its labels follow the rules for hosts, and lengths count in octets, the domain's in ASCII: 63 a label, 253 a
    domain, 254 in all. The top level begins with a letter.
    """
    local, domain = F.substring_index(email, "@", 1), F.lower(F.regexp_replace(F.substring_index(email, "@", -1), urls.DOTS, "."))
    top = F.substring_index(domain, ".", -1)
    shaped = email.rlike("^[^@]*@[^@]*$") & local.rlike(LOCAL) & (F.length(local) <= 64) & F.contains(domain, F.lit(".")) & top.rlike(r"^\p{L}") & ~top.isin(*SET_ASIDE)
    whole = lambda d: urls.valid_host(d) & (F.octet_length(local) + 1 + F.octet_length(urls.ascii_host(d)) <= 254)
    return F.coalesce(shaped & urls.let(domain, whole), F.lit(False))


def disposable(email: Column, extra: list[str] | None = None) -> Column:
    """A throwaway domain, known or a tenant's own; an address without a domain is none."""
    known = {x.strip().lower().rstrip(".") for x in (*DISPOSABLE, *(extra or [])) if x.strip()}
    return F.coalesce(domain_of(email).isin(*sorted(known)), F.lit(False))


def role_based(email: Column, keywords: list[str] | None = None) -> Column:
    """The local part, or a part of it between . _ - and +, is a role."""
    words = sorted({k.strip().lower() for k in (ROLE_LOCALS if keywords is None else keywords) if k.strip()})
    if not words:
        return F.lit(False)
    local = F.lower(F.trim(F.regexp_extract(email, "^(.*)@", 1)))
    parts = F.concat(F.array(local), F.split(local, r"[._+\s-]+"))
    return F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, words))), F.lit(False))


def mx_status(email: Column, ok: Column) -> Column:
    """skipped where the syntax fails, fail without a domain or for a dead one, else pass."""
    domain = domain_of(email)
    return F.when(~ok, "skipped").when(domain.isNull() | domain.isin(*DEAD_DOMAINS), "fail").otherwise("pass")


def stable_unit(*parts: Column) -> Column:
    """A number in [0, 1) that the parts alone decide: the first 48 bits of their SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


#: Fields of a rule set that have a closed list of values, and the default of each.
CHOICES = {"llm_mode": (("advisory", "hard"), "advisory"), "catch_all_policy": (("review", "allow"), "review"), "risk_policy": (("review", "reject"), "review")}
RETRY = {"max_attempts": 3, "delay_hours": 6}
#: What a settings page calls the fields of the pipeline.
SHOWN_AS = {"role_based_keywords": "role_keywords", "catch_all_handling": "catch_all_policy", "risk_handling": "risk_policy"}


def decode_rules(raw: dict | None) -> dict:
    """A tenant's rules with every field there and in its range; what is unknown or out of range takes the default."""
    given = raw or {}
    out = {field: v if (v := str(given.get(field, default)).lower()) in allowed else default for field, (allowed, default) in CHOICES.items()}
    try:
        threshold = float(given.get("llm_threshold", 0.55))
    except (TypeError, ValueError):
        threshold = 0.55
    words = [w.strip().lower() for w in given.get("role_keywords") or () if isinstance(w, str) and w.strip()]
    retry = given.get("unknown_retry")
    if isinstance(retry, int) and not isinstance(retry, bool):  # a bare number counts tries
        retry = {"max_attempts": retry}
    retry = {k: retry[k] for k in RETRY if k in retry} if isinstance(retry, dict) else {}
    return out | {"llm_threshold": max(0.0, min(threshold, 1.0)), "role_keywords": words or list(ROLE_LOCALS), "allow_role_based": bool(given.get("allow_role_based", False)), "unknown_retry": RETRY | retry}


def patch_rules(rules: dict, patch: dict) -> dict:
    """rules with the patch of a settings page, each field under the page's name and the pipeline's."""
    out = dict(rules)
    for field, value in patch.items():
        if field in ("disposable_domains", "role_based_keywords"):
            value = [v.strip().lower() for v in value if v.strip()]
        out[field] = value
        if field in SHOWN_AS:
            out[SHOWN_AS[field]] = value
    if "unknown_retry_policy" in patch:
        out["unknown_retry"] = int(patch["unknown_retry_policy"] == "retry")
    return out


def sales_ready(status: Column, *flags: Column) -> Column:
    """VERIFIED, and none of the flags that speak against it; a null flag doesn't."""
    ok = F.coalesce(status == "VERIFIED", F.lit(False))
    for f in flags:
        ok = ok & ~F.coalesce(f, F.lit(False))
    return ok


def granted(grants: Column, name: Column) -> Column:
    """Whether grants hold a name, or * for all; no grants hold nothing."""
    return F.coalesce(F.arrays_overlap(grants, F.array(F.lit("*"), name)), F.lit(False))


def patched(rules: Column, patch: Column) -> Column:
    """A map of rules with a settings page's patch, as `patch_rules` does for one tenant: each field under the page's name and the pipeline's, the policy of
    retries also as a number."""
    shown = F.create_map(*[F.lit(x) for kv in SHOWN_AS.items() for x in kv])
    renamed = F.filter(F.transform(F.map_entries(patch), lambda e: F.struct(F.try_element_at(shown, e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    retry = F.try_element_at(patch, F.lit("unknown_retry_policy"))
    number = F.when(retry.isNotNull(), F.array(F.struct(F.lit("unknown_retry").alias("key"), F.when(retry == "retry", "1").otherwise("0").alias("value")))).otherwise(F.slice(renamed, 1, 0))
    new = F.map_zip_with(F.map_from_entries(F.concat(renamed, number)), patch, lambda k, a, b: F.coalesce(b, a))
    return F.map_zip_with(rules, new, lambda k, a, b: F.coalesce(b, a))
