"""Phone numbers that can be dialled, as column functions: calling codes as a prefix tree, national numbers by their plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions import urls
from leadline.functions.urls import let

#: Countries and their regions.
REGIONS = {"india": "IN", "in": "IN", "united states": "US", "usa": "US", "us": "US", "united kingdom": "GB", "uk": "GB", "gb": "GB", "canada": "CA", "australia": "AU", "germany": "DE", "france": "FR", "singapore": "SG", "united arab emirates": "AE", "uae": "AE"}
#: Fixed values (E.164): calling codes of two digits, beginnings of those of three, and which of the latter are not assigned. 1 and 7 stand alone.
TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
THREE = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
FREE = "210 214 215 217 219 259 292 293 294 295 296 384 388 422 424 425 426 427 428 429 671 684 693 694 695 696 697 698 699 801 802 803 804 805 806 807 809 851 854 857 858 859 871 872 873 874 875 876 877 879 884 885 887 889 969 978 990 991 997 999".split()


def tree(codes: list[str]) -> str:
    """A pattern of the codes' prefix tree: every digit is looked at once."""
    if "" in codes:
        return ""
    first = sorted({c[0] for c in codes})
    branches = [d + tree([c[1:] for c in codes if c[0] == d]) for d in first]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


CODES = ["1", "7", *TWO, *(f"{t}{d}" for t in THREE for d in range(10) if f"{t}{d}" not in FREE)]
CODE = f"^({tree(CODES)})"


@dataclass(frozen=True)
class Plan:
    """A country's calling code, what stands before national numbers at home and before foreign ones, and the national numbers in use."""

    code: str
    trunk: str
    abroad: str
    numbers: str

    @property
    def whole(self) -> str:
        return f"^(?:{self.numbers})$"


_AMERICA = Plan("1", "1", "011", r"(?:[2-8](?:0[0-9]|1[02-9]|[2-8][0-9])|9(?:0[0-9]|1[02-9]|[2-57-8][0-9]))[2-9](?:0[0-9]|1[02-9]|[2-9][0-9])[0-9]{4}")
#: Numbering plans by region, of mobile, geographic and special numbers; a parameter takes any others.
PLANS = {
    "US": _AMERICA,
    "CA": _AMERICA,
    "IN": Plan("91", "0", "00", r"[6-9][0-9]{9}|(?:11|2[02]|33|4[04]|79|80)[2-7][0-9]{7}|[1-8][0-9]{2}[2-7][0-9]{6}|[1-8][0-9]{3}[2-7][0-9]{5}|1800[0-9]{6,7}"),
    "GB": Plan("44", "0", "00", r"1[1-9][0-9]{7,8}|2[03489][0-9]{8}|3[0347][0-9]{8}|5[56][0-9]{8}|7[0-57-9][0-9]{8}|76[0-9]{8}|80[08][0-9]{6,7}|8[47][0-9]{8}|9[018][0-9]{8}"),
    "AU": Plan("61", "0", "0011", r"[2378][0-9]{8}|4[0-9]{8}|1[38]00[0-9]{6}|13[0-9]{4}"),
    "DE": Plan("49", "0", "00", r"1(?:5[0-9]{9,10}|6[023][0-9]{7,8}|7[0-9]{8,9})|[2-79][0-9]{5,10}|8(?:[1-9][0-9]{4,9}|00[0-9]{7,10})|1(?:80|37)[0-9]{7}"),
    "FR": Plan("33", "0", "00", r"[1-79][0-9]{8}|8[0-9]{8}"),
    "SG": Plan("65", "", "00", r"[689][0-9]{7}|3[0-9]{7}|1800[0-9]{7}"),
    "AE": Plan("971", "0", "00", r"[2-4679][2-8][0-9]{6}|5[024-68][0-9]{7}|800[0-9]{2,9}|600[25][0-9]{5}"),
}
#: A run of eight digits or more with separators, after neither a word character nor a dot (which group 1 holds).
PHONE = r"(^|[^0-9A-Za-z_.])(\+?\(?[0-9][0-9\s().\-]{6,}[0-9])"
#: A national number where no plan is known: six digits or more.
ANY = "^[1-9][0-9]{5,13}$"


def region(country: Column) -> Column:
    """The region of a country's name; two letters that aren't listed stand for themselves."""
    key = F.lower(F.trim(country))
    listed = F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv]), F.coalesce(key, F.lit("")))
    return F.coalesce(listed, F.when(F.length(key) == 2, F.upper(key)))


def _national(n: Column, plan: Plan) -> Column:
    """+, code and national number, the trunk digit dropped where only then the plan fits; null if it doesn't."""
    out = F.when(n.rlike(plan.whole), n)
    if plan.trunk:
        rest = F.substring(n, len(plan.trunk) + 1, 20)
        out = out.when(n.startswith(plan.trunk) & rest.rlike(plan.whole), rest)
    return F.concat(F.lit(f"+{plan.code}"), out)


def _international(digits: Column, plans: dict[str, Plan]) -> Column:
    """Digits that begin with a calling code."""
    code = F.regexp_extract(digits, CODE, 1)
    by_code = {p.code: p for p in plans.values()}

    def of(code: Column) -> Column:
        rest = F.substring(digits, F.length(code) + 1, F.lit(20))
        out = None
        for c, plan in sorted(by_code.items()):
            out = F.when(code == c, _national(rest, plan)) if out is None else out.when(code == c, _national(rest, plan))
        known = (code != "") & rest.rlike(ANY) & F.length(digits).between(7, 15)
        any_plan = F.when(known, F.concat(F.lit("+"), digits))
        return any_plan if out is None else out.otherwise(any_plan)

    return let(code, of)


def e164(raw: Column, region: Column, plans: dict[str, Plan] = PLANS) -> Column:
    """A number as + and digits if it can be dialled: an international one by its code's plan, else one of the region's, with or without
    the trunk digit, the region's own code, or the prefix for calls abroad; null otherwise."""

    def of(x: Column) -> Column:
        digits = x["digits"]
        out = F.when(x["plus"], _international(digits, plans))
        for name, plan in plans.items():
            abroad = F.when(digits.startswith(plan.abroad), _international(F.substring(digits, len(plan.abroad) + 1, 20), plans))
            coded = F.when(digits.startswith(plan.code), _national(F.substring(digits, len(plan.code) + 1, 20), plan))
            out = out.when(region == name, F.coalesce(_national(digits, plan), abroad, coded))
        return out

    return let(F.struct(F.trim(raw).startswith("+").alias("plus"), F.regexp_replace(raw, "[^0-9]", "").alias("digits")), of)


def numbers(candidates: Column, region: Column, plans: dict[str, Plan] = PLANS) -> Column:
    """Distinct numbers of an array of texts, in their order."""
    return F.array_distinct(F.filter(F.transform(candidates, lambda x: e164(x, region, plans)), lambda x: x.isNotNull()))


def phones(text: Column, region: Column, plans: dict[str, Plan] = PLANS) -> Column:
    """Distinct numbers of a text in the order of their first places."""
    return numbers(F.regexp_extract_all(text, F.lit(PHONE), F.lit(2)), region, plans)


def linked(html: Column) -> Column:
    """What tel: links say, in order: without parameters, escapes resolved."""
    tags = F.regexp_extract_all(html, F.lit(urls.TAG.format("a")), F.lit(0))
    href = F.filter(F.transform(tags, lambda t: urls.attribute(t, "href")), lambda h: h.rlike("(?i)^tel:"))
    plain = lambda h: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(h, 5, 200), ";.*$", ""), "(?i)%2B", "+"), "%[0-9a-fA-F]{2}", " ")
    return F.transform(href, plain)


def page_phones(html: Column, region: Column, plans: dict[str, Plan] = PLANS) -> Column:
    """Distinct numbers of a page: of its tel: links first, then of its visible text."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), urls.ANY_TAG, " ")
    return numbers(F.concat(linked(html), F.regexp_extract_all(text, F.lit(PHONE), F.lit(2))), region, plans)
