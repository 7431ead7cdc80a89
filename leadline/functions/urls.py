"""References, hosts and registrable domains as column functions; all JVM-side, folds over arrays where a rule goes step by step."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def split(reference: Column) -> Column:
    """scheme, authority, path, query, fragment of a reference as a struct; null where a part isn't there, which an empty one is."""
    start = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"
    found = lambda has, pattern: F.when(reference.rlike(has), F.regexp_extract(reference, pattern, 1))
    return F.struct(
        F.lower(found(SCHEME, r"^([a-zA-Z][a-zA-Z0-9+.-]*):")).alias("scheme"),
        found(start + "//", start + "//([^/?#]*)").alias("authority"),
        F.regexp_extract(reference, start + r"(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        found(r"(?s)^[^#]*\?", r"(?s)^[^?#]*\?([^#]*)").alias("query"),
        found("#", r"(?s)^[^#]*#(.*)$").alias("fragment"),
    )


def without_dots(path: Column) -> Column:
    """A path without . and .. segments: a fold that keeps a stack of segments; .. at the root goes."""
    return let(path, _without_dots)


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    rooted = path.startswith("/")
    empty = F.expr("cast(array() as array<string>)")

    def step(stack: Column, s: Column) -> Column:
        floor = F.when(rooted, 1).otherwise(0)  # the empty segment before the first slash
        up = F.when(F.size(stack) > floor, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        return F.when(s == ".", stack).when(s == "..", up).otherwise(F.concat(stack, F.array(s)))

    slashed = lambda kept: F.when(rooted & ~kept.startswith("/"), F.concat(F.lit("/"), kept)).otherwise(kept)
    folder = lambda kept: F.when(path.rlike(r"(^|/)\.\.?$") & (kept != "") & ~kept.endswith("/"), F.concat(kept, F.lit("/"))).otherwise(kept)
    return let(let(F.array_join(F.aggregate(segments, empty, step), "/"), slashed), folder)


def resolve(base: Column, reference: Column) -> Column:
    """A reference against an absolute base (RFC 3986, 5.2), white space around it and inside lines dropped; null if either is null."""
    r = lambda x: split(F.regexp_replace(F.trim(x), r"[\t\r\n]", ""))
    return let(r(reference), lambda x: let(split(base), lambda b: F.when(base.isNotNull() & reference.isNotNull(), _resolved(b, x))))


def _resolved(b: Column, r: Column) -> Column:
    own = r["scheme"].isNotNull() | r["authority"].isNotNull()
    folder = F.regexp_extract(b["path"], r"(?s)^(.*/)?[^/]*$", 1)
    merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    path = F.when(own | r["path"].startswith("/"), without_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(without_dots(merged))
    query = F.when(own | (r["path"] != "") | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
    scheme = F.coalesce(r["scheme"], b["scheme"])
    authority = F.when(own, r["authority"]).otherwise(b["authority"])
    lead = lambda mark, part: F.coalesce(F.concat(F.lit(mark), part), F.lit(""))
    return F.concat(F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), lead("//", authority), path, lead("?", query), lead("#", r["fragment"]))


#: An attribute's value in double or single quotes or none, as three groups.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))"""
#: A tag up to the value of the attribute {}, over the attributes before it.
ATTRIBUTE = r"""(?is)^<[a-z][^\s/>]*(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*?\s+{}\s*=\s*""" + VALUE


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, however it is quoted, trimmed; null where it isn't there."""
    found = ATTRIBUTE.format(name)
    parts = [F.regexp_extract(tag, found, i) for i in (1, 2, 3)]
    return F.when(tag.rlike(found), F.trim(F.concat(*parts)))


#: A start tag to its end, quoted values and all.
TAG = r"""(?is)<{}\b(?:[^"'>]|"[^"]*"|'[^']*')*>"""
ANY_TAG = r"""</?[a-zA-Z!](?:[^"'>]|"[^"]*"|'[^']*')*>"""


def base_of(html: Column, url: Column) -> Column:
    """What a page's references stand against: its first base element's address, resolved against the page's own, else that."""
    tag = F.try_element_at(F.regexp_extract_all(html, F.lit(TAG.format("base")), F.lit(0)), F.lit(1))
    href = F.nullif(attribute(tag, "href"), F.lit(""))
    return F.coalesce(resolve(url, href), url)


# ---- hosts in ASCII

#: The parameters of Punycode (RFC 3492).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128


def _digit(d: Column) -> Column:
    return F.chr(F.when(d < 26, d + 97).otherwise(d + 22))


def _number(delta: Column, bias: Column) -> Column:
    """A number in digits of variable thresholds: seven suffice for labels of 63 characters and any code point."""
    start = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(a: Column, k: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), k * BASE - bias)).cast("long")
        last = a["q"] < t
        more = F.struct(F.floor((a["q"] - t) / (BASE - t)).cast("long").alias("q"), F.concat(a["out"], _digit(t + (a["q"] - t) % (BASE - t))).alias("out"), F.lit(False).alias("done"))
        end = F.struct(a["q"].alias("q"), F.concat(a["out"], _digit(a["q"])).alias("out"), F.lit(True).alias("done"))
        return F.when(a["done"], a).when(last, end).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)["out"]


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    d = F.floor(delta / F.when(first, DAMP).otherwise(2)).cast("long")
    d = d + F.floor(d / points).cast("long")
    start = F.struct(d.alias("d"), F.lit(0).alias("k"))
    limit = (BASE - T_MIN) * T_MAX // 2
    x = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, lambda a, _: F.when(a["d"] > limit, F.struct(F.floor(a["d"] / (BASE - T_MIN)).cast("long").alias("d"), (a["k"] + BASE).alias("k"))).otherwise(a))
    return (x["k"] + F.floor((BASE - T_MIN + 1) * x["d"] / (x["d"] + SKEW))).cast("int")


def punycode(label: Column) -> Column:
    """A label's Punycode without prefix (RFC 3492). Its other characters go in by value, then place: a fold over them, each
    with the number of characters that stand before it once it is in."""
    named = lambda c, i: F.struct(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long").alias("c"), i.alias("i"), c.alias("s"))
    return let(F.transform(F.split(label, ""), named), _punycode)


def _punycode(points: Column) -> Column:
    plain = F.filter(points, lambda x: x["c"] < FIRST_N)
    # characters of a smaller value stand already; of equal ones those to the left do
    before = lambda x: F.size(F.filter(points, lambda y: (y["i"] < x["i"]) & (y["c"] <= x["c"])))
    other = F.array_sort(F.transform(F.filter(points, lambda x: x["c"] >= FIRST_N), lambda x: F.struct(x["c"].alias("c"), x["i"].alias("i"), before(x).alias("place"))))
    start = F.struct(F.lit(FIRST_N).cast("long").alias("n"), F.lit(0).alias("i"), F.size(plain).alias("h"), F.lit(True).alias("first"), F.lit(FIRST_BIAS).alias("bias"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        size = a["h"] + 1
        delta = (x["c"] - a["n"]) * size + x["place"] - a["i"]
        return let(delta, lambda d: F.struct(x["c"].alias("n"), (x["place"] + 1).alias("i"), size.alias("h"), F.lit(False).alias("first"), _adapted(d, size, a["first"]).alias("bias"), F.concat(a["out"], _number(d, a["bias"])).alias("out")))

    basic = F.array_join(F.transform(plain, lambda x: x["s"]), "")
    return F.concat(basic, F.when(F.size(plain) > 0, "-").otherwise(""), F.aggregate(other, start, step)["out"])


#: Dots of other scripts, which part labels like one.
DOTS = "[。．｡]"


def ascii_host(host: Column) -> Column:
    """A host in lower case with its labels in ASCII: those of other letters as xn-- and their Punycode."""
    one = lambda x: F.when(x.rlike(r"^[\x00-\x7F]*$"), x).otherwise(F.concat(F.lit("xn--"), punycode(x)))
    whole = lambda low: F.when(low.rlike(r"^[\x00-\x7F]*$"), low).otherwise(F.array_join(F.transform(F.split(low, "[.]"), one), "."))
    return let(F.lower(F.regexp_replace(host, DOTS, ".")), whole)


#: A label in ASCII: letters, digits and inner hyphens; in other letters: those, their marks and digits, no mark first.
PLAIN_LABEL, OTHER_LABEL = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$", r"^[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}·-]*[\p{L}\p{M}\p{N}])?$"


def valid_host(host: Column) -> Column:
    """Every label follows the rules of its kind, has at most 63 octets in ASCII and no -- in its third place but for xn--; 253 octets in all."""
    shaped = lambda low: F.forall(F.split(low, "[.]"), lambda x: (x.rlike(PLAIN_LABEL) | (x.rlike(OTHER_LABEL) & ~x.rlike(r"^[\x00-\x7F]*$"))) & (~x.rlike("^..--") | x.rlike("^xn--[a-z0-9-]*[a-z0-9]$")))
    sound = let(F.lower(F.regexp_replace(host, DOTS, ".")), lambda low: F.when(shaped(low), ascii_host(low)))
    return F.coalesce(let(sound, lambda h: F.forall(F.split(h, "[.]"), lambda x: F.length(x).between(1, 63)) & (F.length(h) <= 253)), F.lit(False))


# ---- registrable domains


@dataclass(frozen=True)
class Suffixes:
    """Suffix rules by number of labels, each as its last labels: a trie of reversed labels, a level at a time.

    plain['co.uk'] takes both labels; wild['ck'] takes one more label than its own; an exception takes one less.
    """

    plain: frozenset[str] = field(default_factory=frozenset)
    wild: frozenset[str] = field(default_factory=frozenset)
    exceptions: frozenset[str] = field(default_factory=frozenset)
    #: Any top level of two letters is a country's.
    countries: bool = False

    @property
    def depth(self) -> int:
        return max([1, *(r.count(".") + 1 for r in self.plain | self.exceptions), *(r.count(".") + 2 for r in self.wild)])

    def level(self, rules: str, labels: int) -> list[str]:
        return sorted(r for r in getattr(self, rules) if r.count(".") + 1 == labels)


def suffixes(lines: Iterable[str], private: bool = False, countries: bool = False) -> Suffixes:
    """Rules in the published form: one a line, // before comments, *. for any label, ! for an exception; the private section if asked for."""
    found: dict[str, set[str]] = {"plain": set(), "wild": set(), "exceptions": set()}
    take = True
    for line in lines:
        if "BEGIN PRIVATE DOMAINS" in line:
            take = private
        elif "END PRIVATE DOMAINS" in line:
            take = True
        rule = line.strip().split(" ")[0].split("\t")[0].lower()
        if not rule or rule.startswith("//") or not take:
            continue
        kind = "exceptions" if rule[0] == "!" else "wild" if rule.startswith("*.") else "plain"
        rule = rule.removeprefix("!").removeprefix("*.").strip(".")
        found[kind].add(".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split(".")))
    return Suffixes(*(frozenset(found[k]) for k in ("plain", "wild", "exceptions")), countries)


#: Common rules, for where no published list is given; countries stand for themselves.
COMMON = suffixes(
    """com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev page cloud online site store shop tech xyz blog agency
    company consulting digital email group legal tax finance health law ltd media network news partners services software solutions studio support systems team work world
    co.uk org.uk me.uk ltd.uk plc.uk net.uk ac.uk gov.uk nhs.uk police.uk sch.uk
    co.in firm.in net.in org.in gen.in ind.in ac.in edu.in gov.in nic.in res.in
    com.au net.au org.au edu.au gov.au asn.au id.au co.nz net.nz org.nz ac.nz govt.nz school.nz
    com.sg net.sg org.sg edu.sg gov.sg co.ae net.ae org.ae ac.ae gov.ae sch.ae
    co.jp ne.jp or.jp ac.jp ad.jp ed.jp go.jp gr.jp lg.jp co.kr ne.kr or.kr re.kr pe.kr go.kr ac.kr
    com.cn net.cn org.cn gov.cn edu.cn ac.cn com.hk net.hk org.hk edu.hk gov.hk com.tw net.tw org.tw edu.tw gov.tw
    com.br net.br org.br gov.br edu.br com.mx net.mx org.mx gob.mx edu.mx com.ar net.ar org.ar gob.ar edu.ar
    co.za net.za org.za ac.za gov.za web.za co.il org.il net.il ac.il gov.il com.tr net.tr org.tr edu.tr gov.tr
    com.my net.my org.my edu.my gov.my com.ph net.ph org.ph co.id or.id ac.id go.id web.id co.th or.th ac.th go.th in.th
    *.ck !www.ck *.kawasaki.jp !city.kawasaki.jp *.np *.bd *.er *.fk *.jm *.kh *.mm *.pg""".split(),
    countries=True,
)


def registrable(host: Column, rules: Suffixes = COMMON) -> Column:
    """The label before a host's longest suffix, and that suffix; the whole host where no rule knows its end (addresses of
    numbers, single labels, unknown top levels); '.' and the suffix where nothing stands before it."""
    return let(host, lambda h: let(F.split(h, "[.]"), lambda labels: let(_length(labels, rules), lambda n: _registrable(h, labels, n))))


def _length(labels: Column, rules: Suffixes) -> Column:
    """Labels of the longest suffix, 0 if no rule knows one: levels from the top, then the exceptions."""
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".")
    chain = [((F.size(labels) >= k) & tail(k).isin(*some), k - 1) for k in range(rules.depth, 1, -1) if (some := rules.level("exceptions", k))]
    for k in range(rules.depth, 0, -1):
        hits = [tail(k).isin(*plain)] if (plain := rules.level("plain", k)) else []
        if k > 1 and (wild := rules.level("wild", k - 1)):
            hits.append(tail(k - 1).isin(*wild))
        if k == 1 and rules.countries:
            hits.append(tail(1).rlike("^[a-z]{2}$"))
        chain += [((F.size(labels) >= k) & hit, k) for hit in hits]
    out = None
    for hit, n in chain:
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return F.lit(0) if out is None else out.otherwise(0)


def _registrable(host: Column, labels: Column, n: Column) -> Column:
    number = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | host.startswith("[")
    own = F.when(F.size(labels) > n, F.element_at(labels, F.greatest(F.size(labels) - n, F.lit(1)))).otherwise("")
    suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(number | (n == 0), host).otherwise(F.concat(own, F.lit("."), suffix))
