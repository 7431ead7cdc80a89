"""URL filters as a temporal list join (operator 7, native).

Dated list entries (a domain or a URL prefix is added or removed on a day) become validity intervals; every
capture is evaluated against the intervals that hold on the day it was fetched. A capture's keys are its
host, every parent domain of two labels or more, and the prefixes of its URL at path separators; keys and
intervals meet in an equi-join with the day between the bounds, which Spark can split where a key is hot.

Captures are first reduced to distinct (URL, day), so that copies are evaluated once. Of one list, kind, value
and day one entry counts (a removal goes before an addition), so an entry's history is at most one row a day.

Defined results: null, empty and host-less URLs have no keys and no hits; a null day is before every
interval; an entry holds from its day to the day before the next one of its value; entries are read as captures are, and those
with a null field or without a host count as absent (`unreadable` gives them); without entries nothing is hit; repeated captures all return; an empty table of captures gives an
empty result. What stands before the last @ of the authority is no host, dots at a host's end don't count, numeric hosts and
those in brackets have no parents. URLs are read whole, whatever their length. Columns of the outputs' names are replaced, all
others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.functions.urls import ascii_host, let

URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:]*)(?::[0-9]*)?([^#]*)"


def host(url: Column) -> Column:
    """Lower case, other scripts in ASCII, no dots at its end; '' where there is none."""
    return ascii_host(F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.+$", ""))


def keys(url: Column) -> Column:
    """d:<domain> for the host and its parents, u:<host/path> for the prefixes of the URL."""
    return let(F.struct(host(url).alias("h"), F.regexp_extract(url, URL, 2).alias("rest")), lambda x: _keys(x["h"], x["rest"]))


def _keys(h: Column, rest: Column) -> Column:
    labels = F.split(h, "\\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    parents = F.when(h.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.array(F.concat(F.lit("d:"), h))).otherwise(parents)
    steps = F.split(F.regexp_extract(rest, r"^([^?]*)", 1), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("u:"), h, F.array_join(F.slice(steps, 1, i), "/")))
    whole = F.concat(F.lit("u:"), h, rest)
    return F.when(h != "", F.array_distinct(F.concat(parents, prefixes, F.array(whole)))).otherwise(F.expr("cast(array() as array<string>)"))


def entry_key(kind: Column, value: Column) -> Column:
    """The key of a list entry, by the rules for captures: its host as host() reads it, with or without a scheme, user, port, dots at its ends or *. before
    it; of a URL also the path without slashes at its end, or path and query. Null where there is no host, a domain
    comes with a path, or the kind is another."""
    text = F.regexp_replace(F.trim(value), r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//)?", "//")
    text = F.when(kind == "domain", F.regexp_replace(text, r"^//(?:\*?\.)+", "//")).otherwise(text)
    rest = F.regexp_extract(text, URL, 2)
    path = F.when(rest.contains("?"), rest).otherwise(F.regexp_replace(rest, "/+$", ""))
    named = lambda h: F.when((h == "") | ((kind == "domain") & ~rest.isin("", "/")), None).when(kind == "domain", F.concat(F.lit("d:"), h)).when(kind == "url", F.concat(F.lit("u:"), h, path))
    return let(host(text), named)


def unreadable(entries: DataFrame) -> DataFrame:
    """The entries that can hit nothing: without a host or a day, of an unknown kind or action, or not on a list."""
    bad = entry_key(F.col("kind"), F.col("value")).isNull() | F.col("list").isNull() | F.col("day").cast("date").isNull() | ~F.coalesce(F.col("action").isin("add", "remove"), F.lit(False))
    return entries.where(bad)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from entries (list, kind 'domain' or 'url', value, action 'add' or 'remove', day); until is the first day after, null: open.
    Entries that `unreadable` names count as absent."""
    on = F.when(F.col("action").isin("add", "remove"), F.col("action") == "add")
    each = entries.select("list", entry_key(F.col("kind"), F.col("value")).alias("key"), F.col("day").cast("date").alias("since"), on.alias("on")).dropna()
    daily = each.groupBy("list", "key", "since").agg(F.min("on").alias("on"))
    w = Window.partitionBy("list", "key").orderBy("since")
    return daily.withColumn("until", F.lead("since").over(w)).where("on").select("list", "key", "since", "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """captures with url_lists (sorted array of the lists that hit) and url_hits (sorted array of list=key); columns of these names are replaced."""
    kept = [c for c in captures.columns if c not in ("url_lists", "url_hits")]
    seen = captures.select(F.col(f"`{url}`").alias("u"), F.col(f"`{day}`").cast("date").alias("d")).where("u is not null and d is not null").distinct()
    asked = seen.select("u", "d", F.explode(keys(F.col("u"))).alias("key"))
    active = asked.join(intervals(entries), "key").where((F.col("since") <= F.col("d")) & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
    hits = active.groupBy("u", "d").agg(F.array_sort(F.collect_set("list")).alias("url_lists"), F.array_sort(F.collect_set(F.concat("list", F.lit("="), "key"))).alias("url_hits"))
    joined = captures.select([F.col(f"`{c}`") for c in kept]).alias("c").join(hits.alias("h"), (F.col(f"c.`{url}`") == F.col("h.u")) & (F.col(f"c.`{day}`").cast("date") == F.col("h.d")), "left")
    empty = F.expr("cast(array() as array<string>)")
    return joined.select(*[F.col(f"c.`{c}`") for c in kept], F.coalesce("h.url_lists", empty).alias("url_lists"), F.coalesce("h.url_hits", empty).alias("url_hits"))
