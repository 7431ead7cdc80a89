"""Set-at-a-time merges, rankings, diffs and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_by_key(rows: DataFrame, key: str, order: str, fill: list[str], union: str) -> DataFrame:
    """One row per key: each of `fill` its first value that isn't null, `union` its distinct values sorted, and whether several met.

    Rows without a key stay apart, as rows of their own.
    """
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fill]
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*first, F.array_join(F.array_sort(F.collect_set(union)), ",").alias(union), F.count("*").alias("sightings"))
    apart = rows.where(F.col(key).isNull()).select(key, *fill, F.coalesce(F.col(union).cast("string"), F.lit("")).alias(union), F.lit(1).cast("long").alias("sightings"))
    return keyed.unionByName(apart).withColumn("dedupe_status", F.when(F.col("sightings") > 1, "merged").otherwise("unique"))


def top_by(rows: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def ranked(rows: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """rows with the place of each in its group, from 1."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): append, update, skip or delete."""
    o, n = old.select(F.col(key), F.col(digest).alias("was")), new.select(F.col(key), F.col(digest).alias("now"))
    action = F.when(F.col("was").isNull(), "append").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "update").otherwise("skip")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def suppressed(rows: DataFrame, emails: DataFrame, domains: DataFrame, email: str = "email") -> DataFrame:
    """rows with `suppressed`: the address or its domain is on a list, whatever the case; two equi-joins, no disjunction."""
    by = rows.withColumn("_e", F.lower(email)).withColumn("_d", F.substring_index(F.lower(email), "@", -1))
    e = emails.select(F.lower("email").alias("_e")).distinct().withColumn("_he", F.lit(True))
    d = domains.select(F.lower("domain").alias("_d")).distinct().withColumn("_hd", F.lit(True))
    out = by.join(e, "_e", "left").join(d, "_d", "left")
    return out.select(*rows.columns, (F.coalesce("_he", F.lit(False)) | F.coalesce("_hd", F.lit(False))).alias("suppressed"))


def slots(rows: DataFrame, group: str, order: list[Column], start: int, end: int, interval: int) -> DataFrame:
    """rows with day and minute: the k-th of a group gets the k-th slot of `interval` minutes between start and end, day after day."""
    from leadline.operators.ordered import ranked_in

    per_day = (end - start) // interval + 1
    placed = ranked_in(rows, [group], *order, name="_k").withColumn("_k", F.col("_k") - 1)
    return placed.withColumn("day", F.floor(F.col("_k") / per_day).cast("long")).withColumn("minute", (F.lit(start) + (F.col("_k") % per_day) * interval).cast("long")).drop("_k")


def latest_before(asks: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, days: int, value: str) -> DataFrame:
    """asks, each row once, with the value of the newest fact of its key in the `days` before; of facts at one time the greatest value.

    One sorted pass over both: the last fact before an ask is taken if it is young enough. Keys are split into stretches of
    `days`, and a fact stands in its own and the next one, so that a key of very many rows is no single task's work.
    """
    width = days * 86_400_000_000
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    a = asks.select(F.struct(*asks.columns).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_at"), stretch(at).alias("_s"), F.lit(1).alias("_kind"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"))
    f = facts.where(F.col(key).isNotNull() & F.col(fact_at).isNotNull())
    f = f.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(fact_at).alias("_at"), F.explode(F.array(stretch(fact_at), stretch(fact_at) + 1)).alias("_s"), F.lit(0).alias("_kind"), F.col(value).alias("_v"))
    w = Window.partitionBy("_k", "_s").orderBy("_at", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_at", "_v")), ignorenulls=True).over(w)
    out = a.unionByName(f).withColumn("_last", last).where("_kind = 1")
    young = F.col("_last._at") > F.col("_at") - F.expr(f"INTERVAL {days} DAYS")
    return out.select("_row.*", F.when(young, F.col("_last._v")).alias(value))


def upsert(rows: DataFrame, key: str, order: str, scalars: list[str], url: str, posture: str) -> DataFrame:
    """One row per key, and one for each row without: the first row's scalars as they are, the addresses in the order they were
    first seen, the worst posture (green, amber, red), the number of rows, and whether several met.
    """
    level = F.when(F.col(posture) == "red", 2).when(F.col(posture) == "amber", 1).otherwise(0)
    named = rows.withColumn("_key", F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("r"), F.col(order).cast("string"))))
    seen = named.where(F.col(url).isNotNull()).groupBy("_key", url).agg(F.min(order).alias("_o")).groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", url))), lambda x: x[url]), ",").alias("urls"))
    one = named.groupBy("_key").agg(F.first(key).alias(key), F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in scalars], F.max(level).alias("_level"), F.count("*").alias("sightings"))
    worst = F.element_at(F.array(*map(F.lit, ("green", "amber", "red"))), F.col("_level") + 1)
    return one.join(seen, "_key", "left").select(key, order, *scalars, F.coalesce("urls", F.lit("")).alias("urls"), worst.alias("posture"), "sightings", F.when(F.col("sightings") > 1, "merged").otherwise("unique").alias("dedupe_status"))


def left_spread(rows: DataFrame, key: str, facts: DataFrame, fact_key: str, spread: str) -> DataFrame:
    """rows with the other columns of facts by key, nulls where there are none; rows without a key meet nothing and are dealt by `spread`, as one task would
    get them all otherwise."""
    by = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    right = facts.withColumn("_by", F.lit(0).cast("long"))
    left = rows.withColumn("_by_own", by)
    return left.join(right, (F.col(key) == F.col(fact_key)) & (F.col("_by_own") == F.col("_by")), "left").drop(fact_key, "_by", "_by_own")


def match_notices(notices: DataFrame, messages: DataFrame, days: int = 3) -> DataFrame:
    """notices (notice_id, ref, gmail, email, seen_at) with the message each speaks of, and how it was found: by the id in its
    reference, else by the mail system's id, else as the newest message sent to the address in the `days` before."""
    m = messages.select(F.col("message_id").alias("_m"), "gmail_id", F.lower("to_email").alias("_to"), "sent_at")
    by_ref = left_spread(notices, "ref", m.select("_m", F.col("_m").alias("by_ref")), "_m", "notice_id")
    mailed = m.where("gmail_id is not null").groupBy(F.col("gmail_id").alias("_g")).agg(F.max("_m").alias("by_gmail"))
    by_mail = left_spread(by_ref, "gmail", mailed, "_g", "notice_id").withColumn("_to", F.lower("email"))
    from leadline.sources.shared import written

    known = written(by_mail)
    found = F.col("by_ref").isNotNull() | F.col("by_gmail").isNotNull()
    open_ = known.where(~found)  # only of these does the address decide, and only their addresses' messages are put in order of time
    facts = m.where("sent_at is not null").select("_to", "sent_at", F.col("_m").alias("by_time"))
    facts = facts.join(open_.select("_to").distinct().hint("shuffle_hash"), "_to", "left_semi")
    timed = latest_before(open_, facts, "_to", "seen_at", "sent_at", days, "by_time")
    out = timed.unionByName(known.where(found), allowMissingColumns=True)
    tier = F.when(F.col("by_ref").isNotNull(), 1).when(F.col("by_gmail").isNotNull(), 2).when(F.col("by_time").isNotNull(), 3)
    return out.select("notice_id", F.coalesce("by_ref", "by_gmail", "by_time").alias("message_id"), tier.alias("tier"))


#: Kinds of bounces that lose an address at once, what is done then, and the state that the message gets; all others are soft.
LOST = {"spam_rejected": ("suppressed_spam", "spam_complaint"), "hard": ("suppressed_hard", "hard_bounce"), "invalid_domain": ("suppressed_hard", "hard_bounce"), "mailbox_full": ("suppressed_hard", "hard_bounce"), "blocked": ("suppressed_blocked", "blocked")}
#: Soft bounces that an address may have before it is lost.
BUDGET = 3


def bounce_actions(rows: DataFrame, recipient: str, order: list[str], budget: int = BUDGET) -> DataFrame:
    """rows (with `kind`) with action and message_status: what each bounce leads to, in the order in which they came.

    Kinds of LOST suppress at once. Every other kind is retried while the recipient has had fewer than `budget` bounces of kind soft, the row's own
    included, and suppresses from then on. Only a recipient's first `budget` soft bounces are looked for, which a task finds among its own rows
    before any go to another, and are joined back; no recipient's bounces stand in one window.
    """
    at = F.struct(*order)
    firsts = top_by(rows.where("kind = 'soft'"), [recipient], [F.col(o) for o in order], budget).groupBy(recipient).agg(F.collect_list(at).alias("_softs"))
    from leadline.operators.ordered import grouped_join

    joined = grouped_join(rows, firsts, [recipient], order[-1], how="left").withColumn("_soft", F.size(F.filter(F.coalesce("_softs", F.array()), lambda x: x <= at)))
    k, action, status = F.col("kind"), None, None
    for kind, (does, becomes) in LOST.items():
        action = F.when(k == kind, does) if action is None else action.when(k == kind, does)
        status = F.when(k == kind, becomes) if status is None else status.when(k == kind, becomes)
    again = F.concat(F.lit("soft_retry ("), F.col("_soft"), F.lit(f"/{budget})"))
    action = action.when(F.col("_soft") >= budget, "suppressed_soft_exhausted").otherwise(again)
    return joined.select(*rows.columns, action.alias("action"), status.otherwise("soft_bounce").alias("message_status"))


#: Why an address is suppressed, by what was done.
REASONS = {"suppressed_spam": "Spam rejection", "suppressed_hard": "Hard bounce", "suppressed_blocked": "Blocked by recipient server", "suppressed_soft_exhausted": f"Repeated soft bounces ({BUDGET})"}


def suppressed_by_bounce(actions: DataFrame, recipient: str, order: list[str]) -> DataFrame:
    """(email, reason): addresses in lower case that a bounce suppressed, with the reason of the first that did."""
    lost = actions.where(F.col("action").startswith("suppressed"))
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("action")]
    return lost.groupBy(F.lower(recipient).alias("email")).agg(F.min_by(reason, F.struct(*order)).alias("reason"))


def upsert_suppressions(there: DataFrame, lost: DataFrame) -> DataFrame:
    """(email, reason, permanent): the list that is there (id, email, reason, permanent), one row an address whatever its case, and those that bounces
    lost (email, reason): new ones are added, known ones keep their reason; both are permanent from then on."""
    known = there.where("email IS NOT NULL").groupBy(F.lower("email").alias("email")).agg(F.min_by("reason", "id").alias("_reason"), F.bool_or("permanent").alias("_permanent"))
    both = known.join(lost.withColumn("_lost", F.lit(True)), "email", "full_outer")
    return both.select("email", F.coalesce("_reason", "reason").alias("reason"), F.coalesce(F.col("_lost"), F.col("_permanent")).alias("permanent"))


def plan_recipients(contacts: DataFrame, messages: DataFrame, role: list[str] | None = None, exclude_keywords: list[str] | None = None, include_roles: list[str] | None = None) -> DataFrame:
    """contacts (id, email, verified, suppressed) with a reason: no_email, duplicate, not_verified, suppressed, what an earlier message came to (bounced before unsubscribed before replied), excluded_keyword, role_filtered, else eligible.

    The last two look into the columns `role` in lower case: any of `exclude_keywords` is there; `include_roles` are given and none of them is.
    Contacts without an address are set apart before the window, so that they make no group of their own.
    """
    s = F.col("status")
    past = messages.groupBy(F.lower("email").alias("_e")).agg(F.min(F.when(s.isin("bounced", "blocked"), 0).when(s == "unsubscribed", 1).when(s == "replied", 2)).alias("_t"))
    mailed = contacts.where(F.col("email").isNotNull()).withColumn("_e", F.lower("email"))
    first = mailed.withColumn("_n", F.row_number().over(Window.partitionBy("_e").orderBy("id")))
    t = F.col("_t")
    hay = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in role or []]))
    among = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w)) if words else F.lit(False)
    excluded = among([w.lower() for w in exclude_keywords or [] if w])
    filtered = ~among([w.lower() for w in include_roles if w]) if include_roles else F.lit(False)
    reason = F.when(F.col("_n") > 1, "duplicate").when(~F.col("verified"), "not_verified").when(F.col("suppressed"), "suppressed").when(t == 0, "already_bounced").when(t == 1, "already_unsubscribed").when(t == 2, "already_replied").when(excluded, "excluded_keyword").when(filtered, "role_filtered").otherwise("eligible")
    planned = first.join(past, "_e", "left").select(*contacts.columns, reason.alias("reason"))
    return planned.unionByName(contacts.where(F.col("email").isNull()).withColumn("reason", F.lit("no_email")))


#: What is kept of a company's sightings: enough that merging a sighting again changes nothing.
COMPANY = "key string, first long, last long, source_name string, urls array<struct<o:long,url:string>>, level int"


def company_rows(sightings: DataFrame) -> DataFrame:
    """Each sighting (key, sighting_id, source_name, source_url, posture) as a row of COMPANY."""
    level = F.when(F.col("posture") == "red", 2).when(F.col("posture") == "amber", 1).otherwise(0)
    url = F.filter(F.array(F.struct(F.col("sighting_id").alias("o"), F.col("source_url").alias("url"))), lambda x: x["url"].isNotNull())
    return sightings.select("key", F.col("sighting_id").alias("first"), F.col("sighting_id").alias("last"), "source_name", url.alias("urls"), level.alias("level"))


def merge_companies(rows: DataFrame) -> DataFrame:
    """Rows of COMPANY as one a key: first and last sighting, the first one's source, each address where it was first seen, the worst posture.

    Addresses are merged apart, so that no key's are held more than once each.
    """
    one = rows.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("source_name", "first").alias("source_name"), F.max("level").alias("level"))
    seen = rows.select("key", F.explode("urls").alias("x")).groupBy("key", "x.url").agg(F.min("x.o").alias("o"))
    urls = seen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "url"))).alias("urls"))
    return one.join(urls, "key", "left").select("key", "first", "last", "source_name", F.coalesce("urls", F.expr("cast(array() as array<struct<o:long,url:string>>)")).alias("urls"), "level")


def company_view(rows: DataFrame) -> DataFrame:
    """Rows of COMPANY as they are shown: key, source_name, urls, posture and dedupe_status."""
    posture = F.element_at(F.array(*map(F.lit, ("green", "amber", "red"))), F.col("level") + 1)
    urls = F.array_join(F.transform("urls", lambda x: x["url"]), ",")
    return rows.select("key", "source_name", urls.alias("urls"), posture.alias("posture"), F.when(F.col("first") < F.col("last"), "merged").otherwise("unique").alias("dedupe_status"))
