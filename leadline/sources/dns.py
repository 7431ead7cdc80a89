"""Whether a domain takes mail, from answers that were captured: MX first, then the address records that stand for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The questions in their order. What a lookup can come to: ok, nxdomain (no such domain), noanswer (no such record), and anything else, which may
#: come out differently next time (servfail, timeout).
TYPES = ("MX", "A", "AAAA")
SETTLED = ("ok", "nxdomain", "noanswer")
#: How often a lookup that failed for a while is tried, and hours between.
ATTEMPTS, HOURS = 3, 6


def plain(domain: Column) -> Column:
    """Lower case, without white space around and dots at the end; '' of a null."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"\.+$", "")


def mail_hosts(domains: DataFrame, answers: DataFrame, now: Column, domain: str = "domain", attempts: int = ATTEMPTS, hours: int = HOURS) -> DataFrame:
    """domains with status ('pass', 'fail', 'retry'), detail, tries and retry_at by the newest answers (domain, type, result, records, asked_at) until now.

    MX records with a name pass; without one an address record does; where the domain or all records are missing, it fails. A lookup that failed for a
    while, or was never made, is to be tried again: at once, or some hours after the last time; tries counts such failures, and as many as `attempts` leave
    it 'retry' without a time. A settled answer counts for good, whatever failed before it. Of answers at one time the greater
    by its words counts.
    """
    asked = answers.where(F.col("asked_at") <= now).select(plain(F.col("domain")).alias("_d"), "type", "result", "records", "asked_at")
    newest = lambda t: F.max_by(F.struct("result", "records"), F.when(F.col("type") == t, F.struct("asked_at", "result", "records"))).alias(t)
    broken = ~F.col("result").isin(*SETTLED)
    known = asked.groupBy("_d").agg(*[newest(t) for t in TYPES], F.count_if(broken).alias("_tries"), F.max(F.when(broken, F.col("asked_at"))).alias("_last"))
    rows = domains.withColumn("_d", plain(F.col(domain))).join(known, "_d", "left")
    names = F.filter(F.transform(F.coalesce("MX.records", F.array()), lambda x: F.regexp_replace(x, r"\.+$", "")), lambda x: x != "")
    rows = rows.withColumn("_names", F.array_sort(names))
    say = lambda status, detail: F.struct(F.lit(status).alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    got = lambda t: F.col(f"{t}.result")
    again = lambda t: F.when(got(t).isNull(), say("retry", f"{t}: not asked")).otherwise(say("retry", F.concat(F.lit(f"{t}: "), got(t))))
    out = F.when(F.col("_d") == "", say("fail", "empty domain"))
    out = out.when((got("MX") == "ok") & (F.size("_names") > 0), say("pass", F.concat(F.lit("MX: "), F.array_join(F.slice("_names", 1, 5), ", "))))
    out = out.when(got("MX") == "nxdomain", say("fail", "NXDOMAIN: domain does not exist"))
    out = out.when(got("MX").isNull() | ~got("MX").isin(*SETTLED), again("MX"))
    for t in TYPES[1:]:
        out = out.when((got(t) == "ok") & (F.size(F.col(f"{t}.records")) > 0), say("pass", f"{t} fallback (implicit MX)"))
        out = out.when(got(t).isNull() | ~got(t).isin(*SETTLED), again(t))
    out = out.otherwise(say("fail", "no MX and no A/AAAA fallback"))
    rows = rows.withColumn("_out", out)
    tries = F.when(F.col("_out.status") == "retry", F.coalesce("_tries", F.lit(0))).otherwise(0).cast("int")
    due = F.when((F.col("_out.status") == "retry") & (tries < attempts), F.coalesce(F.col("_last") + F.make_dt_interval(hours=F.lit(hours)), now))
    return rows.select(*[F.col(f"`{c}`") for c in domains.columns], "_out.status", "_out.detail", tries.alias("tries"), due.alias("retry_at"))
