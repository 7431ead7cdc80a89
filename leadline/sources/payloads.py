"""Landed payloads of providers as rows: lists under any of several names, fields under any of several aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import functions as fn
from leadline.functions import firms, web

#: Names under which a provider lists its rows, and aliases of a company's and of a posting's fields.
LISTS = ("results", "data", "companies", "items")
COMPANY = {
    "name": "name company_name title", "source_url": "source_url profile_url listing_url", "website": "website url site", "domain": "domain", "phone": "phone phone_number telephone", "address": "address formatted_address", "city": "city locality", "state": "state region", "country": "country",
    "postal_code": "postal_code zip zipcode", "industry": "industry category", "description": "description summary", "company_size": "company_size size employees",
}
POSTING = {"title": "job_title title position", "source_url": "source_url url job_url", "location": "location city job_location", "excerpt": "description snippet summary"}


def first_said(row: Column, names: str) -> Column:
    """Of a map the first value of the names that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(row[n]), F.lit("")) for n in names.split()])


def rows_of(body: Column) -> Column:
    """The payload's rows as maps of strings: a bare list, or the first list under a known name; none of anything else."""
    kind = "array<map<string,string>>"
    listed = F.from_json(body, f"struct<{','.join(f'{n}:{kind}' for n in LISTS)}>")
    bare = F.when(F.trim(body).startswith("["), F.from_json(body, kind))
    return F.coalesce(bare, *[listed[n] for n in LISTS], F.expr(f"cast(array() as {kind})"))


def companies(payloads: DataFrame, body: str = "body") -> DataFrame:
    """The payloads' companies beside the other columns; rows without a name are left out, a missing domain comes from the website."""
    row = payloads.select(*[c for c in payloads.columns if c != body], F.explode(rows_of(F.col(body))).alias("_r"))
    out = row.select(*[c for c in row.columns if c != "_r"], *[first_said(F.col("_r"), names).alias(f) for f, names in COMPANY.items()]).where("name is not null")
    return out.withColumn("domain", F.coalesce("domain", fn.normalize_domain(F.col("website"))))


def postings(payloads: DataFrame, body: str = "body") -> DataFrame:
    """The payloads' postings beside the other columns; those without a title are left out."""
    row = payloads.select(*[c for c in payloads.columns if c != body], F.explode(rows_of(F.col(body))).alias("_r"))
    return row.select(*[c for c in row.columns if c != "_r"], *[first_said(F.col("_r"), names).alias(f) for f, names in POSTING.items()]).where("title is not null").withColumn("confidence", F.lit(0.6))


JOB = "title string, company_name string, company string, location string, description string, link string, share_link string, postedAt string, posted_at string, detected_extensions struct<posted_at:string>, apply_options array<struct<link:string>>"


def search_jobs(payloads: DataFrame, now: Column, body: str = "body", company: str = "company", city: str = "city") -> DataFrame:
    """Postings of two providers' searches for a company (columns company and city): those whose employer's name holds the
    company's or is held by it; (other columns, title, location, posted_at, source_url, excerpt)."""
    parsed = F.from_json(body, f"jobs_results array<struct<{_typed(JOB)}>>, jobs array<struct<{_typed(JOB)}>>")
    none = F.expr(f"cast(array() as array<struct<{_typed(JOB)}>>)")
    row = payloads.withColumn("_j", F.explode(F.concat(F.coalesce(parsed["jobs_results"], none), F.coalesce(parsed["jobs"], none))))
    said = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])
    j = F.col("_j")
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    theirs, wanted = plain(said(j["company_name"], j["company"])), plain(F.col(company))
    row = row.where((wanted != "") & (F.contains(theirs, wanted) | F.contains(wanted, theirs)))
    link = said(j["link"], F.get(F.filter(F.transform(j["apply_options"], lambda o: o["link"]), lambda x: x.isNotNull() & (x != "")), 0), j["share_link"])
    posted = said(j["detected_extensions"]["posted_at"], j["postedAt"], j["posted_at"])
    kept = [c for c in payloads.columns if c not in (body, company, city)]
    return row.select(*kept, j["title"].alias("title"), said(j["location"], F.col(city)).alias("location"), web.relative_date(posted, now).alias("posted_at"), link.alias("source_url"), web.excerpt(j["description"]).alias("excerpt"))


def _typed(fields: str) -> str:
    """name kind, ... as name:kind, ... of a struct."""
    return ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


def found_pages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Firms' pages among a search's organic results, each page once (its first result): (page_url, name, category, hiring)."""
    kind = "organic_results array<struct<position:int,title:string,link:string,snippet:string,rich_snippet:struct<top:struct<extensions:array<string>>>>>"
    r = payloads.select(F.explode(F.from_json(body, kind)["organic_results"]).alias("r")).select("r.*")
    r = r.withColumn("page_url", firms.page_address(F.col("link"))).where("page_url is not null")
    name = F.nullif(F.trim(F.regexp_extract("title", r"^(.*?)\s*(?:[|–]|\s-\s|-\s|$)", 1)), F.lit(""))
    out = r.select("page_url", "position", name.alias("name"), F.get("rich_snippet.top.extensions", 0).alias("category"), firms.is_hiring(F.col("title"), F.col("snippet")).alias("hiring"))
    return out.groupBy("page_url").agg(F.min_by(F.struct("name", "category", "hiring"), "position").alias("x")).select("page_url", "x.*")


PERSON = "status string, name string, first_name string, last_name string, current_title string, current_work_email string, email string, recommended_email string, current_work_phone string, phone string, linkedin_url string, emails array<struct<email:string,type:string,smtp_valid:string,grade:string>>, phones array<struct<number:string>>, links map<string,string>"


def people(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Looked-up people beside the other columns: the best address (work before listed ones: graded valid, then professional,
    then as listed), phone, profile, and how sure it is; a payload with none of the three gives no row."""
    # a generator stands between the parse and its fields, or each field would parse the body again
    p = payloads.select("*", F.explode(F.array(F.from_json(body, PERSON))).alias("_p")).where("_p is not null and coalesce(_p.status, '') <> 'not_found'")
    said = lambda x: F.nullif(F.trim(x), F.lit(""))
    good = F.array(*map(F.lit, ("valid", "a", "a+")))
    graded = F.transform(F.col("_p.emails"), lambda e, i: F.struct((~F.array_contains(good, F.lower(F.coalesce(e["smtp_valid"], e["grade"], F.lit(""))))).alias("bad"), (F.coalesce(e["type"], F.lit("")) != "professional").alias("own"), i.alias("i"), said(e["email"]).alias("email"), F.lower(F.coalesce(e["smtp_valid"], e["grade"], F.lit(""))).alias("grade")))
    listed = F.array_sort(F.filter(graded, lambda e: e["email"].contains("@")))
    top = F.coalesce(*[F.when(F.col(f"_p.{c}").contains("@"), said(F.col(f"_p.{c}"))) for c in ("current_work_email", "email", "recommended_email")])
    p = p.withColumn("email", F.coalesce(top, F.get(listed, 0)["email"]))
    grade = F.get(F.filter(graded, lambda e: e["email"] == F.col("email")), 0)["grade"]
    sure = F.when(F.col("email").isNull(), 0.4).when(grade.isin("valid", "a", "a+"), 0.9).when(grade.isin("b", "risky"), 0.7).when(grade.isin("invalid", "f"), 0.5).when(F.col("_p.current_work_email") == F.col("email"), 0.8).otherwise(0.6)
    phone = F.coalesce(said(F.col("_p.current_work_phone")), said(F.col("_p.phone")), F.get(F.filter(F.transform("_p.phones", lambda x: said(x["number"])), lambda x: x.isNotNull()), 0))
    linkedin = F.coalesce(said(F.col("_p.linkedin_url")), said(F.col("_p.links")["linkedin"]))
    out = p.select(*[c for c in payloads.columns if c != body], F.col("_p.name").alias("full_name"), F.col("_p.current_title").alias("designation"), "email", phone.alias("phone"), linkedin.alias("linkedin_url"), sure.alias("confidence"))
    return out.where("email is not null or phone is not null or linkedin_url is not null")


def scores(answers: DataFrame, content: str = "content") -> DataFrame:
    """(email, score, reason) of a model's answers, as a list under 'results' or a bare one; scores outside 0 to 1 and rows without an address go."""
    kind = "array<struct<email:string,score:string,reason:string>>"
    listed = F.coalesce(F.when(F.trim(F.col(content)).startswith("["), F.from_json(content, kind)), F.from_json(content, f"results {kind}")["results"])
    r = answers.select(F.explode(listed).alias("r")).select(F.lower(F.trim("r.email")).alias("email"), F.when(F.col("r.score").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("r.score")).cast("double").alias("score"), F.coalesce(F.nullif(F.trim("r.reason"), F.lit("")), F.lit("llm score")).alias("reason"))
    return r.where("email like '%@%' and score between 0 and 1").withColumn("score", F.round("score", 3))


# ---- adapters: a source is a function (spark, sf_dir) -> rows under one contract

CONTRACT = ("company_id", "source_name", "source_url", "posture")
SOURCES: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {}


def source(name: str, posture: str):
    """Registers a source under a name with its posture."""

    def keep(f):
        SOURCES[name] = posture, f
        return f

    return keep


def discover(spark: SparkSession, sf_dir: str, selected: list[str]) -> DataFrame:
    """The rows of all selected sources under the contract; a name that isn't registered is refused."""
    unknown = sorted(set(selected) - set(SOURCES))
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    out = None
    for name in selected:
        posture, f = SOURCES[name]
        rows = f(spark, sf_dir).select("company_id", F.lit(name).alias("source_name"), "source_url", F.lit(posture).alias("posture"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "company_id long, source_name string, source_url string, posture string")


def once(rows: DataFrame, keys: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what f adds to their distinct keys: an expensive step runs once a key, however often it stands there."""
    return rows.join(f(rows.select(*keys).distinct()), keys, "left")
