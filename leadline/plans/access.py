"""Queries on who may see what, and on rules that a settings page changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.functions import checks
from leadline.model import frame, sql
from leadline.plans.registry import query

GRANTS = "CASE WHEN is_admin THEN '*' WHEN user_id % 3 = 1 THEN 'view,click' WHEN user_id % 3 = 2 THEN 'signup' ELSE '' END"


@query(sql(f"""SELECT event_id, event_type AS page, coalesce(list_has_any(string_split(g, ','), ['*', event_type]), false) AS granted FROM events LEFT JOIN (SELECT user_id, {GRANTS} AS g FROM users) USING (user_id)"""))
def page_grants(spark: SparkSession, d: str) -> DataFrame:
    """OP-F16: every visit of a page against its user's grants: a page's name, or * for all; who isn't known is granted nothing."""
    users = frame(spark, d, "users").select("user_id", F.split(F.expr(GRANTS), ",").alias("grants"))
    rows = frame(spark, d, "events").join(users, "user_id", "left")
    return rows.select("event_id", F.col("event_type").alias("page"), checks.granted(F.col("grants"), F.col("event_type")).alias("granted"))


@query("""SELECT c_custkey AS tenant, CASE WHEN c_custkey % 4 < 3 THEN 'catch_all_handling=' || h || ';catch_all_policy=' || h || ';' ELSE 'catch_all_policy=review;' END || 'llm_mode=' || CASE WHEN c_custkey % 2 = 0 THEN 'hard' ELSE 'advisory' END || CASE WHEN c_custkey % 3 = 0 THEN ';unknown_retry=' || CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END || ';unknown_retry_policy=' || CASE WHEN c_custkey % 6 = 0 THEN 'retry' ELSE 'drop' END ELSE ';unknown_retry=1' END AS rules FROM (SELECT *, lower(c_mktsegment) AS h FROM customer)""")
def rule_patches(spark: SparkSession, d: str) -> DataFrame:
    """OP-M30: every tenant's rules after a settings page's patch: what the page calls a field is kept under its name and the pipeline's."""
    k = F.col("c_custkey")
    rules = F.create_map(F.lit("catch_all_policy"), F.lit("review"), F.lit("llm_mode"), F.lit("advisory"), F.lit("unknown_retry"), F.lit("1"))
    given = F.array(
        F.when(k % 4 < 3, F.struct(F.lit("catch_all_handling").alias("key"), F.lower("c_mktsegment").alias("value"))),
        F.when(k % 2 == 0, F.struct(F.lit("llm_mode").alias("key"), F.lit("hard").alias("value"))),
        F.when(k % 3 == 0, F.struct(F.lit("unknown_retry_policy").alias("key"), F.when(k % 6 == 0, "retry").otherwise("drop").alias("value"))),
    )
    patch = F.map_from_entries(F.array_compact(given))
    out = checks.patched(rules, patch)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return frame(spark, d, "customer").select(k.alias("tenant"), text.alias("rules"))
