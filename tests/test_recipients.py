"""Recipient planning with keywords, roles and every message."""

from __future__ import annotations

from leadline import operators as op
from leadline.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_keywords_and_roles(spark):
    contacts = spark.createDataFrame([(1, "a@x", True, False, "CEO Intern"), (2, "b@x", True, False, "Clerk"), (3, "c@x", True, False, "CEO"), (4, "D@x", True, False, "intern"), (5, "e@x", False, False, "intern"), (6, "f@x", True, False, None)], "id long, email string, verified boolean, suppressed boolean, title string")
    messages = spark.createDataFrame([("d@X", "replied")], "email string, status string")
    reasons = lambda *a: [r["reason"] for r in op.plan_recipients(contacts, messages, *a).orderBy("id").collect()]
    assert reasons(["title"], ["INTERN", ""], ["ceo"]) == ["excluded_keyword", "role_filtered", "eligible", "already_replied", "not_verified", "role_filtered"]
    assert reasons() == ["eligible", "eligible", "eligible", "already_replied", "not_verified", "eligible"]


def test_every_message_counts(spark):
    n = {r["reason"]: r["n"] for r in QUERIES["outreach_summary"](spark, SMALL).collect()}
    old = {r["reason"]: r["n"] for r in QUERIES["eligibility_summary"](spark, SMALL).collect()}
    past = lambda x: sum(v for k, v in x.items() if k.startswith("already"))
    assert past(n) == past(old) > 0 and sum(n.values()) == sum(old.values())
