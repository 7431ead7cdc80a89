"""Tabs of the mirrored spreadsheet: columns, keys, what sales may edit, and how values become cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.operators.ordered import numbered
from leadline.sources import content_hash

#: Columns that sales edit in the sheet, and that are never pushed.
EDITABLE = ("owner", "sales_notes", "next_action")
#: The tabs in their order with the columns of each; the first column is the key.
TABS = {
    "README": "tab key_column editable_columns columns notes",
    "Mining_Jobs": "job_id job_name created_by created_at status company_type services country state city zipcode latitude longitude radius_km company_size selected_sources total_companies total_contacts verified_emails invalid_emails review_emails sales_ready_count campaign_id notes",
    "Companies": "company_id job_id company_name website domain phone address city state country postal_code latitude longitude industry services company_size google_rating google_reviews source_names source_urls website_status hiring_signal_status facebook_page_url last_refreshed_at compliance_posture dedupe_status",
    "Contacts": "contact_id company_id job_id contact_name first_name last_name designation department seniority role_category email phone linkedin_url facebook_url source_page source_type confidence_score primary_contact enrichment_provider enrichment_status last_verified_at final_email_status sales_ready owner sales_notes next_action",
    "Email_Validation": "validation_id contact_id company_id email syntax_status disposable_status role_based_status mx_status llm_score llm_reason millionverifier_status final_status final_reason verified_at retry_count raw_provider_result",
    "Sales_Ready_Leads": "sales_lead_id job_id company_name website city state country contact_name designation email phone services source_summary validation_status confidence_score last_verified_at campaign_status owner next_action sales_notes",
    "Outreach_Queue": "queue_id campaign_id contact_id email company_name subject send_status scheduled_at sent_at gmail_message_id opened_at clicked_at replied_at bounce_status suppression_status",
    "Campaigns": "campaign_id campaign_name job_id from_account template_id recipient_count sent_count delivered_count open_count click_count reply_count bounce_count status started_at completed_at",
    "Bounce_Log": "bounce_id campaign_id contact_id email gmail_message_id smtp_status_code bounce_type bounce_reason detected_at action_taken",
    "Suppression_List": "email domain reason source suppressed_at permanent",
    "Data_Source_Audit": "event_id job_id source_name source_type access_method compliance_posture url_or_endpoint status records_found error_message created_at",
    "Audit_Log": "audit_id actor action entity_type entity_id before_value after_value created_at",
}
#: Colours of states, as hexadecimal RGB.
COLOURS = {"good": "D9EAD3", "bad": "F4CCCC", "warn": "FFF2CC", "idle": "EFEFEF", "live": "CFE2F3"}
STATES = {
    "good": ("verified", "valid", "completed", "replied", "delivered", "green"),
    "bad": ("invalid", "failed", "bounced", "suppressed", "invalid_syntax", "provider_invalid", "disposable_rejected", "mx_failed", "red"),
    "warn": ("catch_all_review", "risk_review", "unknown_retry", "role_based_rejected", "llm_low_confidence", "paused", "skipped", "amber"),
    "live": ("running", "sending", "sent", "opened", "clicked"),
}


@dataclass(frozen=True)
class Tab:
    name: str

    @property
    def columns(self) -> list[str]:
        return TABS[self.name].split()

    @property
    def key(self) -> str:
        return self.columns[0]

    @property
    def editable(self) -> list[str]:
        """The columns that sales own, in the tab's order."""
        return [c for c in self.columns if c in EDITABLE] if self.name in ("Contacts", "Sales_Ready_Leads") else []

    @property
    def system(self) -> list[str]:
        """All columns but those."""
        return [c for c in self.columns if c not in self.editable]

    def cells(self, rows: DataFrame) -> DataFrame:
        """Every column of the tab as text, '' where rows has none of that name."""
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        return rows.select(*[(cell(F.col(c), kinds[c]) if c in kinds else F.lit("")).alias(c) for c in self.columns])

    def content(self, rows: DataFrame) -> DataFrame:
        """(key, digest) of the system columns: an edit by sales is no change."""
        cells = self.cells(rows)
        return cells.select(F.col(self.key).alias("key"), content_hash(*self.system).alias("digest"))


def cell(c: Column, kind: T.DataType) -> Column:
    """Text of a value: '' of null, times to the second, whole numbers without a point, lists joined by ', ' without their nulls."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: cell(x, kind.elementType)), ", ")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        text = F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("double").cast("string"))
    elif isinstance(kind, (T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def readme(spark, notes: dict[str, str] | None = None) -> DataFrame:
    """The registry's own tab: one row for each other tab."""
    rows = [(t.name, t.key, ", ".join(t.editable) or "(none)", ", ".join(t.columns), (notes or {}).get(t.name, "")) for t in map(Tab, TABS) if t.name != "README"]
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in Tab("README").columns]))


def colour(state: Column) -> Column:
    """The colour of a state, whatever its case; idle for what isn't listed."""
    table = F.create_map(*[F.lit(x) for kind, states in STATES.items() for s in states for x in (s, COLOURS[kind])])
    return F.coalesce(table[F.lower(state)], F.lit(COLOURS["idle"]))


def mirrored(old: DataFrame, new: DataFrame, tab: Tab) -> DataFrame:
    """The sheet (row, then the tab's columns) after it follows `new`: rows that are there keep their order and what sales wrote,
    gone ones leave and later ones move up, new ones follow by key.

    Rows are numbered over ranges of the order, each in a task of its own.
    """
    had = old.select(F.col(tab.key).alias("_k"), F.col("row").alias("_was"), *[F.col(c).alias(f"_old_{c}") for c in tab.editable])
    both = tab.cells(new).join(had, F.col(tab.key) == F.col("_k"), "left")
    for c in tab.editable:
        both = both.withColumn(c, F.when(F.col("_k").isNotNull(), F.coalesce(f"_old_{c}", F.lit(""))).otherwise(F.col(c)))
    placed = numbered(both, F.col("_was").asc_nulls_last(), F.length(tab.key), F.col(tab.key), name="_place")
    return placed.select((F.col("_place") + 1).alias("row"), *tab.columns)


def letters(n: int) -> str:
    """A column's letters, from 1."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
