"""The training-data pipeline: STAGES in order, each (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.llm import bpe, decontaminate, neardup, pii, toxicity
from leadline.llm.common import Workspace, checkpoint_dir, drop, table
from leadline.llm.queries import tokenizer_path, toxicity_model


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their names as they are, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def apart(docs: DataFrame, *names: str):
    """docs with columns of these names under others, and what gives a frame docs' columns back."""
    other = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(other), lambda df: df.select(*[x.alias(c) for x, c in zip(quoted([other.get(c, c) for c in docs.columns]), docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.5 or more) go; all stay where the labels teach nothing.

    Null and empty texts have the score of the prior; rows without id are scored like others; repeated rows all stay or all go.
    """
    model = toxicity_model(spark, docs, sf_dir)
    if not model.learnt:
        return docs
    rows, back = apart(docs, "toxicity", "toxicity_evidence")
    return back(toxicity.score(rows, model).where(F.col("toxicity") < 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays.

    Null and word-free texts and rows without id are in no group and stay; repeated rows of the least id all stay.
    """
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    return docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(quoted(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go; the others, null and empty ones among them, stay as they are."""
    rows, back = apart(docs, "n_words", "spans", "items", "n_hit")
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"))
    return back(found.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; n_chars follows the new text. Null texts stay null, overlapping spans count as one."""
    rows, back = apart(docs, "pii_spans")
    found = pii.find_pii(rows).withColumn("text", pii.redact(F.col("text"), F.col("pii_spans")))
    return back(found.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids and decoded text beside the columns of documents; null and empty texts have no ids."""
    return bpe.encode_decode(docs, tokenizer_path()).withColumn("n_tokens", F.size("bpe_ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontaminate", drop_contaminated), ("pii", redact_pii), ("bpe", tokenize)]
#: The toxicity vote and the BiLSTM-CRF can't be said in SQL: run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written as Parquet to the shared folder and read again.

    A stage's own intermediate tables lie in a workspace that goes once its output is written, and its input goes with it; the last stage's
    input stays, as its result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-{name}"
        with Workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
