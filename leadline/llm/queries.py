"""The registered queries of the numbered operators, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.llm import bpe, decontaminate, htmlextract, licenses, neardup, pii, resampling, secretscan, suffixdedup, toxicity, urlfilter, vectorcodes, vectordup
from leadline.llm.common import table
from leadline.llm.oracles import ORACLE  # noqa: F401


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its tokens, and the digests of their ids and of the text decoded from them; null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer_path()).select(
        "doc_id",
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bpe_decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans, those of the model among them; null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["base"])
    counted = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [counted(k) for k in pii.KINDS]
    return pii.find_pii(docs).select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside a benchmark window, the items met, and whether that contaminates it; null texts have no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.train(docs, labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, its score, and what it is predicted; empty and null texts have the score of the prior."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its distinct shingles and the least id that links reach; null and word-free texts are linked with nothing."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its address, main text and length; null and markup-only pages have the text ''."""
    return htmlextract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes, those removed as repeated, their runs, and the digest of what is left; null texts have no bytes."""
    done = suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: matching units, licences found (sorted, comma-joined), and the nearest one with its Dice coefficient (''; 0)."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.aggregate("licenses", F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), lambda a, m: F.when((m["dice"] > a["dice"]) | ((m["dice"] == a["dice"]) & (m["license"] < a["license"])), F.struct(m["dice"], m["license"])).otherwise(a))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("license_ids"), best["license"].alias("best_license"), F.round(best["dice"], 6).alias("best_dice"))


def url_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries by rule: of each host on the captures the md5 says which list it is on, and when."""
    hosts = pages.select(urlfilter.host(F.col("url")).alias("h")).where("h <> ''").distinct()
    b = F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("int")
    first = F.date_add(F.to_date(F.lit("2022-01-01")), b % 700)
    step = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(first, days).alias("day"))
    steps = F.array(step("add", F.lit(0)), step("remove", 90 + b % 200), step("add", F.lit(400)))
    domain = F.when(b % 3 == 0, F.regexp_extract("h", r"[^.]*\.[^.]*\.[^.]*$", 0)).otherwise(F.col("h"))
    listed = hosts.where(b % 2 == 0).select(F.when(b % 3 == 0, "spam").otherwise("adult").alias("list"), F.lit("domain").alias("kind"), domain.alias("value"), F.explode(steps).alias("s"))
    paths = hosts.where(b % 5 == 1).select(F.lit("phishing").alias("list"), F.lit("url").alias("kind"), F.concat("h", F.lit("/en")).alias("value"), F.explode(steps).alias("s"))
    return listed.union(paths).select("list", "kind", "value", "s.action", "s.day").where("value <> ''")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the day it was fetched (by rule: the table has none), lists and entries that held then, and whether any did."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.to_date(F.lit("2022-06-01")), ((F.col("page_id") * 37) % 700).cast("int"))
    found = urlfilter.filter_urls(pages.withColumn("fetched_on", day), url_entries(pages))
    return found.select("page_id", "url", "fetched_on", (F.size("url_hits") > 0).alias("blocked"), F.size("url_hits").cast("long").alias("n_hits"), F.array_join("url_lists", ",").alias("lists"), F.array_join("url_hits", ",").alias("hits"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its links, the least id that they reach, and whether it is kept; unusable vectors are linked with nothing."""
    return vectordup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per usable vector: its code in hexadecimal, its error, the error of its label, and the digest of all codebooks."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectorcodes.train(vectors)
    coded = vectorcodes.errors_by(vectorcodes.encode(vectors, books).drop("embedding"), "label", "vec_id")
    code = F.array_join(F.transform("vec_codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), F.col("vec_error").alias("error"), "label_error", F.lit(vectorcodes.books_digest(books)).alias("codebooks_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans, those that the tests add among them."""
    found = secretscan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["base"])
    counted = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[counted(k) for k in secretscan.KINDS], F.sha2(secretscan.joined(base), 256).alias("base_sha256"), secretscan.joined(spans).alias("spans"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: features, weight and score towards the benchmark, and its rank among the drawn twentieth."""
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(docs, target)


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_suffix_dedup, op3_pii, op4_license_scan, op5_bpe, op6_decontaminate, op7_url_filter, op8_toxicity, op9_embedding_dedup, op10_ngram_join, op11_vector_codes, op12_secret_scan, op13_importance_resampling)}
