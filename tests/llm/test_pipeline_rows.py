"""The pipeline by brute force, on an empty table, and with columns that clash with what its operators add."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from leadline.llm import pii, queries
from leadline.llm.common import table

SMALL = "/root/testdata/sf0.001"


def redacted(text, spans):
    out, at = "", 0
    for s in spans:
        if s["start"] >= at:
            out += text[at : s["start"]] + f"<{s['kind'].upper()}>"
        at = max(at, s["end"])
    return out + text[at:]


def test_pipeline_texts_and_tokens(spark):
    from tokenizers import Tokenizer

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    kept = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SMALL)
    spans = {r["doc_id"]: (r["text"], r["n_chars"], r["pii_spans"]) for r in pii.find_pii(kept).collect()}
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation(), t.no_padding()
    assert set(got) == set(spans) and any(s for _, _, s in spans.values())
    for i, (text, n, found) in spans.items():
        want = redacted(text, found)
        ids = t.encode(want, add_special_tokens=False).ids
        assert (got[i]["text"], got[i]["n_chars"], got[i]["n_tokens"], got[i]["bpe_ids"], got[i]["bpe_decoded"]) == (want, len(want) if found else n, len(ids), ids, t.decode(ids, skip_special_tokens=False))


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and set(table(spark, SMALL, "documents").columns) <= set(out.columns)


def test_clashing_names(spark):
    names = ["toxicity", "toxicity_evidence", "n_words", "spans", "items", "n_hit", "pii_spans", "component_id", "n_shingles", "key", "h", "a.b", "two words", "text.x", "c0"]
    docs = table(spark, SMALL, "documents").limit(40).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == [*table(spark, SMALL, "documents").columns, *names]
    rows = docs.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns[: len(docs.columns)] == docs.columns


def test_stages_on_very_long_texts_and_ties(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    long = " ".join(f"w{i % 5003}" for i in range(300_000))
    rows = [(1, long), (2, long), (3, "same words in all of these texts"), (4, "same words in all of these texts"), (4, "same words in all of these texts"), (None, "no id"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], table(spark, SMALL, "documents").schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in out) == [(-1, 5), (1, len(long)), (3, 32), (5, 0), (6, 0)]
    assert {r["doc_id"]: r["n_tokens"] for r in out}[5] == 0


def test_workspaces_go_and_are_apart(spark):
    import threading

    from leadline.llm.common import Workspace, materialize

    seen = {}

    def other():
        seen["other"] = materialize(spark.range(3))

    with Workspace(spark) as run:
        inner = materialize(spark.range(5))
        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert inner.inputFiles()[0].find(run.path.rpartition("/")[2]) > 0 and seen["other"].count() == 3
    assert seen["other"].count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(run.path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(run.path))
