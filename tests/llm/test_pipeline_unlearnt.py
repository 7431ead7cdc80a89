"""The toxicity stage keeps documents where labels teach nothing."""

from __future__ import annotations

import corpus_pipeline


def test_nothing_learnt_keeps_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, "")], "doc_id long, text string")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
