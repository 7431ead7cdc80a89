"""Hiring phrases in real texts, against plain Python."""

from __future__ import annotations

import re

from leadline.functions import web
from leadline.plans import QUERIES


def plain(text):
    out = []
    for p in web.HIRING_PHRASES:
        if m := re.search(rf"\b{re.escape(p)}\b", text or "", re.I):
            out.append(f"{p}: " + " ".join(text[max(0, m.start() - 40) : m.end() + 60].split()))
    return "\n".join(out)


def test_document_hiring(spark, tmp_path):
    words = "alpha beta  gamma\n" * 9
    texts = [None, "", "we're looking forward to it", f"{words}We're Hiring now. {words} Join our  team, join our team {words}", "Open Positions", f"{words}open roles{words}", f"{words}, now hiring. {words} We are looking for x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["signals"] for r in QUERIES["document_hiring"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(bool(x) for x in got.values()) == 3
